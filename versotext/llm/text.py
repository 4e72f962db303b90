"""Small helpers shared by the text operators."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ``bytes.translate`` table: A-Z to lower case, other ASCII that is neither digit nor letter to a space.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def plain_words(raw: bytes) -> list[bytes]:
    """Lower-cased words of digits, ASCII letters and all characters above U+007F."""
    return raw.translate(WORD_TABLE).split()


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of the batches that hold about ``limit`` bytes of ``column`` or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        kind = "q" if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else "i"
        offsets = memoryview(values.buffers()[1]).cast("B").cast(kind)[values.offset : values.offset + batch.num_rows + 1]
        begin = 0
        for row in range(1, batch.num_rows + 1):
            if row == batch.num_rows or offsets[row + 1] - offsets[begin] > limit:
                yield batch.slice(begin, row - begin)
                begin = row


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """The column's UTF-8 bytes as Python objects."""
    values = batch.column(column)
    kind = pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
    return values.cast(kind).to_pylist()


def gather(flat: np.ndarray, starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs ``flat[starts[i]:starts[i + 1]]`` for each i of ``at``, one after another."""
    n = starts[at + 1] - starts[at]
    stops = np.cumsum(n)
    total = int(stops[-1]) if len(stops) else 0
    return flat[np.repeat(starts[at] - (stops - n), n) + np.arange(total)]


def has_letter(text: str) -> bool:
    """Whether a character of Unicode's letter categories stands in the text; number signs such as Ⅷ or ½ are none."""
    return any(map(str.isalpha, text))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns in use, under fixed names, so that other columns can't clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only in a local session without it, as
    in tests, a folder under the warehouse is used; any other session fails.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def release(spark: SparkSession, wait: float = 2.5) -> None:
    """Let Spark drop shuffle and checkpoint files that nothing refers to any more.

    Its cleaner acts on what the driver's garbage collection finds, which may not run for long.
    The driver learns of frames dropped in Python only after about a second.
    """
    gc.collect()
    time.sleep(wait)
    for _ in range(2):  # what has finalizers goes with the second
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
        current = context.getCheckpointDir()
    return named or current


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of written files, in whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Hashes of rows are places among so many.
PLACES = 1 << 40


def sample_place(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """A row's place among ``PLACES``: a hash of its id and its text, so that rows with a null or a repeated id are spread too."""
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(id_column), F.col(text_column)), F.lit(PLACES))


def sample_rates(sizes: dict, each: int) -> dict:
    """Of each value the first place that is no longer taken, so that about ``1.5 * each`` rows are."""
    return {value: min(PLACES, int(1.5 * each / max(n, 1) * PLACES)) for value, n in sizes.items()}


def first_places(df: DataFrame, by: str, each: int, place: str = "place") -> DataFrame:
    """At most ``each`` rows of each value of ``by``: those of the smallest places, rows of one place counted once.

    The bound holds in the plan: a task hands on a place once, and no more than ``each`` rows of a value.
    """
    one = df.groupBy(by, place).agg(*(F.first(c).alias(c) for c in df.columns if c not in (by, place)))
    best = Window.partitionBy(by).orderBy(place)
    return one.withColumn("__rank", F.row_number().over(best)).where(F.col("__rank") <= each).drop("__rank")


def bounded_sample(df: DataFrame, by: str, each: int) -> tuple[DataFrame, dict]:
    """At most ``each`` distinct rows (doc_id, text) of each value of ``by``, with their ``place``; and each value's number of rows.

    All rows are counted; those taken are the ones of the smallest hashes, whatever the ids are.
    """
    placed = df.withColumn("place", sample_place())
    counted = placed.groupBy(by).agg(F.count("*").alias("n"), F.approx_count_distinct("place", 0.02).alias("d")).collect()
    limit = F.lit(0)
    for value, stop in sample_rates({r[by]: r["d"] for r in counted}, each).items():
        limit = F.when(F.col(by) == F.lit(value), F.lit(stop)).otherwise(limit)
    return first_places(placed.where(F.col("place") < limit), by, each), {r[by]: r["n"] for r in counted}
