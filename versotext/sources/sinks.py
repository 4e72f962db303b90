"""Writers: canonical JSON, generated tables, and batches that appear all at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versotext.functions import js
from versotext.functions.text import source_hash
from versotext.operators.descriptor import by_entries


def snapshot_text(snapshot: DataFrame) -> DataFrame:
    """One row: the whole snapshot as canonical JSON. A snapshot is a committed file, as large as a descriptor makes it."""
    own = snapshot.groupBy("locale").agg(F.array_sort(F.collect_list(F.struct("key", "value_json"))).alias("rows"))
    field = lambda r: F.concat(F.to_json(F.array(r["key"])).substr(F.lit(2), F.length(F.to_json(F.array(r["key"]))) - 2), F.lit(":"), r["value_json"])
    parts = own.select("locale", F.concat(F.lit('"'), "locale", F.lit('":{'), F.array_join(F.transform("rows", field), ","), F.lit("}")).alias("text"))
    return parts.agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("locale", "text"))), lambda x: x["text"]), ","), F.lit("}")).alias("text"))


#: The file that names the version in force of the files below a folder.
POINTER = "current"


def write_all(outputs: dict[str, DataFrame], folder: str) -> None:
    """Write texts (one column ``text``) to several paths below a folder: all of them change, or none.

    Everything goes to a new version's folder first. Then the pointer file that names the version in force is
    replaced, in one rename; a failure before that leaves all files as they were. See :func:`current`.
    Versions before the last one are removed.
    """
    spark: SparkSession = next(iter(outputs.values())).sparkSession
    root, version = folder.rstrip("/"), f"v-{uuid.uuid4().hex}"
    for name, rows in outputs.items():
        rows.select("text").coalesce(1).write.text(f"{root}/{version}/{name}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    path, conf = hadoop.Path, spark._jsc.hadoopConfiguration()
    before = _version(spark, root)
    fs = path(root).getFileSystem(conf)
    new = path(f"{root}/_{version}")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    over = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(path(f"{root}/{POINTER}")), over)
    for status in fs.listStatus(path(root)):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            fs.delete(status.getPath(), True)


def _version(spark: SparkSession, root: str) -> str | None:
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    if not pointer.getFileSystem(spark._jsc.hadoopConfiguration()).exists(pointer):
        return None
    return spark.read.text(f"{root}/{POINTER}").first()["value"]


def current(spark: SparkSession, folder: str, name: str) -> str:
    """Where the files that :func:`write_all` wrote last under a name stand."""
    root = folder.rstrip("/")
    version = _version(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing was written to {folder}")
    return f"{root}/{version}/{name}"


def registry_lines(keys: DataFrame) -> DataFrame:
    """The key registry: each declared key with its shape, in order."""
    return keys.select("key", F.concat_ws("\t", "key", "shape", "target").alias("text")).orderBy("key")


def defaults_lines(keys: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The declared keys' default values: key and canonical JSON, in order."""
    own = snapshot.where("locale = 'default'").join(keys.select("key"), "key", "left_semi")
    return own.orderBy("key").select(F.concat_ws("\t", "key", js.canonical_json(F.col("value_json"))).alias("text"))


def resolved_lines(resolved: DataFrame) -> DataFrame:
    """Resolved values: key, locale and canonical JSON, in order."""
    return resolved.where("value_json is not null").orderBy("key", "locale").select(F.concat_ws("\t", "key", "locale", js.canonical_json(F.col("value_json"))).alias("text"))


def generated_table(resolved: DataFrame, entries: DataFrame | None = None, statuses: DataFrame | None = None) -> DataFrame:
    """``key, value_json, source_hash, state``: resolved values, filtered by entries, with their approval where statuses are given."""
    own = resolved if entries is None else by_entries(resolved, entries)
    own = own.select("key", js.canonical_json(F.col("value_json")).alias("value_json"), source_hash(F.col("value_json")).alias("source_hash"))
    if statuses is None:
        return own.withColumn("state", F.lit(None).cast("string")).orderBy("key")
    return own.join(statuses.select("key", "state"), "key", "left").withColumn("state", F.coalesce("state", F.lit("proposed"))).orderBy("key")
