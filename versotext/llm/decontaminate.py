"""Benchmark decontamination: which documents hold which test items.

An item is in a document when at least ``percent`` of the item's distinct ``n``-word
shingles stand in it (containment of the item). Items are dealt into partitions
by their number of shingles (powers of two). A partition's MinHash sketch is the
k smallest shingle hashes of an item, with k the most shingles an item may miss plus
one, taken for the largest item of the partition. A document that holds the item must hold
one of them, so the search loses nothing; a hit is verified by counting the item's shingles in
the document, compared as text.

An item of fewer than ``n`` words is a single shingle, its whole sequence, and a document of
``n`` or more words has no shingle so short: such an item is found only in a document that
is nothing but the item, never inside a longer one.

Everything is DataFrame operations. The document side is one narrow pass: hashes
of the words, of each n of them, their intersection with all sketches. Only
documents that were hit go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words between ASCII white space; null and empty texts have none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, WHITE), lambda w: w != "")


def shingle_hashes(word_hashes: Column, n: int) -> Column:
    """A hash for each ``n`` words in a row; with fewer words one for the whole sequence, without words none."""
    size = F.size(word_hashes)
    places = F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1)))
    whole = F.transform(places, lambda i: F.xxhash64(*[F.get(word_hashes, i + (k - 1)) for k in range(n)]))
    return F.when(size > 0, whole).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(own: Column, n: int) -> Column:
    """The distinct shingles themselves, words joined by a space."""
    size = F.size(own)
    places = F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1)))
    return F.when(size > 0, F.array_distinct(F.transform(places, lambda i: F.concat_ws(" ", F.slice(own, i, F.lit(n)))))).otherwise(F.array().cast("array<string>"))


def item_sketches(items: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Of each item with words: item_id, n_item (shingles), partition, sketch (hashes) and shingles (text)."""
    own = items.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("item_id"), words(F.col(f"`{text_col}`").cast("string")).alias("w"))
    own = own.select("item_id", "w", F.transform("w", lambda w: F.xxhash64(w)).alias("wh"))
    own = own.select("item_id", shingle_texts(F.col("w"), n).alias("shingles"), F.array_sort(F.array_distinct(shingle_hashes(F.col("wh"), n))).alias("hashes"))
    own = own.withColumn("n_item", F.size("shingles")).withColumn("partition", F.floor(F.log2(F.col("n_item").cast("double"))).cast("int"))
    # the largest item of the partition has 2^(p+1) - 1 shingles
    most = F.pow(F.lit(2.0), F.col("partition") + 1) - 1
    k = (F.floor(most * (100 - percent) / 100) + 1).cast("int")
    return own.select("item_id", "n_item", "partition", F.slice("hashes", F.lit(1), k).alias("sketch"), "shingles")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 5, percent: int = 80, inline: int = 4096, small: int = 200_000, small_bytes: int = 64 << 20) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_common`` and ``n_item`` of each document and item it holds.

    Null and empty texts and items hold nothing and are held nowhere; rows with a null
    id on either side take no part; repeated rows (same ids) give one row, the one
    with the most common shingles. Other columns are ignored.

    Up to ``inline`` sketch hashes are intersected with each document in place; above,
    the documents' hashes are joined with them, broadcast up to ``small`` and shuffled above. The items'
    shingles are broadcast up to ``small_bytes`` of text and shuffled above. All ways give the same result.
    """
    sketches = item_sketches(items, item_id, item_text, n, percent)
    # outer forms: for an inner explode the optimizer infers a filter that evaluates all of this again, for each place
    hashes = sketches.select(F.explode_outer("sketch").alias("h"), "item_id").where("h is not null")
    known = [r["h"] for r in hashes.select("h").distinct().limit(inline + 1).collect()]
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("doc_id is not null and text is not null")
    # each step is a column of its own: several references keep the optimizer from evaluating it again for each place
    hashed = own.select("doc_id", "text", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("wh")).select("doc_id", "text", shingle_hashes(F.col("wh"), n).alias("hs"))
    if not known:
        return own.select("doc_id", F.lit(None).cast(items.schema[item_id].dataType).alias("item_id"), F.lit(0).alias("n_common"), F.lit(0).alias("n_item")).limit(0)
    # what is broadcast was counted; anything larger is shuffled
    near = lambda df, fits: F.broadcast(df) if fits else df
    length = F.aggregate("shingles", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    held = sketches.agg(F.sum(F.size("sketch")).alias("hashes"), F.sum(length).alias("bytes")).collect()[0]
    if len(known) <= inline:
        known = F.array(*map(F.lit, known))
        # the outer form: for the inner one the optimizer infers a filter that evaluates all of this twice
        hit = hashed.select("doc_id", "text", F.explode_outer(F.array_intersect("hs", known)).alias("h")).where("h is not null")
        candidates = hit.join(near(hashes, held["hashes"] <= small), "h").select("doc_id", "text", "item_id")
    else:
        found = hashed.select("doc_id", F.explode_outer(F.array_distinct("hs")).alias("h")).where("h is not null").join(near(hashes, held["hashes"] <= small), "h").select("doc_id", "item_id").distinct()
        candidates = own.join(found, "doc_id")
    # one row for each document and item before the texts are compared
    pairs = candidates.groupBy("doc_id", F.xxhash64("text").alias("t"), "item_id").agg(F.first("text").alias("text"))
    split = pairs.select("doc_id", "item_id", words(F.col("text")).alias("w")).select("doc_id", "item_id", shingle_texts(F.col("w"), n).alias("own"))
    joined = split.join(near(sketches.select("item_id", "n_item", "shingles"), held["bytes"] <= small_bytes), "item_id")
    counted = joined.select("doc_id", "item_id", "n_item", F.size(F.array_intersect("shingles", "own")).alias("n_common"))
    held = counted.where(F.col("n_common") * 100 >= F.col("n_item") * percent)
    return held.groupBy("doc_id", "item_id").agg(F.max("n_common").alias("n_common"), F.max("n_item").alias("n_item"))
