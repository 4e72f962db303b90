"""Repeated and contained texts: exact duplicates, derivations, near matches, known phrases, names."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versotext.functions import js
from versotext.functions.text import word_bounded
from versotext.lineage import settled
from versotext.schema import Descriptor

#: A phrase must have so many characters to be looked for inside texts, a derivation's source as well.
PHRASE_MIN = 12
#: Words that both sides of a near match must have.
NEAR_MIN = 4
SEED = 4


def duplicate_texts(d: Descriptor, snapshot: DataFrame) -> DataFrame:
    """``text, keys``: default texts that several keys hold. Page references, template slots, tagged and brand keys don't count."""
    refs = d.pages.select(F.explode(F.array(*[F.col(f"seo.{f}") for f in ("title", "description", "robots", "canonical", "og_image", "og_image_alt")])).alias("key")).where("key is not null")
    slots = d.templates.select("template", F.explode("slots").alias("slot")).select(F.concat("template", F.lit("__"), "slot").alias("key"))
    keys = d.keys.where(F.col("tags").isNull() & ~F.col("key").startswith("brand__")).select("key").join(refs.unionByName(slots), "key", "left_anti")
    texts = snapshot.where("locale = 'default'").join(keys, "key", "left_semi").select("key", js.json_string(F.col("value_json")).alias("text")).where("text is not null")
    return texts.groupBy("text").agg(F.array_sort(F.collect_list("key")).alias("keys")).where(F.size("keys") > 1)


def text_register(snapshot: DataFrame) -> DataFrame:
    """``text, keys`` of every default text: the index that equal texts are joined on."""
    return snapshot.where("locale = 'default'").select("key", js.json_string(F.col("value_json")).alias("text")).where("text is not null").groupBy("text").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def derivations(texts: DataFrame) -> DataFrame:
    """``doc, key, source, tmpl``: the longest other text of the document that stands in a text as whole words.

    A source has at least PHRASE_MIN characters and half the text, unless the two are
    equal. Ties go to the smaller key. Candidates share the source's first word with the text.
    """
    word = lambda c: F.regexp_extract(c, "[\\p{L}\\p{N}]+", 0)
    inside = texts.select("doc", "key", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[\\p{L}\\p{N}]+"), F.lit(0)))).alias("w"))
    sources = texts.select("doc", F.col("key").alias("source"), F.col("text").alias("part"), word(F.col("text")).alias("w")).where(F.col("w") != "")
    pairs = inside.join(sources, ["doc", "w"]).where((F.col("key") != F.col("source")) & ((F.col("part") != F.col("text")) | (F.col("source") < F.col("key"))))
    pairs = pairs.where((F.col("part") == F.col("text")) | ((F.length("part") >= PHRASE_MIN) & (F.length("part") * 2 >= F.length("text")))).withColumn("at", word_bounded(F.col("part"), F.col("text"))).where("at >= 0")
    best = pairs.groupBy("doc", "key").agg(F.min_by(F.struct("source", "part", "text", "at"), F.struct(-F.length("part"), F.col("source"))).alias("b"))
    return best.select("doc", "key", "b.source", F.concat(F.col("b.text").substr(F.lit(1), F.col("b.at")), F.lit("{v}"), F.col("b.text").substr(F.col("b.at") + F.length("b.part") + 1, F.length("b.text"))).alias("tmpl"))


def words(text):
    return F.filter(F.split(F.lower(js.collapse(text)), " "), lambda w: w != "")


def near_repeats(left: DataFrame, right: DataFrame, same: bool = False) -> DataFrame:
    """``left_id, right_id``: texts (id, text) one word apart: equally many words, NEAR_MIN or more, exactly one of them another.

    If one word differs, the first or the second half of the words is equal: the join is on a
    half, so that only pairs that share one are compared.
    """
    def halves(rows: DataFrame, name: str) -> DataFrame:
        own = rows.select(F.col("id").alias(name), words(F.col("text")).alias(f"{name}_w")).where(F.size(f"{name}_w") >= NEAR_MIN)
        n = F.size(f"{name}_w")
        mid = F.floor(n / 2).cast("int")
        first = F.array_join(F.slice(f"{name}_w", F.lit(1), mid), " ")
        second = F.array_join(F.slice(f"{name}_w", mid + 1, n - mid), " ")
        return own.select(name, f"{name}_w", n.alias("n"), F.explode(F.array(F.struct(F.lit(0).alias("side"), first.alias("half")), F.struct(F.lit(1).alias("side"), second.alias("half")))).alias("h")).select(name, f"{name}_w", "n", "h.side", "h.half")

    pairs = halves(left, "left_id").join(halves(right, "right_id"), ["n", "side", "half"])
    if same:
        pairs = pairs.where("left_id < right_id")
    apart = F.size(F.filter(F.zip_with("left_id_w", "right_id_w", lambda a, b: a != b), lambda x: x))
    return pairs.where(apart == 1).select("left_id", "right_id").distinct()


def near_windows(short: DataFrame, long: DataFrame) -> DataFrame:
    """``short_id, long_id``: short texts that stand in a long one with exactly one word replaced.

    One half of the short text is whole, so its first words are looked up among the long text's
    word windows of that length by equi-join; the whole window is compared afterwards.
    """
    own = short.select(F.col("id").alias("short_id"), words(F.col("text")).alias("sw")).where(F.size("sw") >= NEAR_MIN).withColumn("n", F.size("sw"))
    mid = F.floor(F.col("n") / 2).cast("int")
    # of each half its first words, SEED at most, so that windows of few lengths are made
    seeds = F.array(*[F.struct(shift.alias("shift"), F.least(size, F.lit(SEED)).alias("len")) for shift, size in ((F.lit(0), mid), (mid, F.col("n") - mid))])
    parts = own.select("short_id", "sw", "n", F.explode(seeds).alias("p")).select("short_id", "sw", "n", "p.shift", "p.len", F.array_join(F.slice("sw", F.col("p.shift") + 1, F.col("p.len")), " ").alias("part"))
    lengths = parts.select("len").distinct()
    lw = long.select(F.col("id").alias("long_id"), words(F.col("text")).alias("lw"))
    windows = lw.join(F.broadcast(lengths)).where(F.size("lw") >= F.col("len"))  # few distinct lengths
    windows = windows.select("long_id", "lw", "len", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("lw") - F.col("len") + 1), lambda i: F.array_join(F.slice("lw", i, F.col("len")), " "))).alias("pos", "part")).select("long_id", "lw", "len", "pos", "part")
    met = windows.join(parts, ["len", "part"]).withColumn("begin", F.col("pos") - F.col("shift")).where((F.col("begin") >= 0) & (F.col("begin") + F.col("n") <= F.size("lw")))
    apart = F.size(F.filter(F.zip_with(F.slice("lw", F.col("begin") + 1, F.col("n")), F.col("sw"), lambda a, b: a != b), lambda x: x))
    return met.where(apart == 1).select("short_id", "long_id").distinct()


TOKEN = re.compile(r"[^\W_]+")


def contained_phrases(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """``text_id, phrase_id, at``: known phrases of PHRASE_MIN or more characters inside texts.

    Leftmost first, the longest at one place, none over another, none touched by a
    letter or digit. Phrases are found through their first word; which hits of a text stay is decided
    text by text.
    """
    word = F.regexp_extract(F.col("phrase"), "[\\p{L}\\p{N}]+", 0)
    known = phrases.select(F.col("id").alias("phrase_id"), F.col("text").alias("phrase")).where(F.length("phrase") >= PHRASE_MIN).withColumn("w", word).withColumn("lead", F.instr("phrase", F.col("w")) - 1).where(F.col("w") != "")
    firsts = known.select("w").distinct()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ws, ats, texts_ = [], [], [], []
            for i, t in zip(batch.column("text_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for m in TOKEN.finditer(t or ""):
                    ids.append(i)
                    ws.append(m[0])
                    ats.append(m.start())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ws, pa.string()), pa.array(ats, pa.int32())], ["text_id", "w", "at"])

    own = texts.select(F.col("id").cast("long").alias("text_id"), "text")
    # first places of a phrase's first word; only these go on, with the text joined back
    places = own.mapInArrow(tokens, "text_id long, w string, at int").join(firsts, "w", "left_semi")
    hits = places.join(known, "w").withColumn("begin", F.col("at") - F.col("lead")).where("begin >= 0")
    checked = hits.join(own, "text_id").where(F.col("text").substr(F.col("begin") + 1, F.length("phrase")) == F.col("phrase"))
    edge = lambda c: ~c.rlike("[\\p{L}\\p{N}]")
    before = F.when(F.col("begin") == 0, "").otherwise(F.col("text").substr(F.col("begin"), F.lit(1)))
    after = F.col("text").substr(F.col("begin") + F.length("phrase") + 1, F.lit(1))
    clean = checked.where((edge(before) | ~F.substring("phrase", 1, 1).rlike("[\\p{L}\\p{N}]")) & (edge(after) | ~F.substring("phrase", -1, 1).rlike("[\\p{L}\\p{N}]")))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["begin", "size", "phrase_id"], ascending=[True, False, True])
        end, kept = 0, []
        for row in pdf.itertuples(index=False):
            if row.begin >= end:
                kept.append((row.text_id, row.phrase_id, row.begin))
                end = row.begin + row.size
        return pd.DataFrame(kept, columns=["text_id", "phrase_id", "at"])

    return clean.select("text_id", F.col("phrase_id").cast("long"), "begin", F.length("phrase").alias("size")).distinct().groupBy("text_id").applyInPandas(choose, "text_id long, phrase_id long, at int")


def census(elements: DataFrame, values: DataFrame, small_bytes: int = 4 << 20) -> DataFrame:
    """``el_id, key``: which value each element shows: the same collapsed text, or a value with ``{{x}}`` whose fixed parts fit.

    Whole texts meet by equi-join. A value with variables is tried only on elements that hold its anchor:
    its longest fixed word, without one its first fixed character; a value of nothing but variables fits any text.
    Values with variables are broadcast up to ``small_bytes``, counted, and shuffled above. No other side is broadcast,
    whatever the planner takes its size for: it doesn't see that an element has a row for each of its words and characters.
    """
    e = elements.select("el_id", js.collapse(F.col("text")).alias("text"))
    v = values.select("key", js.collapse(F.col("text")).alias("value"))
    exact = e.join(v.where(~F.col("value").rlike(js.VARIABLE)).hint("merge"), F.col("text") == F.col("value")).select("el_id", "key")
    quoted = F.concat(F.lit("^\\Q"), F.regexp_replace(F.replace(F.col("value"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), js.VARIABLE, "\\\\E(.+)\\\\Q"), F.lit("\\E$"))
    vary = v.where(F.col("value").rlike(js.VARIABLE)).withColumn("pattern", quoted).withColumn("fixed", F.regexp_replace("value", js.VARIABLE, "\u0001"))
    words = F.filter(F.split("fixed", " "), lambda w: (w != "") & ~w.contains("\u0001"))
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    first = F.substring(F.regexp_replace("fixed", "[\u0001 ]", ""), 1, 1)
    anchored = vary.select("key", "pattern", F.coalesce(F.concat(F.lit("w"), longest), F.concat(F.lit("c"), first)).alias("anchor"))
    held = F.array_union(F.transform(F.split("text", " "), lambda w: F.concat(F.lit("w"), w)), F.array_append(F.transform(F.split(F.replace("text", F.lit(" "), F.lit("")), ""), lambda c: F.concat(F.lit("c"), c)), F.lit("c")))
    # only anchors that some value has go on, with the text joined back in the row itself
    places = e.where("text <> ''").select("el_id", "text", F.explode(held).alias("anchor"))
    size = anchored.agg(F.sum(F.lit(64) + F.octet_length("pattern") + F.octet_length("anchor") + F.coalesce(F.octet_length(F.col("key").cast("string")), F.lit(0)))).collect()[0][0] or 0
    fits = places.join(F.broadcast(anchored) if size <= small_bytes else anchored.hint("merge"), "anchor").where(F.expr("text rlike pattern")).select("el_id", "key")
    return exact.unionByName(fits).distinct()


def number_names(places: DataFrame, taken: DataFrame) -> DataFrame:
    """``name`` of each place (ord, base): its base if it's free, else ``base_1``, ``base_2`` ... past those taken.

    Order within a base is ``ord``. Bases meet in each other's numbers (``a`` and ``a_1``), so the bases of
    a stem are numbered together, one stem after the other, where several of them or taken numbers meet. All other bases are numbered
    by ranges of (base, ord): a range knows how many places of its first base come before it, so a frequent base isn't one task's.
    """
    stem = F.regexp_replace("base", "(_[0-9]+)+$", "")
    own = places.select("ord", "base", stem.alias("stem"), F.lit(None).cast("string").alias("name"))
    held = taken.select(F.lit(-1).cast("long").alias("ord"), F.lit(None).cast("string").alias("base"), F.regexp_replace("name", "(_[0-9]+)+$", "").alias("stem"), "name")
    stems = own.groupBy("stem").agg(F.min("base").alias("one"), F.max("base").alias("other"))
    near = held.join(stems, "stem").groupBy("stem").agg(F.bool_or(F.col("name") != F.col("one")).alias("numbers"), F.bool_or(F.col("name") == F.col("one")).alias("is_taken"))
    stems = settled(stems.join(near, "stem", "left").select("stem", ((F.col("one") != F.col("other")) | F.coalesce("numbers", F.lit(False))).alias("mixed"), F.coalesce("is_taken", F.lit(False)).alias("is_taken")))
    ranges = own.join(stems.where("not mixed"), "stem").select("ord", "base", "is_taken").repartitionByRange("base", "ord")
    ranges = settled(ranges.withColumn("part", F.spark_partition_id()))
    counts = ranges.groupBy("base", "part").agg(F.count("*").alias("n"))
    before = counts.select("base", "part", F.coalesce(F.sum("n").over(Window.partitionBy("base").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("base", "part").orderBy("ord")) - 1
    simple = ranges.withColumn("place", place).join(before, ["base", "part"]).withColumn("n", F.col("before") + F.col("place") + F.col("is_taken").cast("int"))
    simple = simple.select("ord", "base", F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("n").cast("string"))).alias("name"))
    mixed = stems.where("mixed").select("stem")

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        used = set(pdf.loc[pdf["ord"] < 0, "name"])
        following: dict[str, int] = {}
        out = []
        for row in pdf[pdf["ord"] >= 0].sort_values("ord").itertuples(index=False):
            name, n = row.base, following.get(row.base, 0)
            if n or name in used:
                n = max(n, 1)
                while f"{row.base}_{n}" in used:
                    n += 1
                name, n = f"{row.base}_{n}", n
            following[row.base] = n + 1 if n else 1
            used.add(name)
            out.append((row.ord, row.base, name))
        return pd.DataFrame(out, columns=["ord", "base", "name"])

    rest = own.unionByName(held).join(mixed, "stem", "left_semi").select(own.columns)
    return simple.unionByName(rest.groupBy("stem").applyInPandas(number, "ord long, base string, name string"))


def only_in_one(texts: DataFrame) -> DataFrame:
    """Texts (doc, text) that stand in exactly one document."""
    return texts.groupBy("text").agg(F.count_distinct("doc").alias("n"), F.min("doc").alias("doc")).where("n = 1").select("doc", "text")
