"""Set operations on what a project declares: scopes, merges, splits, renames and removals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versotext.functions import js
from versotext.operators.rules import template_of
from versotext.schema import Descriptor


def by_entries(rows: DataFrame, entries: DataFrame, key_col: str = "key") -> DataFrame:
    """Rows whose key is an entry or begins with an entry that ends in '.' or '_'.

    A key's prefixes are few, so they meet the entries by equi-join.
    """
    ends = F.filter(F.sequence(F.lit(1), F.length(key_col)), lambda i: F.col(key_col).substr(i, F.lit(1)).isin(".", "_") | (i == F.length(key_col)))
    cuts = F.array_distinct(F.concat(F.transform(ends, lambda i: F.col(key_col).substr(F.lit(1), i)), F.array(key_col)))
    hits = rows.select(key_col).distinct().select(key_col, F.explode(cuts).alias("entry")).join(entries.select("entry").distinct(), "entry")
    fits = hits.where((F.col("entry") == F.col(key_col)) | F.col("entry").rlike("[._]$"))
    return rows.join(fits.select(key_col).distinct(), key_col, "left_semi")


def longest_prefix(keys: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``key, prefix``: the longest given prefix of each key, null where none fits."""
    cuts = keys.select("key").distinct().select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.col("key").substr(F.lit(1), i))).alias("prefix"))
    best = cuts.join(prefixes.select("prefix").distinct(), "prefix").groupBy("key").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return keys.join(best, "key", "left").select("key", "prefix")


def shipped_scope(versions: DataFrame, shipping: DataFrame) -> DataFrame:
    """All rows that aren't drafts, and the drafts (key, locale) that are shipped."""
    drafts = versions.where("state = 'draft'").join(shipping.select("key", "locale").distinct(), ["key", "locale"], "left_semi")
    return versions.where("state <> 'draft'").unionByName(drafts.select(versions.columns))


def with_siblings(d: Descriptor, keys: DataFrame) -> DataFrame:
    """The keys, all slots of their templates, and the footer address where a template is meant."""
    own = template_of(keys.select("key").distinct(), d.templates)
    slots = own.select("template").distinct().join(d.templates.select("template", F.explode("slots").alias("slot")), "template").select(F.concat("template", F.lit("__"), "slot").alias("key"))
    footer = own.limit(1).select(F.lit("brand__footer_address").alias("key"))
    return keys.select("key").unionByName(slots).unionByName(footer).distinct()


def pages_of(d: Descriptor, keys: DataFrame) -> DataFrame:
    """Pages the keys (ord, key) render on, in order of first appearance."""
    seen = keys.join(d.keys.select("key", F.posexplode("pages").alias("pos", "page")), "key")
    return seen.groupBy("page").agg(F.min(F.struct("ord", "pos")).alias("first")).orderBy("first").select("page")


def _renamed(c: str, names: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.join(names.select(F.col("old_key").alias(c), F.col("new_key").alias("__new")), c, "left").withColumn(c, F.coalesce("__new", F.col(c))).drop("__new").select(rows.columns)


def rename_keys(d: Descriptor, snapshot: DataFrame, names: DataFrame) -> tuple[Descriptor, DataFrame]:
    """Descriptor and snapshot with keys renamed (old_key, new_key): derivations and page references follow."""
    keys = _renamed("derives_from", names, _renamed("key", names, d.keys))
    refs = names.select(F.map_from_entries(F.collect_list(F.struct("old_key", "new_key"))).alias("__m"))
    pages = d.pages.join(F.broadcast(refs))  # one row: the renames of one command
    new = lambda c: F.coalesce(F.element_at("__m", c), c)
    fields = ("title", "description", "robots", "canonical", "og_image", "og_image_alt")
    seo = F.when(F.col("seo").isNotNull(), F.struct(*[F.when(F.col(f"seo.{f}").isNotNull(), new(F.col(f"seo.{f}"))).alias(f) for f in fields]))
    bindings = F.when(F.col("json_ld").isNotNull(), F.struct(F.col("json_ld.type").alias("type"), F.transform_values("json_ld.bindings", lambda _, v: new(v)).alias("bindings")))
    pages = pages.withColumn("seo", seo).withColumn("json_ld", bindings).select(d.pages.columns)
    return Descriptor(keys, pages, d.templates), _renamed("key", names, snapshot)


def merge_faults(d: Descriptor, snapshot: DataFrame, merges: DataFrame) -> DataFrame:
    """``gone, survivor, reason`` of merges (gone, survivor) that must be refused: shape, target, tags or a value differ."""
    k = d.keys.select("key", "shape", "target", "tags")
    values = snapshot.groupBy("key").agg(F.to_json(F.array_sort(F.collect_list(F.struct("locale", js.canonical_json(F.col("value_json")).alias("v"))))).alias("vals"))
    side = lambda name: k.join(values, "key", "left").select(F.col("key").alias(name), F.col("shape").alias(f"{name}_shape"), F.col("target").alias(f"{name}_target"), F.col("tags").alias(f"{name}_tags"), F.col("vals").alias(f"{name}_values"))
    both = merges.join(side("gone"), "gone", "left").join(side("survivor"), "survivor", "left")
    reason = F.when(F.col("gone_shape").isNull() | F.col("survivor_shape").isNull(), "unknown_key")
    for f in ("shape", "target", "tags", "values"):
        reason = reason.when(~F.col(f"gone_{f}").eqNullSafe(F.col(f"survivor_{f}")), f)
    return both.select("gone", "survivor", reason.alias("reason")).where("reason is not null")


def merge_keys(d: Descriptor, snapshot: DataFrame, merges: DataFrame) -> tuple[Descriptor, DataFrame]:
    """The survivors keep their values and take over pages, derivations and references of the keys that go."""
    names = merges.select(F.col("gone").alias("old_key"), F.col("survivor").alias("new_key"))
    taken = d.keys.join(names, d.keys["key"] == names["old_key"]).groupBy("new_key").agg(F.flatten(F.collect_list(F.coalesce("pages", F.array().cast("array<string>")))).alias("__more"))
    kept = d.keys.join(names.select(F.col("old_key").alias("key")), "key", "left_anti").join(taken.withColumnRenamed("new_key", "key"), "key", "left")
    kept = kept.withColumn("pages", F.when(F.col("__more").isNotNull(), F.array_union(F.coalesce("pages", F.array().cast("array<string>")), F.col("__more"))).otherwise(F.col("pages"))).select(d.keys.columns)
    out, _ = rename_keys(Descriptor(kept, d.pages, d.templates), snapshot.limit(0), names)
    return out, snapshot.join(names.select(F.col("old_key").alias("key")), "key", "left_anti").select(snapshot.columns)


def split_key(d: Descriptor, snapshot: DataFrame, key: str, new_key: str) -> tuple[Descriptor, DataFrame]:
    """A copy of a key and its values under a new name."""
    copy = d.keys.where(F.col("key") == key).withColumn("key", F.lit(new_key)).select(d.keys.columns)
    values = snapshot.where(F.col("key") == key).withColumn("key", F.lit(new_key)).select(snapshot.columns)
    return Descriptor(d.keys.unionByName(copy), d.pages, d.templates), snapshot.unionByName(values)


def remove_keys(d: Descriptor, snapshot: DataFrame, resolved: DataFrame, gone: DataFrame) -> tuple[Descriptor, DataFrame, DataFrame]:
    """Descriptor and snapshot without the keys (key), and what still refers to them.

    Keys deriving from a removed one get their derived text (from ``resolved``) as a committed value in each
    locale. Page references to removed keys are dropped. Template slots that name one are left and
    reported: rows in the third table refuse the removal.
    """
    out = gone.select("key").distinct()
    kept = d.keys.join(out, "key", "left_anti")
    orphaned = kept.join(out.withColumnRenamed("key", "derives_from"), "derives_from", "left_semi").select("key")
    frozen = resolved.where("source = 'derived'").join(orphaned, "key", "left_semi").select("locale", "key", "value_json")
    free = orphaned.withColumn("__o", F.lit(True))
    keys = kept.join(free, "key", "left").withColumn("derives_from", F.when(F.col("__o"), F.lit(None)).otherwise(F.col("derives_from"))).withColumn("tmpl", F.when(F.col("__o"), F.lit(None)).otherwise(F.col("tmpl"))).select(d.keys.columns)
    refs = out.agg(F.collect_set("key").alias("__g"))  # the keys of one command
    fields = ("title", "description", "robots", "canonical", "og_image", "og_image_alt")
    keep = lambda c: F.when(~F.array_contains("__g", c), c)
    seo = F.when(F.col("seo").isNotNull(), F.struct(*[keep(F.col(f"seo.{f}")).alias(f) for f in fields]))
    bindings = F.when(F.col("json_ld").isNotNull(), F.struct(F.col("json_ld.type").alias("type"), F.map_filter("json_ld.bindings", lambda _, v: ~F.array_contains("__g", v)).alias("bindings")))
    pages = d.pages.join(F.broadcast(refs)).withColumn("seo", seo).withColumn("json_ld", bindings).select(d.pages.columns)
    left = snapshot.join(out, "key", "left_anti").select("locale", "key", "value_json")
    values = left.join(frozen.select("locale", "key"), ["locale", "key"], "left_anti").unionByName(frozen)
    slots = d.templates.select("template", F.explode("slots").alias("slot")).withColumn("key", F.concat("template", F.lit("__"), "slot")).join(out, "key", "left_semi").select(F.lit("slot").alias("kind"), F.col("template").alias("holder"), F.col("key").alias("missing"))
    return Descriptor(keys, pages, d.templates), values, slots


def import_rows(table: DataFrame, only: DataFrame | None = None, placeholders: bool = False) -> DataFrame:
    """``key, value_json`` of copy-table entries (key, entry_json): a string, a [value, meta] pair or {"value": ...}."""
    from versotext.functions.text import to_double_braces

    kind = js.json_kind(F.col("entry_json"))
    value = F.when(kind == "array", F.element_at(js.json_list(F.col("entry_json")), 1)).when(kind == "object", F.element_at(js.json_object(F.col("entry_json")), F.lit("value"))).when(kind == "string", F.col("entry_json"))
    out = table.select("key", value.alias("value_json")).where("value_json is not null")
    if only is not None:
        out = by_entries(out, only)
    return out.withColumn("value_json", F.when(js.json_kind(F.col("value_json")) == "string", to_double_braces(F.col("value_json"))).otherwise(F.col("value_json"))) if placeholders else out
