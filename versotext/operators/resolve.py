"""Which value is in force for a key: draft, published, derived or committed, by locale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versotext.functions import js
from versotext.functions.text import plain_of
from versotext.lineage import settled
from versotext.operators.rules import fits_shape
from versotext.schema import Descriptor

WARNING = "struct<code:string,key:string,locale:string,reason:string>"
NO_WARNINGS = f"array<{WARNING}>"


def locale_chain(requests: DataFrame) -> DataFrame:
    """``requests`` with a row for each step of its locale's chain: the locale itself, then default."""
    chain = F.when(F.col("locale") == "default", F.array(F.lit("default"))).otherwise(F.array(F.col("locale"), F.lit("default")))
    return requests.select("*", F.posexplode(chain).alias("chain_rank", "row_locale"))


def latest_active(versions: DataFrame) -> DataFrame:
    """The live row of each (project, key, locale): published, not marked inactive, highest id; a missing id counts as 0."""
    live = versions.where((F.col("state") == "published") & F.coalesce(F.col("is_active"), F.lit(True)))
    order = Window.partitionBy("project", "key", "locale").orderBy(F.coalesce(F.col("id"), F.lit(0)).desc())
    return live.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def first_in_chain(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each group by the given ranks."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")


def _stored(d: Descriptor, versions: DataFrame, preview: bool) -> DataFrame:
    """Candidates (key, row_locale, source_rank, value_json, version, ok, reason) of one project's rows."""
    active = latest_active(versions).select("key", F.col("locale").alias("row_locale"), F.lit(1).alias("source_rank"), "value_json", F.col("id").alias("version"))
    if preview:
        drafts = versions.where("state = 'draft'").groupBy("key", "locale").agg(F.min_by(F.struct("value_json", "id"), F.coalesce("id", F.lit(0))).alias("r"))
        active = active.unionByName(drafts.select("key", F.col("locale").alias("row_locale"), F.lit(0).alias("source_rank"), F.col("r.value_json").alias("value_json"), F.col("r.id").alias("version")))
    shapes = d.keys.select("key", "shape", "values")
    joined = active.join(shapes, "key", "left")
    return joined.select("key", "row_locale", "source_rank", "value_json", "version", fits_shape(F.col("shape"), F.col("values"), F.col("value_json")).alias("ok"), F.coalesce("shape", F.lit("unknown")).alias("shape"))


def _base(d: Descriptor, snapshot: DataFrame, versions: DataFrame, requests: DataFrame, preview: bool) -> DataFrame:
    """For each request: its usable stored value, its snapshot value, its derivation edge, and warnings of rows passed over."""
    chained = locale_chain(requests.select("key", "locale").distinct())
    rank = F.struct("source_rank", "chain_rank")
    found = chained.join(_stored(d, versions, preview), ["key", "row_locale"])
    best = found.groupBy("key", "locale").agg(
        F.min_by(F.struct("value_json", "version", "source_rank", "row_locale"), F.when(F.col("ok"), rank)).alias("stored"),
        F.min(F.when(F.col("ok"), rank)).alias("stored_rank"),
        F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("source_rank", "chain_rank", "row_locale", "shape")))).alias("bad"),
    )
    committed = chained.join(snapshot.select("key", F.col("locale").alias("row_locale"), F.col("value_json").alias("committed")), ["key", "row_locale"]).where("committed is not null")
    committed = committed.groupBy("key", "locale").agg(F.min_by("committed", "chain_rank").alias("committed"))
    edges = d.keys.select("key", F.when(F.col("tmpl").isNotNull(), F.col("derives_from")).alias("derives_from"), "tmpl", F.col("tags").isNotNull().alias("tagged"))
    out = requests.select("key", "locale").distinct().join(best, ["key", "locale"], "left").join(committed, ["key", "locale"], "left").join(edges, "key", "left")
    passed = F.filter("bad", lambda b: F.col("stored_rank").isNull() | (F.struct(b["source_rank"], b["chain_rank"]) < F.col("stored_rank")))
    warn = F.transform(passed, lambda b: F.struct(F.lit("malformed_value").alias("code"), F.col("key").alias("key"), b["row_locale"].alias("locale"), F.concat(F.lit("stored value fails the declared "), b["shape"], F.lit(" shape")).alias("reason")))
    has = F.col("stored_rank").isNotNull()
    return out.select(
        "key", "locale", F.when(has, F.col("stored.value_json")).alias("stored"), F.when(has, F.col("stored.version")).alias("version"),
        F.when(has, F.when(F.col("stored.source_rank") == 0, "draft").otherwise("active")).alias("stored_source"), "committed", "derives_from", "tmpl",
        F.coalesce("tagged", F.lit(False)).alias("tagged"), F.coalesce(warn, F.array()).cast(NO_WARNINGS).alias("own_warnings"),
    )


def fill(tmpl: Column, text: Column) -> Column:
    """The template with the text in place of its first ``{v}``."""
    at = F.locate("{v}", tmpl)
    return F.when(at == 0, tmpl).otherwise(F.concat(tmpl.substr(F.lit(1), at - 1), text, tmpl.substr(at + 3, F.length(tmpl))))


def resolve(d: Descriptor, snapshot: DataFrame, versions: DataFrame, requests: DataFrame, preview: bool = False, deepest: int = 64) -> DataFrame:
    """``key, locale, value_json, source, version, warnings`` of each requested (key, locale).

    The order is: preview draft by locale chain, live version by chain, derivation,
    snapshot by chain. A stored value that doesn't fit its key's shape is passed over with a
    warning. A derivation takes its source's resolution in the same locale; a key met
    twice on the way falls back to the snapshot of that key, with a warning.

    Requests with a value of their own end at once; the others walk together, a join for each step, and
    what a step leaves is settled, so no step is computed twice and the plan doesn't grow with the depth.
    Chains are as long as the descriptor makes them, and longer than ``deepest`` raises. Versions are one project's rows.
    """
    # sources of requested keys may be any declared key, in the requested locales
    wanted = requests.select("key", "locale").distinct()
    sources = d.keys.where("derives_from is not null and tmpl is not null").select(F.col("derives_from").alias("key")).distinct().join(F.broadcast(wanted.select("locale").distinct()))  # a project has few locales
    base = settled(_base(d, snapshot, versions, wanted.unionByName(sources).distinct(), preview))
    step = base.select(F.col("key").alias("cur"), "locale", "stored", "committed", "derives_from", "tmpl", "tagged", "own_warnings")
    path_type = "array<struct<key:string,tmpl:string,committed:string,tagged_source:boolean>>"
    state = wanted.select("key", "locale", F.col("key").alias("cur"), F.array().cast(path_type).alias("path"), F.array().cast("array<string>").alias("seen"), F.array().cast(NO_WARNINGS).alias("warnings"))
    done = None
    for _ in range(deepest):
        at = state.join(step, ["cur", "locale"], "left")
        if done is not None:  # the first step reads what is settled already
            at = settled(at)
        walked = F.concat("warnings", F.coalesce("own_warnings", F.array().cast(NO_WARNINGS)))
        cycle = F.array_contains("seen", F.col("cur"))
        goes = F.col("stored").isNull() & F.col("derives_from").isNotNull() & ~cycle
        cycled = F.col("stored").isNull() & F.col("derives_from").isNotNull() & cycle
        warned = F.when(cycled, F.concat(walked, F.array(F.struct(F.lit("derivation_cycle").alias("code"), F.col("cur").alias("key"), F.col("locale").alias("locale"), F.concat(F.lit('derivation cycle through "'), "derives_from", F.lit('"')).alias("reason"))))).otherwise(walked)
        at = at.withColumn("__goes", goes)
        ended = at.where(~F.col("__goes")).select("key", "locale", "path", F.coalesce("stored", "committed").alias("end"), F.when(F.col("stored").isNull() & F.col("committed").isNull(), F.concat(warned, _no_value(F.col("cur")))).otherwise(warned).alias("warnings"), F.col("tagged").alias("end_tagged"))
        done = ended if done is None else done.unionByName(ended)
        going = at.where(F.col("__goes"))
        if going.isEmpty():
            break
        state = going.select("key", "locale", F.col("derives_from").alias("cur"), F.concat("path", F.array(F.struct(F.col("cur").alias("key"), "tmpl", "committed", F.col("tagged").alias("tagged_source")))).alias("path"), F.concat("seen", F.array("cur")).alias("seen"), walked.alias("warnings"))
    else:
        raise ValueError(f"a derivation is longer than {deepest} steps")

    def outward(acc: Column, p: Column) -> Column:
        text = js.as_text(acc["value"])
        plain = F.when(acc["tagged"], plain_of(text)).otherwise(text)
        derived = F.when(acc["value"].isNotNull(), js.to_json_string(fill(p["tmpl"], plain)))
        missing = acc["value"].isNull() & p["committed"].isNull()
        return F.struct(F.coalesce(derived, p["committed"]).alias("value"), p["tagged_source"].alias("tagged"), acc["value"].isNotNull().alias("derived"), F.when(missing, F.concat(acc["missing"], F.array(p["key"]))).otherwise(acc["missing"]).alias("missing"))

    start = F.struct(F.col("end").alias("value"), F.coalesce("end_tagged", F.lit(False)).alias("tagged"), F.lit(False).alias("derived"), F.array().cast("array<string>").alias("missing"))
    final = done.withColumn("out", F.aggregate(F.reverse("path"), start, outward))
    final = final.select("key", "locale", F.col("out.value").alias("resolved"), (F.col("out.derived") & (F.size("path") > 0)).alias("derived"), F.concat("warnings", F.flatten(F.transform("out.missing", _no_value))).alias("warnings"))
    joined = final.join(base.select("key", "locale", "stored_source", "version"), ["key", "locale"])
    return joined.select("key", "locale", F.col("resolved").alias("value_json"), F.coalesce("stored_source", F.when(F.col("derived"), "derived").otherwise("snapshot")).alias("source"), "version", "warnings")


def _no_value(key: Column) -> Column:
    return F.array(F.struct(F.lit("no_value").alias("code"), key.alias("key"), F.col("locale").alias("locale"), F.lit("no stored, derived or committed value").alias("reason")))


def resolve_all(d: Descriptor, snapshot: DataFrame, versions: DataFrame, locales: list[str], preview: bool = False) -> DataFrame:
    """Every declared key in every given locale."""
    requests = d.keys.select("key", F.explode(F.array(*map(F.lit, locales))).alias("locale"))
    return resolve(d, snapshot, versions, requests, preview)


def masked(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Preview overrides: base rows without the overridden (key, locale), and the overrides as drafts."""
    kept = base.join(overrides.select("key", "locale").distinct(), ["key", "locale"], "left_anti")
    return kept.unionByName(overrides.withColumn("state", F.lit("draft")), allowMissingColumns=True).select(base.columns)


def listing(d: Descriptor, snapshot: DataFrame, versions: DataFrame, locale: str = "default") -> DataFrame:
    """Each declared key with its source, live version and whether a draft is pending."""
    resolved = resolve_all(d, snapshot, versions, [locale])
    chain = [locale, "default"] if locale != "default" else ["default"]
    drafts = versions.where((F.col("state") == "draft") & F.col("locale").isin(chain)).select("key").distinct().withColumn("draft_pending", F.lit(True))
    live = latest_active(versions.where(F.col("locale").isin(chain))).select("key", F.col("id").alias("live"), F.when(F.col("locale") == locale, 0).otherwise(1).alias("r"))
    live = live.groupBy("key").agg(F.min_by("live", "r").alias("live_version"))
    return resolved.join(live, "key", "left").join(drafts, "key", "left").select("key", "source", "value_json", "live_version", F.coalesce("draft_pending", F.lit(False)).alias("draft_pending"))


def get(d: Descriptor, snapshot: DataFrame, versions: DataFrame, key: str, locale: str = "default", preview: bool = False) -> DataFrame:
    """One key's resolution; no row for an undeclared key."""
    return resolve(d, snapshot, versions, d.keys.where(F.col("key") == key).select("key", F.lit(locale).alias("locale")), preview)


def diff_of(d: Descriptor, snapshot: DataFrame, versions: DataFrame, key: str, locale: str = "default") -> DataFrame:
    """A key's draft, live and committed values side by side."""
    now = get(d, snapshot, versions, key, locale).select("key", F.col("value_json").alias("live_json"))
    preview = get(d, snapshot, versions, key, locale, preview=True).select("key", F.col("value_json").alias("draft_json"), F.col("source").alias("draft_source"))
    committed = snapshot.where((F.col("key") == key) & F.col("locale").isin(locale, "default")).groupBy("key").agg(F.min_by("value_json", F.when(F.col("locale") == locale, 0).otherwise(1)).alias("committed_json"))
    return now.join(preview, "key").join(committed, "key", "left").select("key", "committed_json", "live_json", F.when(F.col("draft_source") == "draft", F.col("draft_json")).alias("draft_json"))


def accessor(d: Descriptor, resolved: DataFrame, requests: DataFrame, fallback: str | None = None) -> DataFrame:
    """Typed read: resolved values of the requests; an undeclared key fails the query, or takes ``fallback`` (JSON) if given."""
    known = requests.join(d.keys.select("key", "shape"), "key", "left").join(resolved.select("key", "locale", "value_json"), ["key", "locale"], "left")
    if fallback is not None:
        return known.select("key", "locale", "shape", F.coalesce("value_json", F.lit(fallback)).alias("value_json"))
    fail = F.raise_error(F.concat(F.lit("unknown key: "), "key")).cast("string")
    return known.select("key", "locale", "shape", F.when(F.col("shape").isNull(), fail).otherwise(F.col("value_json")).alias("value_json"))


def lookup(bundle: DataFrame, requests: DataFrame) -> DataFrame:
    """Value and version by locale alone: the locale's own entry, else default's."""
    found = locale_chain(requests).join(bundle.withColumnRenamed("locale", "row_locale"), ["key", "row_locale"])
    return found.groupBy("key", "locale").agg(F.min_by(F.struct("value_json", "version"), "chain_rank").alias("v")).select("key", "locale", "v.value_json", "v.version")


def pull(d: Descriptor, snapshot: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The snapshot to commit and the bundle to ship.

    The default locale takes each key's resolution; other locales only their own live row,
    else what was committed. Derived keys are left out of the snapshot but stand in the bundle.
    Versions stand only where the value is a live row's.
    """
    default = resolve_all(d, snapshot, versions, ["default"])
    shapes = d.keys.select("key", "shape", "values")
    own = latest_active(versions.where("locale <> 'default'")).join(shapes, "key").where(fits_shape(F.col("shape"), F.col("values"), F.col("value_json")))
    own = own.select("key", "locale", "value_json", F.col("id").alias("version"))
    kept = snapshot.where("locale <> 'default'").join(shapes.select("key"), "key", "left_semi").join(own.select("key", "locale"), ["key", "locale"], "left_anti").select("key", "locale", "value_json", F.lit(None).cast("long").alias("version"))
    first = default.where("value_json is not null").select("key", "locale", "value_json", F.when(F.col("source") == "active", F.col("version")).alias("version"))
    bundle = first.unionByName(own).unionByName(kept)
    derived = d.keys.where("derives_from is not null and tmpl is not null").select("key")
    return bundle.join(derived, "key", "left_anti").select("locale", "key", "value_json"), bundle.select("locale", "key", "value_json", "version")
