"""Differences between what is declared, stored, committed and published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versotext.functions import js
from versotext.schema import Descriptor


def missing_and_orphans(d: Descriptor, snapshot: DataFrame) -> DataFrame:
    """``side, key``: declared keys (not derived) without a default value, and committed keys that aren't declared."""
    derived = F.col("derives_from").isNotNull() & F.col("tmpl").isNotNull()
    missing = d.keys.where(~derived).select("key").join(snapshot.where("locale = 'default'").select("key"), "key", "left_anti")
    orphans = snapshot.select("key").distinct().join(d.keys.select("key"), "key", "left_anti")
    return missing.select(F.lit("missing").alias("side"), "key").unionByName(orphans.select(F.lit("orphan").alias("side"), "key")).orderBy("side", "key")


def set_difference(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` that ``right`` doesn't have, compared null-safe on the given columns."""
    l, r = left.alias("l"), right.select(*on).distinct().alias("r")
    condition = None
    for c in on:
        same = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        condition = same if condition is None else condition & same
    return l.join(r, condition, "left_anti")


def store_audit(keys: DataFrame, versions: DataFrame) -> DataFrame:
    """``kind, key, detail``: unseeded (declared, never stored), orphan (stored, not declared), target_drift (stored under another target)."""
    stored = versions.select("key", "target").distinct()
    unseeded = keys.select("key").join(stored.select("key"), "key", "left_anti").select(F.lit("unseeded").alias("kind"), "key", F.lit(None).cast("string").alias("detail"))
    orphans = stored.select("key").distinct().join(keys.select("key"), "key", "left_anti").select(F.lit("orphan").alias("kind"), "key", F.lit(None).cast("string").alias("detail"))
    drift = stored.join(keys.select("key", F.col("target").alias("declared")), "key").where("target <> declared").select(F.lit("target_drift").alias("kind"), "key", F.concat("target", F.lit(" -> "), "declared").alias("detail"))
    return unseeded.unionByName(orphans).unionByName(drift)


def freshness(files: DataFrame) -> DataFrame:
    """``state`` of generated files (path, source_hash, recorded_source_hash, content_hash, recorded_content_hash)."""
    state = F.when(F.col("content_hash") != F.col("recorded_content_hash"), "handEdited").when(F.col("source_hash") != F.col("recorded_source_hash"), "staleSource").otherwise("current")
    return files.select("path", state.alias("state"))


def adoption(places: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``class`` of places (place, key, text): adopted (the key holds this very text), diverged (another) or unadopted (no value)."""
    held = snapshot.where("locale = 'default'").select("key", js.json_string(F.col("value_json")).alias("held"))
    return places.join(held, "key", "left").select("place", "key", F.when(F.col("held").isNull(), "unadopted").when(F.col("held") == F.col("text"), "adopted").otherwise("diverged").alias("class"))


def reset_statuses(statuses: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Approvals (key, state, at, by) after a change: a key whose canonical default value changed is proposed again; new keys are proposed, absent ones go."""
    b = before.where("locale = 'default'").select("key", js.canonical_json(F.col("value_json")).alias("b"))
    a = after.where("locale = 'default'").select("key", js.canonical_json(F.col("value_json")).alias("a"))
    joined = a.join(b, "key", "left").join(statuses, "key", "left")
    same = F.col("a").eqNullSafe(F.col("b")) & F.col("state").isNotNull()
    return joined.select("key", F.when(same, F.col("state")).otherwise("proposed").alias("state"), F.when(same, F.col("at")).alias("at"), F.when(same, F.col("by")).alias("by"))


def approve(statuses: DataFrame, keys: DataFrame, at: Column, by: str) -> tuple[DataFrame, DataFrame]:
    """Statuses with the keys approved, and an answer for each: approved, already_approved or unknown."""
    asked = keys.select("key").distinct().withColumn("__a", F.lit(True))
    joined = statuses.join(asked, "key", "left")
    flips = F.col("__a") & (F.col("state") != "approved")
    out = joined.select("key", F.when(flips, "approved").otherwise(F.col("state")).alias("state"), F.when(flips, at).otherwise(F.col("at")).alias("at"), F.when(flips, F.lit(by)).otherwise(F.col("by")).alias("by"))
    answers = asked.join(statuses.select("key", "state"), "key", "left").select("key", F.when(F.col("state").isNull(), "unknown").when(F.col("state") == "approved", "already_approved").otherwise("approved").alias("answer"))
    return out, answers


def referential_faults(d: Descriptor) -> DataFrame:
    """``kind, holder, missing`` of every reference in the descriptor that names nothing."""
    keys = d.keys.select(F.col("key").alias("missing"))
    pages = d.pages.select(F.col("page").alias("missing"))
    seo = d.pages.select(F.col("page").alias("holder"), F.explode(F.array(*[F.col(f"seo.{f}") for f in ("title", "description", "robots", "canonical", "og_image", "og_image_alt")])).alias("missing"))
    refs = (
        d.keys.select(F.lit("derives_from").alias("kind"), F.col("key").alias("holder"), F.col("derives_from").alias("missing"))
        .unionByName(seo.select(F.lit("seo").alias("kind"), "holder", "missing"))
        .unionByName(d.pages.select(F.lit("json_ld").alias("kind"), F.col("page").alias("holder"), F.explode(F.map_values("json_ld.bindings")).alias("missing")))
        .unionByName(d.templates.select(F.lit("slot").alias("kind"), F.col("template").alias("holder"), F.explode("slots").alias("slot")).select("kind", "holder", F.concat("holder", F.lit("__"), "slot").alias("missing")))
    )
    to_pages = d.keys.select(F.lit("page").alias("kind"), F.col("key").alias("holder"), F.explode("pages").alias("missing")).unionByName(d.pages.select(F.lit("parent").alias("kind"), F.col("page").alias("holder"), F.col("parent").alias("missing")))
    return refs.where("missing is not null").join(keys, "missing", "left_anti").unionByName(to_pages.where("missing is not null").join(pages, "missing", "left_anti")).select("kind", "holder", "missing")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``locale, key, change``: added, removed or changed values, compared in canonical form."""
    b = before.select("locale", "key", js.canonical_json(F.col("value_json")).alias("b"))
    a = after.select("locale", "key", js.canonical_json(F.col("value_json")).alias("a"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed")
    return b.join(a, ["locale", "key"], "full_outer").where(~F.col("b").eqNullSafe(F.col("a"))).select("locale", "key", change.alias("change"))


def changed_keys(before: DataFrame, after: DataFrame, derived_before: DataFrame, derived_after: DataFrame) -> DataFrame:
    """Keys whose value differs in a locale, derived keys whose resolution (key, locale, value_json) does, and derived keys that are gone."""
    own = snapshot_diff(before, after).select("key")
    derived = snapshot_diff(derived_before.select("locale", "key", "value_json"), derived_after.select("locale", "key", "value_json")).select("key")
    return own.unionByName(derived).distinct()


def renames_in(before: DataFrame, after: DataFrame) -> DataFrame:
    """``old_key, new_key``: a leaving and an arriving key with equal values in every locale, where exactly one arriving key fits; of several leaving keys the first by name takes it."""
    def prints(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(F.col("key").alias(name)).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("locale", js.canonical_json(F.col("value_json")).alias("v"))))), 256).alias("print"))

    leaving = prints(before.join(after.select("key"), "key", "left_anti"), "old_key")
    arriving = prints(after.join(before.select("key"), "key", "left_anti"), "new_key")
    pairs = leaving.join(arriving.groupBy("print").agg(F.count("*").alias("n"), F.min("new_key").alias("new_key")).where("n = 1"), "print")
    first = Window.partitionBy("new_key").orderBy("old_key")
    return pairs.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("old_key", "new_key")


def document_drift(marked: DataFrame, resolved: DataFrame) -> DataFrame:
    """``file, key, drift`` of marked elements (file, key, text, tags): current, differs, unknown_mark or tag_count."""
    held = resolved.select("key", js.json_string(F.col("value_json")).alias("held"), F.lit(True).alias("__k"))
    count = F.size(F.regexp_extract_all("held", F.lit("<([0-9]+)/?>"), F.lit(1)))
    drift = F.when(F.col("__k").isNull(), "unknown_mark").when(F.coalesce("tags", F.lit(0)) != count, "tag_count").when(F.col("held") == F.col("text"), "current").otherwise("differs")
    return marked.join(held, "key", "left").select("file", "key", drift.alias("drift"))


def document_states(drift: DataFrame) -> DataFrame:
    return drift.groupBy("file").agg(F.when(F.bool_and(F.col("drift") == "current"), "current").otherwise("differs").alias("state"))


def uncarried(keys: DataFrame, marked: DataFrame) -> DataFrame:
    return keys.select("key").join(marked.select("key"), "key", "left_anti")


def auditable_pages(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Declared pages (page, route) with their file (path, route) where there is one, and files no page declares."""
    declared = pages.select("page", "route").join(files.select("path", "route"), "route", "left").select("page", "route", "path")
    return declared.unionByName(files.join(pages.select("route"), "route", "left_anti").select(F.lit(None).cast("string").alias("page"), "route", "path"))


def unrecorded_routes(routes: DataFrame, pages: DataFrame) -> DataFrame:
    return routes.join(pages.select("route"), "route", "left_anti")


def unread_slots(templates: DataFrame, reads: DataFrame) -> DataFrame:
    """Slots (template, slot) that the template's renderer never reads."""
    return templates.select("template", F.explode("slots").alias("slot")).join(reads.select("template", "slot"), ["template", "slot"], "left_anti")


#: Display modes that are no verdict.
NO_VERDICT = ("informative", "notApplicable", "manual", "error")


def failing_audits(audits: DataFrame) -> DataFrame:
    """Audits (run, audit, mode, score) below their mark: 0.9 for numeric ones, otherwise 1."""
    mark = F.when(F.col("mode") == "numeric", 0.9).otherwise(1.0)
    return audits.where(F.col("score").isNotNull() & ~F.col("mode").isin(*NO_VERDICT) & (F.col("score") < mark))


def median_runs(runs: DataFrame, group: list[str]) -> DataFrame:
    """The lower median of each group's scores (nulls dropped), as a whole percentage, and the first run that has it."""
    own = runs.where("score is not null")
    mid = own.groupBy(*group).agg(F.expr("percentile_disc(0.5) within group (order by score)").alias("median"))
    first = own.join(mid, group).where("score = median").groupBy(*group, "median").agg(F.min("run").alias("run"))
    return first.withColumn("percent", F.round(F.col("median") * 100).cast("int"))


def usage(keys: DataFrame, reads: DataFrame, causes: DataFrame | None = None) -> DataFrame:
    """``state`` of each key: read (by name or by the longest prefix read), unknown (something reads keys that can't be told) or not_found.

    ``reads`` holds file, key, prefix, cause, server; ``server_only`` tells whether every read is on the server.
    """
    exact = reads.where("key is not null").groupBy("key").agg(F.bool_and("server").alias("exact_server"))
    cuts = keys.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.col("key").substr(F.lit(1), i))).alias("prefix"))
    by_prefix = cuts.join(reads.where("prefix is not null").groupBy("prefix").agg(F.bool_and("server").alias("s")), "prefix").groupBy("key").agg(F.max_by("s", F.length("prefix")).alias("prefix_server"), F.max_by("prefix", F.length("prefix")).alias("by_prefix"))
    vague = reads.agg(F.count_if(F.col("key").isNull() & F.col("prefix").isNull()).alias("n"))
    joined = keys.select("key").join(exact, "key", "left").join(by_prefix, "key", "left").join(F.broadcast(vague))
    state = F.when(F.col("exact_server").isNotNull() | F.col("by_prefix").isNotNull(), "read").when(F.col("n") > 0, "unknown").otherwise("not_found")
    return joined.select("key", state.alias("state"), F.coalesce(F.least("exact_server", "prefix_server"), "exact_server", "prefix_server").alias("server_only"), "by_prefix")


def subtract_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return set_difference(findings, baseline, ["file", "context", "text"])
