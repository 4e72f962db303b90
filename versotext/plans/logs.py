"""Registered queries of command logs, project files and near matches, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versotext.lineage import shared_folder
from versotext.operators import html, resolve, store
from versotext.operators import text as texts
from versotext.plans import roles
from versotext.plans.queries import query, table
from versotext.plans.roles import role, sql
from versotext.schema import CHANGESETS, KEY_DEFS, VERSIONS, Descriptor
from versotext.sources import files, sinks
from versotext.sources.files import _as

FIRST = 1 << 30
AT = "timestamp '2024-06-01 00:00:00'"


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


# --- command logs: for each customer a log whose outcome follows from its number ---------------------


def _log(customers: DataFrame, project: str, steps: list[tuple[str, str, str]]) -> DataFrame:
    """Commands (verb, arguments, editor), each an expression over ``n``, ten numbers apart for each customer; a null verb is none."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.expr(verb).alias("verb"), F.to_json(F.expr(args)).alias("args_json"), F.expr(editor).alias("editor")) for i, (verb, args, editor) in enumerate(steps)])
    rows = customers.selectExpr("c_custkey as n").select(F.expr(project).alias("project"), "n", F.explode(each).alias("s")).where("s.verb is not null")
    return rows.select("project", (F.col("n") * 10 + F.col("s.i")).alias("ord"), "s.verb", "s.args_json", "s.editor", F.expr(AT).alias("at"))


def _id(step: int) -> str:
    return f"({FIRST} + (n * 10 + {step}) * {store.BLOCK})"


def _replayed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    save = lambda v: f"named_struct('key', 'k' || n, 'value', '{v}' || n)"
    key = "named_struct('key', 'k' || n)"
    log = _log(table(spark, sf_dir, "customer"), "'p' || (n % 16)", [
        ("'save'", save("one "), "'ann'"), ("'publish'", key, "'ann'"), ("'save'", save("two "), "'ann'"),
        ("if(n % 4 = 0, 'save', 'publish')", save("no "), "if(n % 4 = 0, 'bob', 'ann')"), ("if(n % 4 = 0, 'discard', 'revert')", f"named_struct('key', if(n % 4 = 0, 'k' || n, null), 'version', if(n % 4 = 0, null, {_id(0)}))", "'cy'"),
        ("case n % 3 when 0 then 'rename' when 1 then 'publish' else 'save' end", "named_struct('key', if(n % 3 = 0, null, 'k' || n), 'old_key', if(n % 3 = 0, 'k' || n, null), 'new_key', if(n % 3 = 0, 'n' || n, null), 'value', if(n % 3 = 2, 'three ' || n, null))", "'dee'"),
        ("if(n % 3 = 0, 'rename', null)", "named_struct('old_key', 'x' || n, 'new_key', 'n' || n)", "'dee'"),
    ])
    return store.fold(spark.createDataFrame([], VERSIONS), spark.createDataFrame([], CHANGESETS), log, FIRST)


_N = "with c as (select c_custkey as n, case when c_custkey % 3 = 0 then 'n' || c_custkey else 'k' || c_custkey end as key from customer)"


@query(f"""
    {_N}
    select {_id(0)} as id, key, 'published' as state, n % 4 = 0 as is_active, '"one ' || n || '"' as value_json, null::varchar as reverted_from from c
    union all select {_id(2)}, key, 'published', false, '"two ' || n || '"', null from c where n % 4 <> 0
    union all select {_id(4)}, key, 'published', true, '"one ' || n || '"', {_id(0)}::varchar from c where n % 4 <> 0
    union all select {_id(5)}, key, 'draft', false, '"three ' || n || '"', null from c where n % 3 = 2
""")
def replayed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M5: versions after saves, publications, a refused save, discards, reverts and renames."""
    return _replayed(spark, sf_dir)["versions"].select("id", "key", "state", "is_active", "value_json", F.col("reverted_from").cast("string").alias("reverted_from"))


@query(f"""
    {_N},
    a as (select n, unnest([0, 1, 2, 3, 4, 5, 6]) as i from c)
    select n * 10 + i as ord,
      case i when 0 then 'save' when 1 then 'publish' when 2 then 'save' when 3 then case when n % 4 = 0 then 'save' else 'publish' end when 4 then case when n % 4 = 0 then 'discard' else 'revert' end
        when 5 then ['rename', 'publish', 'save'][1 + n % 3] else 'rename' end as verb,
      case i when 3 then case when n % 4 = 0 then 'draft_held:ann' end when 5 then case when n % 3 = 1 then 'no_draft:k' || n || ' (default)' end when 6 then 'key_taken:n' || n end as error,
      case i when 0 then {_id(0)}::varchar when 1 then {_id(0)}::varchar when 2 then {_id(2)}::varchar when 3 then case when n % 4 = 0 then 'null' else {_id(2)}::varchar end
        when 4 then case when n % 4 = 0 then {_id(2)}::varchar else {_id(4)}::varchar end
        when 5 then case n % 3 when 0 then case when n % 4 = 0 then '1' else '3' end when 1 then 'null' else {_id(5)}::varchar end else 'null' end as result
    from a where i < 6 or n % 3 = 0
""")
def replayed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M5: what each command answered."""
    return _replayed(spark, sf_dir)["answers"].select("ord", "verb", "error", F.col("result_json").alias("result"))


def _changed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A change for each customer: two drafts, scheduled, then abandoned, published and reverted, or cancelled."""
    change = f"named_struct('change', {_id(0)})"
    log = _log(table(spark, sf_dir, "customer"), "'q' || (n % 8)", [
        ("'open_change'", "named_struct('name', 'c' || n)", "'ann'"), ("'save'", f"named_struct('key', 'a' || n, 'value', 'new', 'change', {_id(0)})", "'ann'"), ("'save'", f"named_struct('key', 'b' || n, 'value', 'new', 'change', {_id(0)})", "'ann'"),
        ("'schedule_change'", f"named_struct('change', {_id(0)}, 'publish_at', '2030-01-01T00:00:00')", "'ann'"), ("case n % 3 when 0 then 'abandon_change' when 1 then 'publish_change' else 'schedule_change' end", change, "'bob'"),
        ("if(n % 3 = 1, 'save', 'abandon_change')", f"named_struct('key', if(n % 3 = 1, 'a' || n, null), 'value', if(n % 3 = 1, 'later', null), 'change', if(n % 3 = 1, null, {_id(9)}))", "'bob'"), ("if(n % 3 = 1, 'publish', null)", "named_struct('key', 'a' || n)", "'bob'"), ("if(n % 3 = 1, 'revert_change', null)", change, "'bob'"),
    ])
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey as n")
    old = c.selectExpr("2 * n + 1 as id", "'a' || n as key", "n").unionByName(c.where("n % 2 = 0").selectExpr("2 * n + 2 as id", "'b' || n as key", "n"))
    old = old.selectExpr("id", "'q' || (n % 8) as project", "key", "'default' as locale", "'\"old\"' as value_json", "'published' as state", "true as is_active")
    names = [f.name for f in spark.createDataFrame([], VERSIONS).schema]
    old = _as(old.select("*", *[F.lit(None).alias(x) for x in names if x not in old.columns]), VERSIONS)
    return store.fold(old, spark.createDataFrame([], CHANGESETS), log, FIRST)


_C = "with c as (select c_custkey as n from customer)"


@query(f"""
    {_C}
    select 2 * n + 1 as id, 'a' || n as key, 'published' as state, n % 3 <> 1 as is_active, '"old"' as value_json, null::varchar as changeset_id, null::varchar as reverted_from from c
    union all select 2 * n + 2, 'b' || n, 'published', n % 3 <> 1, '"old"', null, null from c where n % 2 = 0
    union all select {_id(1)}, 'a' || n, case when n % 3 = 1 then 'published' else 'draft' end, false, '"new"', {_id(0)}::varchar, null from c where n % 3 <> 0
    union all select {_id(2)}, 'b' || n, case when n % 3 = 1 then 'published' else 'draft' end, n % 3 = 1 and n % 2 = 1, '"new"', {_id(0)}::varchar, null from c where n % 3 <> 0
    union all select {_id(5)}, 'a' || n, 'published', true, '"later"', null, null from c where n % 3 = 1
    union all select {_id(7)}, 'b' || n, 'published', true, '"old"', null, (2 * n + 2)::varchar from c where n % 3 = 1 and n % 2 = 0
""")
def replayed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after changes were scheduled, cancelled, abandoned, published and reverted."""
    return _changed(spark, sf_dir)["versions"].select("id", "key", "state", "is_active", "value_json", F.col("changeset_id").cast("string").alias("changeset_id"), F.col("reverted_from").cast("string").alias("reverted_from"))


@query(f"""
    {_C}
    select {_id(0)} as id, case when n % 3 = 1 then 'published' else 'open' end as status, n % 3 = 1 as reverted, null::timestamp as publish_at,
      case when n % 3 = 1 then '[["a' || n || '", "default", "stale_active"], ["b' || n || '", "default", ' || case when n % 2 = 0 then {_id(7)}::varchar else '"no_prior_version"' end || ']]' end as answer
    from c where n % 3 <> 0
""")
def replayed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes themselves, and what their reversal answered."""
    out = _changed(spark, sf_dir)
    told = out["answers"].where("verb = 'revert_change'").select((F.lit(FIRST) + (F.col("ord") - 7) * store.BLOCK).alias("id"), F.col("result_json").alias("answer"))
    return out["changesets"].join(told, "id", "left").select("id", "status", F.col("reverted_at").isNotNull().alias("reverted"), "publish_at", "answer")


# --- project files: written to the shared folder and read back -----------------------------------------


@query(sql("snapshot") + " select locale, key, value_json from snapshot")
def snapshot_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot as one canonical JSON file, written with others at once."""
    folder = _folder(spark)
    sinks.write_all({"snapshot": sinks.snapshot_text(roles.snapshot(spark, sf_dir)), "registry": sinks.registry_lines(role(spark, sf_dir, "keys")).select("text")}, folder)
    return files.snapshot(spark, sinks.current(spark, folder, "snapshot"))


@query(sql("keys", "snapshot") + """
    select 'registry' as file, key || chr(9) || shape || chr(9) || target as text from keys
    union all select 'defaults', k.key || chr(9) || s.value_json from keys k join snapshot_default s using (key)
    union all select 'resolved', key || chr(9) || 'de' || chr(9) || value_json from snapshot_de where locale = 'de'
""")
def generated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: the key registry, the declared keys' default values and the resolved values, a line for each."""
    keys, snapshot = role(spark, sf_dir, "keys"), roles.snapshot(spark, sf_dir)
    folder = _folder(spark)
    sinks.write_all({"registry": sinks.registry_lines(keys).select("text"), "defaults": sinks.defaults_lines(keys, snapshot), "resolved": sinks.resolved_lines(snapshot.where("locale = 'de'"))}, folder)
    read = lambda name: spark.read.text(sinks.current(spark, folder, name)).select(F.lit(name).alias("file"), F.col("value").alias("text"))
    return read("registry").unionByName(read("defaults")).unionByName(read("resolved"))


@query("select 'n' || n_nationkey as holder, case when n_nationkey % 2 = 0 then 'text' else 'list' end as shape, case when n_nationkey % 3 = 0 then n_nationkey end as most, '/' || lower(n_name) as route, 't' || n_nationkey as title from nation")
def descriptor_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A descriptor file with a byte-order mark; keys and pages of it."""
    n = table(spark, sf_dir, "nation")
    key = F.expr("concat('\"n', n_nationkey, '\":{\"shape\":\"', if(n_nationkey % 2 = 0, 'text', 'list'), '\",\"target\":\"web\"', if(n_nationkey % 3 = 0, concat(',\"limits\":{\"max\":', n_nationkey, '}'), ''), '}')")
    page = F.expr("concat('\"n', n_nationkey, '\":{\"route\":\"/', lower(n_name), '\",\"seo\":{\"title\":\"t', n_nationkey, '\"}}')")
    text = n.agg(F.concat(F.lit("﻿{\"keys\":{"), F.array_join(F.collect_list(key), ","), F.lit("},\"pages\":{"), F.array_join(F.collect_list(page), ","), F.lit("},\"templates\":{}}")).alias("text"))
    folder = _folder(spark)
    sinks.write_all({"descriptor": text}, folder)
    d = files.descriptor(spark, sinks.current(spark, folder, "descriptor"))
    return d.keys.join(d.pages, d.keys["key"] == d.pages["page"]).select(F.col("key").alias("holder"), "shape", F.col("limits.max").alias("most"), "route", F.col("seo.title").alias("title"))


@query("select 'default' as locale, 'n' || n_nationkey as key, '\"' || n_name || '\"' as value_json, case when n_nationkey % 2 = 0 then n_nationkey end::bigint as version from nation")
def bundle_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: a bundle in its full form; every second key has a version."""
    n = table(spark, sf_dir, "nation")
    values, numbers = (F.array_join(F.collect_list(F.expr(e)), ",") for e in ("concat('\"n', n_nationkey, '\":\"', n_name, '\"')", "if(n_nationkey % 2 = 0, concat('\"n', n_nationkey, '\":', n_nationkey), null)"))
    text = n.agg(F.concat(F.lit("{\"values\":{\"default\":{"), values, F.lit("}},\"meta\":{\"version\":{\"default\":{"), numbers, F.lit("}}}}")).alias("text"))
    folder = _folder(spark)
    sinks.write_all({"bundle": text}, folder)
    return files.bundle(spark, sinks.current(spark, folder, "bundle")).select("locale", "key", "value_json", "version")


@query("select 'a' || c_custkey || '@x.example' as email, c_name || ', \"' || c_mktsegment || '\"' as note, case when c_custkey % 2 = 0 then '' else 'x' || c_custkey end as extra, 'csv' as form from customer union all select 'n' || n_nationkey, n_name, n_nationkey::varchar, 'json' from nation")
def contact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted CSV with a short column, and a JSON array."""
    folder = _folder(spark)
    c = table(spark, sf_dir, "customer").selectExpr("'a' || c_custkey || '@x.example' as email", "c_name || ', \"' || c_mktsegment || '\"' as note", "case when c_custkey % 2 = 0 then null else 'x' || c_custkey end as extra")
    c.write.option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\r").csv(f"{folder}/csv")
    sinks.write_all({"json": table(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(F.expr("named_struct('email', 'n' || n_nationkey, 'note', n_name, 'extra', n_nationkey)"))).alias("text"))}, folder)
    read = files.contacts_csv(spark, f"{folder}/csv").withColumn("form", F.lit("csv"))
    return read.unionByName(files.contacts_json(spark, sinks.current(spark, folder, "json")).select("email", "note", "extra", F.lit("json").alias("form")))


@query("select 'r=' || r_regionkey as folder, '<p>' || r_name || '</p>' || chr(10) as text from region")
def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents below a folder, by a glob; others beside them don't fit it."""
    folder = _folder(spark)
    rows = table(spark, sf_dir, "region").selectExpr("r_regionkey as r", "'<p>' || r_name || '</p>' as text")
    rows.write.partitionBy("r").text(f"{folder}/site/docs")
    rows.select("text").write.text(f"{folder}/site/other")
    found = files.documents(spark, f"{folder}/site", "docs/**/*.txt")
    return found.select(F.regexp_extract("path", "docs/(r=[0-9]+)/", 1).alias("folder"), "text")


# --- texts and copy -------------------------------------------------------------------------------------

_WORDS = "'we ' || case when c_custkey % 2 = 0 then 'bake' else 'sell' end || ' number ' || (c_custkey - c_custkey % 2) || ' and number ' || (c_custkey - c_custkey % 2) || ' every day'"


@query("select a.c_custkey as left_id, a.c_custkey + 1 as right_id from customer a join customer b on b.c_custkey = a.c_custkey + 1 where a.c_custkey % 2 = 0")
def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts one word apart, each with exactly one other."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", f"{_WORDS} as text")
    return texts.near_repeats(rows, rows, same=True)


@query("select a.c_custkey as short_id, a.c_custkey + 1 as long_id from customer a join customer b on b.c_custkey = a.c_custkey + 1 where a.c_custkey % 2 = 0 union all select b.c_custkey, b.c_custkey - 1 from customer b join customer a on a.c_custkey = b.c_custkey - 1 where b.c_custkey % 2 = 1")
def near_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that stand in a longer one with one word replaced."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", f"{_WORDS} as text")
    return texts.near_windows(rows, rows.selectExpr("id", "'so today ' || text || ' and rest after that' as text"))


_COPY = "'<html><head><title>T' || page_id || ' page</title><meta name=\"description\" content=\"About ' || page_id || '\"></head><body>\n<p>Hello <b>world</b> ' || page_id || '</p>\n<img src=\"a.png\" alt=\"Pic ' || page_id || '\">\n<ul><li>One &amp; two</li></ul><span>7</span><pre>Code</pre><em>{{only}}</em></body></html>'"


@query("""
    select page_id, 1 as line, 'text' as place, 0 as tags, 'T' || page_id || ' page' as text from pages
    union all select page_id, 1, 'meta:description', 0, 'About ' || page_id from pages
    union all select page_id, 2, 'text', 1, 'Hello <1>world</1> ' || page_id from pages
    union all select page_id, 3, '@alt', 0, 'Pic ' || page_id from pages
    union all select page_id, 4, 'text', 0, 'One & two' from pages
""")
def copy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2, H3, H5-H7: a document for each page; what is copy in it, with its line and tags."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(_COPY).alias("html"))
    return html.proposals(html.elements(pages)).select("page_id", "line", "place", "tags", "text")


@query("""
    with b as (select distinct event_type as base from events),
    free as (select base, n, row_number() over (partition by base order by n) as r from b, range(0, 200000) t(n) where n not in (3, 10) and not (n = 0 and base = 'click')),
    p as (select event_id, event_type as base, row_number() over (partition by event_type order by event_id) as r from events)
    select event_id, case when n = 0 then base else base || '_' || n end as name from p join free using (base, r)
""")
def clashing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are taken are passed over, and so is a name that is taken itself."""
    events = table(spark, sf_dir, "events")
    taken = events.select(F.explode(F.expr("array(event_type || '_3', event_type || '_10', if(event_type = 'click', event_type, event_type || '_3'))")).alias("name")).distinct()
    return texts.number_names(events.selectExpr("event_id as ord", "event_type as base"), taken).select(F.col("ord").alias("event_id"), "name")


_PHRASES = "repeat('x ', cast(c_custkey % 5 as int)) || 'so fresh bread here daily too, fresh bread hereby, fresh bread here'"


@query("select c_custkey as text_id, phrase_id, (2 * (c_custkey % 5) + p.place)::integer as place from customer, (values (2, 3), (1, 51)) p(phrase_id, place)")
def phrase_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where known phrases stand: leftmost, then longest, none over another, none touched by a letter."""
    known = spark.createDataFrame([(1, "fresh bread here"), (2, "fresh bread here daily"), (3, "bread here daily too"), (4, "short")], "id long, text string")
    return texts.contained_phrases(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(_PHRASES).alias("text")), known).withColumnRenamed("at", "place")


_TREE = "'<div id=\"d' || page_id || '\"><p>One</p>\n<P class=x>Two <b>x</b></div></em>\n<ul><li>a<br/>b</li></i></ul><i>open'"


@query("""
    select page_id, e.el_id, e.parent_id, e.tag, e.line, e.fault, case when e.tag = 'div' then 'd' || page_id end as id, e.above from pages, (values
      (0, null, 'div', 1, null, ''), (1, 0, 'p', 1, null, 'div'), (2, 0, 'p', 2, 'unclosed <p>', 'div'), (3, 2, 'b', 2, null, 'p,div'), (4, null, 'ul', 3, 'stray </i>', ''),
      (5, 4, 'li', 3, null, 'ul'), (6, 5, 'br', 3, null, 'li,ul'), (7, null, 'i', 3, 'unclosed <i>', '')) e(el_id, parent_id, tag, line, fault, above)
""")
def element_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1, H4: a document for each page: its elements, what is above them, and what can't be paired."""
    e = html.elements(table(spark, sf_dir, "pages").select("page_id", F.expr(_TREE).alias("html")))
    return e.select("page_id", "el_id", "parent_id", "tag", "line", "fault", F.element_at("attrs", F.lit("id")).alias("id"), F.array_join("ancestors", ",").alias("above"))


@query(sql("snapshot", "keys") + " select k.key, l.locale, coalesce(s.value_json, d.value_json) as value_json, 'snapshot' as source from keys k cross join (select unnest(['default', 'de']) as locale) l left join snapshot s on s.key = k.key and s.locale = l.locale left join snapshot d on d.key = k.key and d.locale = 'default'")
def snapshot_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project without a store reads what was committed."""
    d = roles.descriptor(spark, sf_dir)
    plain = Descriptor(_as(d.keys.withColumn("derives_from", F.lit(None).cast("string")), KEY_DEFS), d.pages, d.templates)
    versions, _ = files.empty_store(spark)
    return resolve.resolve_all(plain, roles.snapshot(spark, sf_dir), versions, ["default", "de"]).select("key", "locale", "value_json", "source")
