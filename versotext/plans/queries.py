"""Registered queries of the content operators over the star-schema test tables, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versotext.functions import js
from versotext.functions import text as tx
from versotext.operators import contacts, descriptor, drift, html, resolve, rules, seo, store, versions
from versotext.operators import text as texts
from versotext.plans import roles
from versotext.plans.roles import role, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = "2024-06-01 00:00:00"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            SQL[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- resolution -----------------------------------------------------------------------

_STORED = """,
live as (select key, locale, value_json, id from versions where state = 'published' and coalesce(is_active, true) qualify row_number() over (partition by key, locale order by id desc) = 1),
draft as (select key, locale, value_json, id from versions where state = 'draft' qualify row_number() over (partition by key, locale order by id) = 1),
req as (select key, l as locale from keys, (values ('default'), ('de')) t(l)),
chain as (select key, locale, locale as row_locale, 0 as r from req union all select key, locale, 'default', 1 from req where locale <> 'default'),
cand as (select c.key, c.locale, s.value_json, s.id, s.sr, c.r from chain c join (select *, 1 as sr from live {drafts}) s on s.key = c.key and s.locale = c.row_locale join keys k on k.key = c.key where k.shape = 'text'),
stored as (select * from cand qualify row_number() over (partition by key, locale order by sr, r) = 1),
comm as (select c.key, c.locale, s.value_json from chain c join snapshot s on s.key = c.key and s.locale = c.row_locale qualify row_number() over (partition by c.key, c.locale order by c.r) = 1),
own as (select req.key, req.locale, stored.value_json as sv, stored.id, stored.sr, comm.value_json as cv, k.derives_from as d from req join keys k using (key) left join stored using (key, locale) left join comm using (key, locale)),
res as (select o.key, o.locale, case when o.sv is not null then o.sv when o.d is not null and coalesce(s.sv, s.cv) is not null then '"about ' || trim(coalesce(s.sv, s.cv), '"') || ', again {{v}}"' else o.cv end as value_json,
  case when o.sr = 0 then 'draft' when o.sr = 1 then 'active' when o.d is not null and coalesce(s.sv, s.cv) is not null then 'derived' else 'snapshot' end as source, o.id as version from own o left join own s on s.key = o.d and s.locale = o.locale)
"""
_BASE = sql("versions", "keys", "snapshot")


@query(_BASE + _STORED.format(drafts="") + "select key, locale, value_json, source, version from res")
def resolve_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every declared key in two locales."""
    d = roles.descriptor(spark, sf_dir)
    out = resolve.resolve_all(d, roles.snapshot(spark, sf_dir), roles.versions(spark, sf_dir), ["default", "de"])
    return out.select("key", "locale", "value_json", "source", "version")


@query(_BASE + _STORED.format(drafts="union all select *, 0 as sr from draft") + "select key, locale, value_json, source, version from res")
def resolve_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 with drafts first."""
    d = roles.descriptor(spark, sf_dir)
    out = resolve.resolve_all(d, roles.snapshot(spark, sf_dir), roles.versions(spark, sf_dir), ["default", "de"], preview=True)
    return out.select("key", "locale", "value_json", "source", "version")


@query(_BASE + _STORED.format(drafts="") + """
    ,
    pend as (select distinct key
    from versions
    where state = 'draft' and locale = 'default'),
    lv as (select key, id
    from live
    where locale = 'default')
    select r.key, r.source, r.value_json, lv.id as live_version, pend.key is not null as draft_pending
    from res r
    left
    join lv on lv.key = r.key
    left
    join pend on pend.key = r.key
    where r.locale = 'default'
""")
def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9."""
    return resolve.listing(roles.descriptor(spark, sf_dir), roles.snapshot(spark, sf_dir), roles.versions(spark, sf_dir))


@query(_BASE + _STORED.format(drafts="") + """
    ,
    own_live as (select l.locale, l.key, l.value_json, l.id
    from live l
    join keys k using (key)
    where l.locale <> 'default' and k.shape = 'text')
    select 'default' as locale, key, value_json, case when source = 'active' then version end as version
    from res
    where locale = 'default' and value_json is not null
    union all
    select locale, key, value_json, id
    from own_live
    union all
    select s.locale, s.key, s.value_json, null
    from snapshot s
    join keys k using (key)
    where s.locale <> 'default' and not exists (select 1
    from own_live o
    where o.key = s.key and o.locale = s.locale)
""")
def pull_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bundle to ship."""
    return resolve.pull(roles.descriptor(spark, sf_dir), roles.snapshot(spark, sf_dir), roles.versions(spark, sf_dir))[1]


@query(sql("versions") + """
    select key, locale, id as version, value_json
    from versions
    where state = 'published' and is_active
    qualify row_number() over (partition by project, key, locale
    order by id desc) = 1
""")
def latest_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1."""
    return resolve.latest_active(roles.versions(spark, sf_dir)).select("key", "locale", F.col("id").alias("version"), "value_json")


@query(sql("snapshot") + ", o as (select key, locale, '\"x\"' as value_json from snapshot_de) select locale, key, value_json from snapshot s where not exists (select 1 from o where o.key = s.key and o.locale = s.locale) union all select locale, key, value_json from o")
def preview_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14."""
    base = roles.snapshot(spark, sf_dir)
    return resolve.masked(base, role(spark, sf_dir, "snapshot_de").withColumn("value_json", F.lit('"x"'))).select("locale", "key", "value_json")


@query(sql("snapshot", "keys") + """
    ,
    c as (select k.key, s.value_json, row_number() over (partition by k.key order by case when s.locale = 'de' then 0 else 1 end) as n
    from keys k
    join snapshot s on s.key = k.key and s.locale in ('de', 'default'))
    select key, 'de' as locale, value_json
    from c
    where n = 1
""")
def locale_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R12, W3."""
    bundle = roles.snapshot(spark, sf_dir).withColumn("version", F.lit(None).cast("long"))
    return resolve.lookup(bundle, role(spark, sf_dir, "keys").select("key", F.lit("de").alias("locale"))).select("key", "locale", "value_json")


# --- versions -----------------------------------------------------------------------------

@query(sql("versions") + """
    select id, key, last_value(case when state = 'published' then id end ignore nulls) over w as previous_id, last_value(case when state = 'published' then value_json end ignore nulls) over w as previous_value
    from versions window w as (partition by project, key, locale
    order by id rows between unbounded preceding and 1 preceding)
""")
def prior_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, W2."""
    rows = versions.with_previous(roles.versions(spark, sf_dir), ["project", "key", "locale"], "id", "value_json", F.col("state") == "published")
    return rows.select("id", "key", "previous_id", "previous_value")


@query("""
    with x as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by event_id) as b
    from events)
    select user_id, event_id, event_type
    from x
    where b is distinct
    from event_type
""")
def change_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4."""
    return versions.change_runs(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type").select("user_id", "event_id", "event_type")


@query(sql("versions") + " select id, key, value_json from versions where id < 5000 order by id desc limit 200")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1, O3: a top-k report."""
    return versions.newest_page(roles.versions(spark, sf_dir), limit=500, before=5000).select("id", "key", "value_json")


@query(sql("versions") + " select id, key from versions where id > 100 order by id limit 50")
def keyset_page_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: a top-k report of the default size."""
    return versions.oldest_page(roles.versions(spark, sf_dir), limit=float("nan"), after=100).select("id", "key")


@query(sql("versions") + " select id, key, locale, state from versions where project = 'p' and (is_active or state = 'draft') and key in ('k1', 'k2', 'k40', 'none') and locale in ('de', 'default')")
def read_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F4."""
    return versions.read(roles.versions(spark, sf_dir), "p", ["k1", "k2", "k40", "none"], "de", preview=True).select("id", "key", "locale", "state")


@query(sql("versions") + """
    select key, locale, state as status, is_active, value_json, id as version, case when state = 'draft' then strftime(publish_at, '%Y-%m-%dT%H:%M:%S.%gZ') end as publish_at, target, case when state = 'draft' then changeset_id end as changeset_id, editor, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') as created_at
    from versions
""")
def api_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8, D1."""
    return versions.api_rows(roles.versions(spark, sf_dir))


@query(sql("versions") + f" select id, key, changeset_id from versions where state = 'draft' and publish_at <= timestamp '{NOW}'")
def due_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5."""
    return versions.due_drafts(roles.versions(spark, sf_dir), F.to_timestamp(F.lit(NOW))).select("id", "key", "changeset_id")


@query(sql("versions") + """
    select key, locale, count(*) filter (is_active) as active, count(*) filter (state = 'draft') as drafts
    from versions
    group by project, key, locale
    having count(*) filter (is_active) > 1 or count(*) filter (state = 'draft') > 1
""")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store's unique indexes would refuse."""
    return versions.unique_violations(roles.versions(spark, sf_dir)).drop("project")


@query(sql("versions") + """
    select v.id, v.key, v.changeset_id, (select max(p.id)
    from versions p
    where p.key = v.key and p.locale = v.locale and p.state = 'published' and p.id < v.id) as previous_id
    from versions v
    where v.state = 'published' and v.changeset_id = 7
""")
def change_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6, A3: a change's members with their before-image."""
    return versions.change_members(roles.versions(spark, sf_dir), 7, published=True).select("id", "key", "changeset_id", "previous_id")


@query("select conv_id, turn, row_number() over (partition by conv_id, role order by turn)::integer as position, count(*) over (partition by conv_id, role) as siblings from conversations")
def sibling_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5."""
    return versions.sibling_position(table(spark, sf_dir, "conversations"), ["conv_id", "role"], "turn").select("conv_id", "turn", "position", "siblings")


# --- store transitions, set forms --------------------------------------------------------

_PUBLISHED = sql("versions") + """
    ,
    d as (select *
    from versions
    where state = 'draft'
    qualify row_number() over (partition by key, locale order by id desc) = 1),
    one as (select *
    from versions v
    where state <> 'draft' or exists (select 1 from d where d.id = v.id))
"""


def _one_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.versions(spark, sf_dir)
    newest = rows.where("state = 'draft'").groupBy("key", "locale").agg(F.max("id").alias("id"))
    return rows.where("state <> 'draft'").unionByName(rows.join(newest.select("id"), "id", "left_semi").select(rows.columns))


@query(_PUBLISHED + """
    select o.id, o.key, case when d.id = o.id then 'published' else o.state end as state, case when d.id = o.id then true when d.id is not null then false else o.is_active end as is_active
    from one o
    left
    join d on d.key = o.key and d.locale = o.locale
""")
def publish_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2, M8: all drafts of the project at once."""
    rows = _one_draft(spark, sf_dir)
    return store.publish_set(rows, rows.where("state = 'draft'"), "e", F.to_timestamp(F.lit(NOW))).select("id", "key", "state", "is_active")


@query(_PUBLISHED + f", due as (select id from one where state = 'draft' and publish_at <= timestamp '{NOW}' and changeset_id is null) select state, count(*) as n, count(*) filter (is_active) as active from (select o.id, case when due.id is not null then 'published' else o.state end as state, case when due.id is not null then true when exists (select 1 from one x join due y on x.id = y.id where x.key = o.key and x.locale = o.locale) then false else o.is_active end as is_active from one o left join due on due.id = o.id) group by state")
def publish_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 without changes: what stands in none."""
    rows = _one_draft(spark, sf_dir)
    none = spark.createDataFrame([], "id long, project string, name string, note string, status string, author_kind string, publish_at timestamp, created_at timestamp, reverted_at timestamp")
    out, _ = store.publish_due_set(rows, none, F.to_timestamp(F.lit(NOW)), "clock")
    return out.groupBy("state").agg(F.count("*").alias("n"), F.count_if("is_active").alias("active"))


@query(sql("versions", "keys", "snapshot") + """
    ,
    h as (select key, bool_or(state <> 'draft') as stored, bool_or(state = 'draft') as drafted
    from versions
    where locale = 'default'
    group by key)
    select k.key, case when k.derives_from is not null then 'derived' when h.stored then 'already_stored' when h.drafted then 'has_draft' when s.value_json is null then 'no_value' else 'seeded' end as outcome
    from keys k
    left
    join h using (key)
    left
    join snapshot_default s using (key)
""")
def seed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12."""
    d = roles.descriptor(spark, sf_dir)
    return store.seed_set(d.keys, roles.snapshot(spark, sf_dir), roles.versions(spark, sf_dir), "p", "seed", F.to_timestamp(F.lit(NOW)), 1 << 40)[1]


@query()
def command_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2, M3, M5: a log of saves, publications, discards and reverts made of events, folded; tests hold it against plain cases."""
    e = table(spark, sf_dir, "events")
    verb = F.expr("case event_type when 'click' then 'save' when 'view' then 'publish' when 'error' then 'discard' else 'save' end")
    args = F.to_json(F.struct(F.concat(F.lit("k"), (F.col("user_id") % 50).cast("string")).alias("key"), F.col("event_type").alias("value"), F.lit(True).alias("force")))
    commands = e.select(F.concat(F.lit("p"), (F.col("user_id") % 16).cast("string")).alias("project"), F.col("event_id").alias("ord"), verb.alias("verb"), args.alias("args_json"), F.lit("e").alias("editor"), F.col("ts").cast("timestamp").alias("at"))
    out = store.fold(roles.versions(spark, sf_dir).limit(0), spark.createDataFrame([], "id long, project string, name string, note string, status string, author_kind string, publish_at timestamp, created_at timestamp, reverted_at timestamp"), commands, 1)
    return out["answers"].groupBy("verb", "ok").agg(F.count("*").alias("n"))


# --- contacts -------------------------------------------------------------------------------

@query("select n.n_name as name, count(s.s_suppkey) as members from nation n left join supplier s on s.s_nationkey = n.n_nationkey and s.s_acctbal > 5000 group by n.n_nationkey, n.n_name")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zeros kept."""
    groups = table(spark, sf_dir, "nation").selectExpr("'x' as project", "cast(n_nationkey as string) as key", "n_name as name")
    members = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").selectExpr("'x' as project", "cast(s_nationkey as string) as group_key")
    return contacts.group_counts(groups, members).select("name", "members")


_HELD = sql("contacts", "memberships", "suppressions") + ", m as (select x.id, x.group_key, c.email from memberships x join contacts c on c.id = x.contact_id)"


@query(_HELD + " select id, group_key, email from m where not exists (select 1 from suppressions s where s.email = m.email and s.scope in ('all', 'g1'))")
def sendable_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, J3."""
    rows = contacts.members(role(spark, sf_dir, "memberships"), role(spark, sf_dir, "contacts"))
    return contacts.sendable(rows, role(spark, sf_dir, "suppressions"), ["all", "g1"]).select("id", "group_key", "email")


@query(_HELD + " select id, email, exists (select 1 from suppressions s where s.email = m.email and s.scope in ('all', 'g1')) as suppressed from m")
def member_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2."""
    rows = contacts.members(role(spark, sf_dir, "memberships"), role(spark, sf_dir, "contacts"))
    return contacts.with_suppressed(rows, role(spark, sf_dir, "suppressions"), ["all", "g1"]).select("id", "email", "suppressed")


@query(_HELD + """
    ,
    a as (select email, string_agg(id || ':' || group_key, ',' order by id) as memberships
    from m
    group by email),
    b as (select email, string_agg(scope || ':' || source, ',' order by scope, source) as suppressions
    from suppressions
    group by email)
    select c.email, coalesce(a.memberships, '') as memberships, coalesce(b.suppressions, '') as suppressions
    from contacts c
    left
    join a using (email)
    left
    join b using (email)
""")
def contact_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, A5."""
    out = contacts.contact_records(role(spark, sf_dir, "contacts"), role(spark, sf_dir, "memberships"), role(spark, sf_dir, "suppressions"))
    m = F.array_join(F.transform("memberships", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["group_key"])), ",")
    s = F.array_join(F.transform("suppressions", lambda x: F.concat(x["scope"], F.lit(":"), x["source"])), ",")
    return out.select("email", m.alias("memberships"), s.alias("suppressions"))


@query(sql("suppressions") + " select scope, source, count(*) as n from suppressions group by scope, source")
def suppression_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    return contacts.suppression_counts(role(spark, sf_dir, "suppressions"))


_OUTCOMES = sql("contacts", "suppressions") + """
    ,
    e as (select sha256('salt' || 'a' || c_custkey || '@' || lower(c_mktsegment) || '.example') as h
    from customer
    where c_custkey % 11 = 0),
    p as (select distinct c.email
    from contacts c
    join orders o on o.o_custkey = c.id
    where o.o_totalprice > 300000),
    x as (select c.email, case when exists (select 1 from e where e.h = sha256('salt' || c.email)) then 'erased' when exists (select 1 from suppressions s where s.email = c.email and s.scope = 'all') then 'suppressed' when exists (select 1 from p where p.email = c.email) then 'present' else 'joined' end as outcome
    from contacts c)
"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = role(spark, sf_dir, "contacts")
    erased = people.where("id % 11 = 0").select(tx.erasure_hash("salt", F.col("email")).alias("email_hash"))
    rich = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("id"))
    return contacts.import_outcomes(people.select("email"), people.join(rich, "id", "left_semi"), role(spark, sf_dir, "suppressions"), erased, "salt", ["all"])


@query(_OUTCOMES + " select email, outcome from x")
def import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M15, T22."""
    return _outcomes(spark, sf_dir).select("email", "outcome")


@query(_OUTCOMES + " select outcome, count(*) as n from x group by outcome")
def import_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    return contacts.tally(_outcomes(spark, sf_dir))


@query(sql("contacts", "groups") + """
    ,
    j as (select c.project, c.email, 'g' || (n.n_regionkey) as group_key, o.o_orderdate as t, o.o_orderkey
    from orders o
    join contacts c on c.id = o.o_custkey
    join nation n on 'n' || n.n_nationkey = c.project),
    q as (select j.*
    from j
    join groups g on g.project = j.project and g.key = j.group_key
    where g.state = 'open')
    select project, group_key, email, min(t) as joined_at, max(t) as updated_at, count(*) > 0 as is_new
    from q
    group by project, group_key, email
""")
def joined_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open groups only; the first join stays, the latest properties count."""
    people = role(spark, sf_dir, "contacts")
    nation = table(spark, sf_dir, "nation").selectExpr("'n' || n_nationkey as project", "'g' || n_regionkey as group_key")
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey as id", "o_orderdate as at")
    joins = orders.join(people, "id").join(F.broadcast(nation), "project").select("project", "group_key", "email", "at", F.lit(None).cast("string").alias("form"), F.lit(None).cast("string").alias("page"), F.lit(None).cast("map<string,string>").alias("properties"))
    empty = spark.createDataFrame([], "id long, contact_id long, project string, group_key string, joined_at timestamp, form string, page string, properties map<string,string>, updated_at timestamp")
    joins = joins.withColumn("at", F.col("at").cast("timestamp"))
    return contacts.joined(joins, role(spark, sf_dir, "groups"), people, empty, role(spark, sf_dir, "suppressions").limit(0)).select("project", "group_key", "email", "joined_at", "updated_at", "is_new")


@query(sql("contacts") + ", e as (select id from contacts where id % 7 = 0) select c.id, c.email from contacts c where not exists (select 1 from e where e.id = c.id)")
def erased_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is left."""
    people = role(spark, sf_dir, "contacts")
    none = spark.createDataFrame([], "project string, email_hash string, erased_at timestamp")
    return contacts.erase(people, role(spark, sf_dir, "memberships"), none, people.where("id % 7 = 0"), "salt", F.to_timestamp(F.lit(NOW)))[0].select("id", "email")


@query(sql("contacts", "suppressions") + """
    ,
    a as (select email, 'all' as scope, 'import' as source
    from contacts
    where id % 4 = 0)
    select email, scope, source
    from suppressions
    union all
    select email, scope, source
    from a
    where not exists (select 1
    from suppressions s
    where s.email = a.email and s.scope = a.scope)
""")
def suppressed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert where absent."""
    stamp = F.to_timestamp(F.lit(NOW)).alias("created_at")
    new = role(spark, sf_dir, "contacts").where("id % 4 = 0").select("email", F.lit("all").alias("scope"), F.lit("import").alias("source"), stamp)
    return contacts.suppress(role(spark, sf_dir, "suppressions").select("email", "scope", "source", stamp), new).drop("created_at")


# --- rules ------------------------------------------------------------------------------------

@query(sql("keys", "snapshot") + " select k.key, s.locale, length(trim(s.value_json, '\"'))::varchar as length from keys k join snapshot s using (key) where k.shape = 'text' and length(trim(s.value_json, '\"')) > 28")
def over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2, V3."""
    d = roles.descriptor(spark, sf_dir)
    return rules.over_limit(rules.strings_of(d, roles.snapshot(spark, sf_dir))).select("key", "locale", F.element_at("detail", F.lit("length")).alias("length"))


@query("""
    with t as (select doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) as p
    from documents),
    u as (select doc_id, case when len(p) > 1 and p[-1] = '' then p[1:len(p) - 1] else p end as p
    from t)
    select doc_id, list_sum(list_transform(p, lambda x: greatest(1, ceil(length(x) / 40.0))))::integer as lines
    from u
""")
def line_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9."""
    return table(spark, sf_dir, "documents").select("doc_id", rules.estimated_lines(F.col("text"), F.lit(40)).alias("lines"))


@query("select doc_id, length(text) as size from documents where length(text) > 2000")
def len16_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3's length in UTF-16 units."""
    return table(spark, sf_dir, "documents").select("doc_id", js.len16(F.col("text")).cast("long").alias("size")).where("size > 2000")


@query(sql("keys", "snapshot") + " select k.key, s.locale, k.shape from keys k join snapshot s using (key) where k.shape <> 'text'")
def malformed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: texts under colour and list keys."""
    d = roles.descriptor(spark, sf_dir)
    return rules.malformed(d, roles.snapshot(spark, sf_dir)).join(d.keys.select("key", "shape"), "key").select("key", "locale", "shape")


@query("""
    with w as (select doc_id, unnest(regexp_extract_all(text, '[^ \\n]+@[^ \\n]+')) as a
    from documents)
    select doc_id, a as address, lower(a) as normal, regexp_matches(lower(a), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') as valid
    from w
""")
def email_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, V15."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[^ \\n]+@[^ \\n]+"), F.lit(0))).alias("address")).withColumn("normal", tx.normal_email(F.col("address")))
    return rows.select("doc_id", "address", "normal", rules.email_fault(F.col("normal")).isNull().alias("valid"))


@query("""
    select o_orderkey, len(list_distinct(regexp_extract_all('Hello {{name}}, ' || o_orderpriority || ' {{ x' || (o_orderkey % 3) || ' }} {{name}}', '\\{\\{\\s*([a-zA-Z0-9_]+)\\s*\\}\\}', 1)))::integer as n, array_to_string(list_sort(list_distinct(regexp_extract_all('Hello {{name}}, ' || o_orderpriority || ' {{ x' || (o_orderkey % 3) || ' }} {{name}}', '\\{\\{\\s*([a-zA-Z0-9_]+)\\s*\\}\\}', 1))), ',') as names
    from orders
""")
def variables_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4, T4."""
    own = F.expr("'Hello {{name}}, ' || o_orderpriority || ' {{ x' || (o_orderkey % 3) || ' }} {{name}}'")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(tx.variables(own)).alias("n"), F.array_join(tx.vars_of(own), ",").alias("names"))


@query("""
    select 'class' as rule, 'error' as severity, 't' || r_regionkey as key
    from region
    where r_regionkey % 2 = 0
    union all
    select 'class', 'warning', 't' || r_regionkey
    from region
    where r_regionkey % 2 = 0
    union all
    select 'class', 'warning', 't' || r_regionkey || '__body'
    from region
    where r_regionkey % 2 = 1
""")
def template_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: marketing templates without link and address, promotional wording in transactional ones."""
    d = roles.descriptor(spark, sf_dir)
    body = F.when(F.col("slot") == "body", "A discount of 5 % for you").otherwise("News")
    slots = d.templates.select("template", F.explode("slots").alias("slot")).select(F.concat("template", F.lit("__"), "slot").alias("key"), F.lit("default").alias("locale"), F.concat(F.lit('"'), body, F.lit('"')).alias("value_json"))
    return rules.class_rules(d, slots).select("rule", "severity", "key")


@query(sql("keys") + " select key, 't' || (length(key) % 5) as template from keys")
def key_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7 over template names: the longest that begins a key."""
    d = roles.descriptor(spark, sf_dir)
    named = d.keys.select(F.concat(F.lit("t"), (F.length("key") % 5).cast("string"), F.lit("__"), "key").alias("key"))
    return rules.template_of(named, d.templates).select(F.substring_index("key", "__", -1).alias("key"), "template")


# --- seo -----------------------------------------------------------------------------------------

def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("""
    with t as (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title
    from pages)
    select title, count(*) as n, string_agg('page' || page_id, ', '
    order by 'page' || page_id) as members
    from t
    where trim(title) <> ''
    group by title
    having count(*) > 1
""")
def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, E3 over the titles of HTML pages."""
    titles = _titles(spark, sf_dir)
    keys = titles.select(F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("key"), F.lit(None).cast("string").alias("tmpl"))
    f = titles.where(~js.is_blank(F.col("title"))).select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("page"), F.lit("default").alias("locale"), F.struct(F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("key"), F.col("title").alias("text")).alias("title"))
    found = f.select(F.col("page"), F.col("title.text").alias("title"))
    dup = seo.duplicate_titles(roles.Descriptor(keys, keys, keys), f, seo.severities())
    members = dup.select(F.regexp_replace("message", "^pages share a title: ", "").alias("members")).withColumn("page", F.substring_index("members", ",", 1))
    return members.join(found, "page").select("title", F.size(F.split("members", ", ")).cast("long").alias("n"), "members")


_SEO = _BASE + _STORED.format(drafts="") + """, p as (select 'page' || n_nationkey as page, l as locale, 'k' || (n_nationkey * 3) as tk, case when n_nationkey % 4 <> 0 then 'k' || (n_nationkey * 3 + 1) end as dk, case when n_nationkey % 2 = 0 then 'k' || (n_nationkey + 50) end as ik, case when n_nationkey % 6 = 0 then 'k' || (n_nationkey + 60) end as ak
  from nation, (values ('default'), ('de')) t(l) where l = 'default' or n_nationkey % 3 = 0)"""


@query(_SEO + """
    select 'missing-title' as rule, page, locale
    from p
    where not exists (select 1
    from res r
    where r.key = tk and r.locale = p.locale and r.value_json is not null)
    union all
    select 'missing-description', page, locale
    from p
    where not exists (select 1
    from res r
    where r.key = dk and r.locale = p.locale and r.value_json is not null)
    union all
    select 'missing-alt', page, locale
    from p
    where exists (select 1
    from res r
    where r.key = ik and r.locale = p.locale and r.value_json is not null) and not exists (select 1
    from res r
    where r.key = ak and r.locale = p.locale and r.value_json is not null)
""")
def seo_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1, E6 over declared pages."""
    d, snap = roles.descriptor(spark, sf_dir), roles.snapshot(spark, sf_dir)
    f = seo.page_fields(d, resolve.resolve_all(d, snap, roles.versions(spark, sf_dir), ["default", "de"]))
    s = seo.severities()
    return seo.missing_field(f, "title", 1, s).unionByName(seo.missing_field(f, "description", 2, s)).unionByName(seo.missing_alt(f, s)).select("rule", "page", "locale")


@query("""
    with x as (select page_id, lower(trim(unnest(regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1)))) as a
    from pages)
    select page_id, a as label, count(*) as n
    from x
    where a in ('the', 'and', 'of', 'to', 'for')
    group by page_id, a
""")
def anchor_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7 with its list as a parameter, over the links of HTML pages."""
    links = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<a [^>]*>([^<]*)</a>"), F.lit(1))).alias("i", "a"))
    rows = links.select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("_"), F.col("i").cast("string")).alias("key"), F.lit("default").alias("locale"), js.to_json_string(F.col("a")).alias("value_json"), "page_id", "a")
    keys = rows.select("key", F.lit("text").alias("shape"), F.lit("web").alias("target"))
    found = seo.anchor_text(roles.Descriptor(keys, keys, keys), rows.select("key", "locale", "value_json"), rows.select("key", "locale", "value_json"), seo.severities(), ("the", "and", "of", "to", "for"))
    return found.join(rows.select("key", "page_id", "a"), "key").groupBy("page_id", F.lower(js.trim(F.col("a"))).alias("label")).agg(F.count("*").alias("n"))


@query("select page_id, len(regexp_extract_all(regexp_replace(html, '<script>.*?</script>', '', 'g'), '<a [^>]*>'))::bigint as links, len(regexp_extract_all(html, '<h1>'))::bigint as headings, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) as lang from pages")
def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1, H4: counts of what the scanner finds, held against patterns; tests hold its whole output."""
    e = html.elements(table(spark, sf_dir, "pages"))
    return e.groupBy("page_id").agg(F.count_if(F.col("tag") == "a").alias("links"), F.count_if(F.col("tag") == "h1").alias("headings"), F.max(F.when(F.col("tag") == "html", F.element_at("attrs", F.lit("lang")))).alias("lang"))


@query()
def html_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3, H5-H7."""
    return html.proposals(html.elements(table(spark, sf_dir, "pages")))


# --- drift -------------------------------------------------------------------------------------------

@query(sql("keys", "snapshot") + """
    select 'missing' as side, key
    from keys k
    where derives_from is null and not exists (select 1
    from snapshot_default s
    where s.key = k.key)
    union all
    select distinct 'orphan', key
    from snapshot s
    where not exists (select 1
    from keys k
    where k.key = s.key)
""")
def snapshot_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, U1, U3."""
    return drift.missing_and_orphans(roles.descriptor(spark, sf_dir), roles.snapshot(spark, sf_dir))


@query(sql("versions", "keys") + """
    ,
    st as (select distinct key, target
    from versions)
    select 'unseeded' as kind, key, null as detail
    from keys k
    where not exists (select 1
    from st
    where st.key = k.key)
    union all
    select distinct 'orphan', key, null
    from st
    where not exists (select 1
    from keys k
    where k.key = st.key)
    union all
    select 'target_drift', st.key, st.target || ' -> ' || k.target
    from st
    join keys k using (key)
    where st.target <> k.target
""")
def store_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2, J7, J8."""
    return drift.store_audit(roles.descriptor(spark, sf_dir).keys, roles.versions(spark, sf_dir))


@query(sql("snapshot") + ", b as (select locale, case when key like '%7' then 'x' || key else key end as key, case when key like '%4' then '\"new\"' else value_json end as value_json from snapshot) select coalesce(a.locale, b.locale) as locale, coalesce(a.key, b.key) as key, case when a.key is null then 'added' when b.key is null then 'removed' else 'changed' end as change from snapshot a full outer join b on a.locale = b.locale and a.key = b.key where a.value_json is distinct from b.value_json")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8."""
    before = roles.snapshot(spark, sf_dir)
    after = before.selectExpr("locale", "case when key like '%7' then 'x' || key else key end as key", "case when key like '%4' then '\"new\"' else value_json end as value_json")
    return drift.snapshot_diff(before, after)


@query(sql("snapshot") + " select distinct key as old_key, 'x' || key as new_key from snapshot where key like '%7'")
def snapshot_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9."""
    before = roles.snapshot(spark, sf_dir)
    return drift.renames_in(before, before.selectExpr("locale", "case when key like '%7' then 'x' || key else key end as key", "value_json"))


@query(sql("keys", "snapshot") + """
    ,
    pl as (select 'l' || key as place, key, case when key like '%2' then 'other' else 'k' end as t
    from keys)
    select p.place, p.key, case when s.key is null then 'unadopted' when p.t = 'other' then 'diverged' else 'adopted' end as class
    from pl p
    left
    join snapshot_default s using (key)
""")
def adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4."""
    snap = role(spark, sf_dir, "snapshot_default")
    places = role(spark, sf_dir, "keys").join(snap, "key", "left").select(F.concat(F.lit("l"), "key").alias("place"), "key", F.when(F.col("key").endswith("2"), "other").otherwise(F.coalesce(js.json_string(F.col("value_json")), F.lit(""))).alias("text"))
    return drift.adoption(places, snap)


@query(sql("keys") + """
    ,
    r as (select distinct case when user_id % 2 = 0 then 'k' else 'z' end || (user_id * 3) as key, event_type = 'view' as server
    from events),
    x as (select k.key, bool_or(r.key is not null) as exact, k.key like 'k12%' as pre
    from keys k
    left
    join r using (key)
    group by k.key)
    select key, case when exact or pre then 'read' else 'unknown' end as state
    from x
""")
def key_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7, F7, A12."""
    e = table(spark, sf_dir, "events").selectExpr("'f' as file", "case when user_id % 2 = 0 then 'k' else 'z' end || (user_id * 3) as key", "cast(null as string) as prefix", "cast(null as string) as cause", "event_type = 'view' as server").distinct()
    extra = spark.createDataFrame([("f", None, "k12", None, True), ("f", None, "k1", None, True), ("f", None, None, "dynamic", False)], "file string, key string, prefix string, cause string, server boolean")
    extra = extra.where("prefix is null or prefix <> 'k1'")
    return drift.usage(role(spark, sf_dir, "keys"), e.unionByName(extra)).select("key", "state")


@query("""
    with t as (select l_partkey as part, l_discount * 10 as score, l_orderkey * 10 + l_linenumber as run
    from lineitem
    where l_linenumber <> 3),
    m as (select part, quantile_disc(score, 0.5) as median
    from t
    group by part)
    select t.part, m.median, min(t.run) as run
    from t
    join m on m.part = t.part and m.median = t.score
    group by t.part, m.median
""")
def median_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, A11, N2."""
    runs = table(spark, sf_dir, "lineitem").selectExpr("l_partkey as part", "case when l_linenumber <> 3 then l_discount * 10 end as score", "l_orderkey * 10 + l_linenumber as run")
    return drift.median_runs(runs, ["part"]).select("part", "median", "run")


@query("""
    select event_id, case when event_type = 'click' then 'numeric' else 'binary' end as mode, value / 100 as score
    from events
    where event_type <> 'view' and value / 100 < case when event_type = 'click' then 0.9 else 1.0 end
""")
def failing_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G14."""
    audits = table(spark, sf_dir, "events").selectExpr("event_id", "case event_type when 'click' then 'numeric' when 'view' then 'manual' else 'binary' end as mode", "value / 100 as score")
    return drift.failing_audits(audits)


@query("""
    with s as (select *
    from (select event_id, case when event_id % 3 = 0 then 'approved' else 'proposed' end as state from events))
    select event_id, case when event_id % 5 = 0 and state = 'proposed' then 'approved' else state end as state
    from s
""")
def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M21."""
    s = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("key"), F.when(F.col("event_id") % 3 == 0, "approved").otherwise("proposed").alias("state"), F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("string").alias("by"))
    out, _ = drift.approve(s, s.where("key % 5 = 0"), F.to_timestamp(F.lit(NOW)), "me")
    return out.select(F.col("key").cast("long").alias("event_id"), "state")


@query(sql("versions") + " select id, key from versions v where not exists (select 1 from versions b where b.id = v.id and b.event_like)".replace("b.event_like", "b.value_json like '%click%'"))
def baseline_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4."""
    rows = roles.versions(spark, sf_dir)
    return drift.set_difference(rows, rows.where("value_json like '%click%'"), ["id", "value_json"]).select("id", "key")


# --- descriptor -------------------------------------------------------------------------------------------

@query(sql("keys") + " select key from keys where key like 'k1%' and false or key in ('k7', 'k70')")
def name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entries are names, or prefixes that end in a mark."""
    entries = spark.createDataFrame([("k1",), ("k7",), ("k70",)], "entry string").where("entry <> 'k1'")
    return descriptor.by_entries(role(spark, sf_dir, "keys"), entries).select("key")


@query(sql("keys") + """
    , p(prefix) as (values ('k'), ('k1'), ('k12'), ('k9')),
    x as (select k.key, p.prefix, row_number() over (partition by k.key order by length(p.prefix) desc) as n
    from keys k
    left
    join p on starts_with(k.key, p.prefix))
    select key, prefix
    from x
    where n = 1
""")
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7."""
    prefixes = spark.createDataFrame([("k",), ("k1",), ("k12",), ("k9",)], "prefix string")
    return descriptor.longest_prefix(role(spark, sf_dir, "keys"), prefixes)


@query(sql("keys") + """
    select case when key like '%5' then 'new_' || key else key end as key, case when derives_from like '%5' then 'new_' || derives_from else derives_from end as derives_from
    from keys
""")
def renamed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivations follow."""
    d = roles.descriptor(spark, sf_dir)
    names = d.keys.where("key like '%5'").select(F.col("key").alias("old_key"), F.concat(F.lit("new_"), "key").alias("new_key"))
    return descriptor.rename_keys(d, roles.snapshot(spark, sf_dir), names)[0].keys.select("key", "derives_from")


@query("""
    select 'slot' as kind, 't' || r_regionkey as holder, 't' || r_regionkey || '__' || s as missing
    from region, (values ('subject'), ('body')) x(s)
    union all
    select 'seo', 'page' || n_nationkey, 'k' || v
    from nation, unnest([n_nationkey * 3, case when n_nationkey % 4 <> 0 then n_nationkey * 3 + 1 end, case when n_nationkey % 2 = 0 then n_nationkey + 50 end, case when n_nationkey % 6 = 0 then n_nationkey + 60 end]) u(v)
    where v is not null and not exists (select 1
    from customer c
    where c.c_custkey = v)
    union all
    select 'page', 'k' || c_custkey, 'page' || length('k' || c_custkey)
    from customer
    where not exists (select 1
    from nation
    where n_nationkey = length('k' || c_custkey))
    union all
    select 'json_ld', 'page' || n_nationkey, 'k' || n_nationkey
    from nation
    where not exists (select 1
    from customer c
    where c.c_custkey = n_nationkey)
    union all
    select 'derives_from', 'k' || c_custkey, 'k' || (c_custkey - 1)
    from customer c
    where c_custkey % 6 = 5 and not exists (select 1
    from customer x
    where x.c_custkey = c.c_custkey - 1)
""")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6."""
    return drift.referential_faults(roles.descriptor(spark, sf_dir))


# --- texts ---------------------------------------------------------------------------------------------------

@query("select text, count(*) as n, min(doc_id) as first_id from documents group by text having count(*) > 1")
def duplicate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, J11."""
    rows = table(spark, sf_dir, "documents").select(F.lit("default").alias("locale"), F.col("doc_id").alias("key"), js.to_json_string(F.col("text")).alias("value_json"))
    found = texts.text_register(rows).where(F.size("keys") > 1)
    return found.select("text", F.size("keys").cast("long").alias("n"), F.element_at("keys", 1).alias("first_id"))


@query("select item_id, doc_id from (select distinct b.item_id, d.doc_id from benchmark b join documents d on contains(d.text, b.text) where length(b.text) >= 12)")
def contained_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages inside documents."""
    known = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return texts.contained_phrases(role(spark, sf_dir, "documents_text"), known).select(F.col("phrase_id").alias("item_id"), F.col("text_id").alias("doc_id")).distinct()


@query()
def near_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13 inside longer texts; tests hold it against brute force."""
    short = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return texts.near_windows(short, role(spark, sf_dir, "documents_text"))


@query("""
    select event_id, event_type || '_' || (row_number() over (partition by event_type order by event_id) - 1) as name
    from events
    qualify row_number() over (partition by event_type
    order by event_id) > 1
    union all
    select event_id, event_type
    from events
    qualify row_number() over (partition by event_type
    order by event_id) = 1
""")
def numbered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6, A15 with nothing taken."""
    places = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.col("event_type").alias("base"))
    return texts.number_names(places, spark.createDataFrame([], "name string")).select(F.col("ord").alias("event_id"), "name")


@query("select c_custkey, trim(regexp_replace(lower(regexp_replace(c_name || 'HotTopic ' || c_mktsegment, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g'), '_') as words, sha256('\"' || c_name || '\"') as hash, '&lt;' || c_name || '&gt; &amp; &quot;' || c_mktsegment || '&quot;' as escaped from customer")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6, T10, T21."""
    c = table(spark, sf_dir, "customer")
    escaped = tx.escape_html(F.expr("'<' || c_name || '> & \"' || c_mktsegment || '\"'"))
    return c.select("c_custkey", tx.words_of(F.expr("c_name || 'HotTopic ' || c_mktsegment")).alias("words"), tx.source_hash(F.expr("'\"' || c_name || '\"'")).alias("hash"), escaped.alias("escaped"))


@query("select page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)?', 1), '/$', '') as route, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as origin from pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T18, T27."""
    return table(spark, sf_dir, "pages").select("page_id", tx.route(F.coalesce(tx.path_of(F.col("url")), F.lit(""))).alias("route"), tx.origin(F.col("url")).alias("origin"))


@query("select event_id, regexp_extract(props, '\"k\": ?([0-9]+)', 1) as k from events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON object."""
    return table(spark, sf_dir, "events").select("event_id", F.element_at(js.json_object(F.col("props")), F.lit("k")).alias("k"))


@query("select doc_id, length(regexp_replace(text, '[^' || chr(10) || ']', '', 'g')) + 1 as line from documents")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line at the text's end."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.line_of(F.col("text"), F.length("text")).cast("long").alias("line"))


# --- further operators ---------------------------------------------------------------------------------------

@query("""
    with u as (select page_id, regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)?', 1) as p
    from pages),
    c as (select page_id, regexp_replace(p, '^/+|/+$', '', 'g') as p
    from u)
    select page_id, case when p = '' then 0 else len(string_split(regexp_replace(p, '/+', '/', 'g'), '/')) end::integer as depth
    from c
""")
def route_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O7."""
    return table(spark, sf_dir, "pages").select("page_id", tx.route_depth(F.coalesce(tx.path_of(F.col("url")), F.lit(""))).alias("depth"))


@query("select 'f' || event_id as path, case when event_id % 3 = 0 then 'handEdited' when event_id % 2 = 0 then 'staleSource' else 'current' end as state from events")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3."""
    f = table(spark, sf_dir, "events").selectExpr("'f' || event_id as path", "case when event_id % 2 = 0 then 'x' else 's' end as source_hash", "'s' as recorded_source_hash", "case when event_id % 3 = 0 then 'y' else 'c' end as content_hash", "'c' as recorded_content_hash")
    return drift.freshness(f)


@query(sql("snapshot") + " select key, case when key like '%4' or length(key) = 3 then 'proposed' else 'approved' end as state from snapshot_default")
def status_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed values and keys without a status are proposed again."""
    before = roles.snapshot(spark, sf_dir)
    after = before.withColumn("value_json", F.when(F.col("key").endswith("4"), F.lit('"new"')).otherwise(F.col("value_json")))
    statuses = before.where("locale = 'default' and length(key) <> 3").select("key", F.lit("approved").alias("state"), F.lit(None).cast("timestamp").alias("at"), F.lit("me").alias("by"))
    return drift.reset_statuses(statuses, before, after).select("key", "state")


_MARKED = sql("snapshot") + ", m as (select 'f' || (c_custkey % 20) as file, 'k' || c_custkey as key, case when c_custkey % 4 = 0 then 'edited' else c_name || ' of ' || c_mktsegment end as t from customer), d as (select m.file, m.key, case when s.key is null then 'unknown_mark' when '\"' || m.t || '\"' = s.value_json then 'current' else 'differs' end as drift from m left join snapshot_default s using (key))"


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "customer").selectExpr("'f' || (c_custkey % 20) as file", "'k' || c_custkey as key", "case when c_custkey % 4 = 0 then 'edited' else c_name || ' of ' || c_mktsegment end as text", "0 as tags")
    return drift.document_drift(marked, role(spark, sf_dir, "snapshot_default"))


@query(_MARKED + " select file, key, drift from d")
def document_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10."""
    return _drift(spark, sf_dir)


@query(_MARKED + " select file, case when bool_and(drift = 'current') then 'current' else 'differs' end as state from d group by file")
def document_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each file."""
    return drift.document_states(_drift(spark, sf_dir))


@query(sql("keys") + " select key from keys k where not exists (select 1 from orders o where 'k' || o.o_custkey = k.key and o.o_totalprice > 250000)")
def uncarried_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G11."""
    marked = table(spark, sf_dir, "orders").where("o_totalprice > 250000").selectExpr("'k' || o_custkey as key")
    return drift.uncarried(role(spark, sf_dir, "keys"), marked)


@query("""
    with p as (select n_name as page, '/' || n_nationkey as route
    from nation),
    f as (select 'f' || s_suppkey as path, '/' || (s_nationkey * 2) as route
    from supplier)
    select p.page, p.route, f.path
    from p
    left
    join f using (route)
    union all
    select null, f.route, f.path
    from f
    where not exists (select 1
    from p
    where p.route = f.route)
""")
def auditable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G12."""
    pages = table(spark, sf_dir, "nation").selectExpr("n_name as page", "'/' || n_nationkey as route")
    return drift.auditable_pages(pages, table(spark, sf_dir, "supplier").selectExpr("'f' || s_suppkey as path", "'/' || (s_nationkey * 2) as route"))


@query("select 't' || r_regionkey as template, s as slot from region, (values ('subject'), ('body')) x(s) where not (s = 'body' and r_regionkey % 2 = 0)")
def unread_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G13."""
    reads = table(spark, sf_dir, "region").where("r_regionkey % 2 = 0").selectExpr("'t' || r_regionkey as template", "'body' as slot")
    return drift.unread_slots(roles.descriptor(spark, sf_dir).templates, reads)


@query(sql("versions") + " select id, key, state from versions where state <> 'draft' or key in ('k3', 'k30')")
def shipped_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9."""
    rows = roles.versions(spark, sf_dir)
    return descriptor.shipped_scope(rows, rows.where("key in ('k3', 'k30')")).select("id", "key", "state")


@query("select 't' || r_regionkey || '__' || s as key from region, (values ('subject'), ('body')) x(s) where r_regionkey < 3 union all select 'brand__footer_address' union all select 'k1'")
def sibling_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10."""
    keys = table(spark, sf_dir, "region").where("r_regionkey < 3").selectExpr("'t' || r_regionkey || '__subject' as key").unionByName(table(spark, sf_dir, "region").where("r_regionkey = 0").selectExpr("'k1' as key"))
    return descriptor.with_siblings(roles.descriptor(spark, sf_dir), keys)


@query("""
    select c_custkey as el_id, 'k' || c_custkey as key
    from customer
    where c_custkey % 2 = 0
    union all
    select c_custkey, 'hello'
    from customer
    where c_custkey % 2 = 1
    union all
    select c_custkey, 'loose'
    from customer
    where c_custkey % 3 = 0 and c_custkey % 2 = 1
""")
def text_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts by equi-join, values with variables by first word."""
    shown = F.expr("case when c_custkey % 2 = 0 then c_name when c_custkey % 3 = 0 then 'Hello  ' || c_custkey || ' end' else ' Hello ' || c_custkey end")
    elements = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("el_id"), shown.alias("text"))
    values = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").selectExpr("'k' || c_custkey as key", "c_name as text")
    extra = spark.createDataFrame([("hello", "Hello {{n}}"), ("loose", "{{greeting}} end")], "key string, text string")
    return texts.census(elements, values.unionByName(extra))


@query("""
    select r_name as doc, n_name || ' page' as key, n_name as source, '{v} — the whole office of it' as tmpl
    from nation
    join region on r_regionkey = n_regionkey
    where length(n_name || ' head office in town') >= 12
""")
def derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text that holds another whole one."""
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.expr("r_regionkey = n_regionkey"))
    head = n.selectExpr("r_name as doc", "n_name as key", "n_name || ' head office in town' as text")
    page = n.selectExpr("r_name as doc", "n_name || ' page' as key", "n_name || ' head office in town — the whole office of it' as text")
    return texts.derivations(head.unionByName(page))


@query("select text, min(source) as doc from documents group by text having count(distinct source) = 1")
def single_document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H10."""
    return texts.only_in_one(table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), "text"))


@query("""
    select c_custkey, 'a' || c_name || 'b c' as plain, '{' || c_mktsegment || '} {{x}}' as single_in, '{{' || c_mktsegment || '}} {{x}}' as doubled, upper(substr(lower(c_mktsegment), 1, 1)) || substr(lower(c_mktsegment), 2) || ' title' as label, c_custkey % 2 = 0 as is_copy
    from customer
""")
def markup_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2, T5, T9, T13, T17."""
    c = table(spark, sf_dir, "customer")
    single = F.expr("'{' || c_mktsegment || '} {{x}}'")
    copy = F.expr("case when c_custkey % 2 = 0 then c_name else '<1>' || (c_custkey % 10) || '</1> {{name}} !' end")
    return c.select("c_custkey", js.collapse(tx.plain_of(F.expr("' a<1>' || c_name || '</1>b  <2/>\\nc '"))).alias("plain"), single.alias("single_in"), tx.to_double_braces(single).alias("doubled"), tx.derive_label(F.expr("'home__' || lower(c_mktsegment) || '_title'")).alias("label"), tx.qualifies_as_copy(copy).alias("is_copy"))


@query("select page_id, length(regexp_extract(html, '<title>([^<]*)</title>', 1)) as size, 'error' as severity from pages where length(regexp_extract(html, '<title>([^<]*)</title>', 1)) > 40")
def seo_over_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 with its bound as a parameter; keys without a limit take the rule's severity."""
    t = _titles(spark, sf_dir)
    key = F.concat(F.lit("t"), F.col("page_id").cast("string"))
    f = t.select(key.alias("page"), F.lit("default").alias("locale"), F.struct(key.alias("key"), F.col("title").alias("text")).alias("title"))
    keys = t.select(key.alias("key"), F.lit(None).cast("struct<max:int,severity:string>").alias("limits"))
    found = seo.over_length(roles.Descriptor(keys, keys, keys), f, "title", 40, 3, seo.severities())
    return found.select(F.expr("cast(substr(page, 2) as long)").alias("page_id"), F.regexp_extract("message", "has ([0-9]+) char", 1).cast("long").alias("size"), "severity")


@query("select event_id, case when event_type = 'click' then 'buy now' when event_type = 'view' then '#1' end as phrase from events")
def sales_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first imperative in a text."""
    text = F.expr("case event_type when 'click' then 'Act fast, BUY NOW or call now' when 'view' then 'the #1 of them' else 'buy nowhere, reorder nowadays' end")
    return table(spark, sf_dir, "events").select("event_id", seo.imperative(text).alias("phrase"))


@query("select l_orderkey, l_linenumber, case when l_linenumber % 3 = 0 then 60 when l_linenumber % 3 = 1 then 160 end as bound from lineitem")
def head_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tightest bound over a text's roles."""
    own = F.expr("case l_linenumber % 3 when 0 then array('meta_description', 'page_title') when 1 then array('share_description', 'text') else array('text') end")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", seo.head_limit(own).alias("bound"))


@query(sql("keys") + """
    select rule, key
    from (select 'construct' as rule, key
    from keys
    where target = 'html-email' and shape = 'text' and key like '%2'
    union all
    select 'requires', key
    from keys
    where shape = 'text' and key like '%3')
""")
def markup_and_requires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup in email copy, and required variables a text lost."""
    d = roles.descriptor(spark, sf_dir)
    d = roles.Descriptor(d.keys.withColumn("requires", F.when(F.col("key").endswith("3"), F.array(F.lit("name")))), d.pages, d.templates)
    value = F.when(F.col("key").endswith("2"), F.lit('"a <b>bold</b> <brag>"')).otherwise(F.lit('"a <brag> 1 < 2 and {{nam}}"'))
    found = rules.strings_of(d, d.keys.select("key", F.lit("default").alias("locale"), value.alias("value_json")))
    return rules.illegal_markup(found).unionByName(rules.missing_variables(found)).select("rule", "key")


@query("select 'k' || event_id as key, 'email,phone' as fields from events where event_id % 4 = 1")
def contact_smell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V14."""
    value = F.expr("""case event_id % 4 when 1 then '{"Phone": "1", "email": "x", "note": ""}' when 2 then '{"email": "x"}' else '"email phone"' end""")
    return rules.contact_smell(table(spark, sf_dir, "events").select(F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key"), F.lit("default").alias("locale"), value.alias("value_json"))).select("key", "fields")


@query("""
    select event_id as row_id, case when event_id % 5 = 0 then 'email' when event_id % 5 = 1 then 'date' when event_id % 5 = 2 then 'future' when event_id % 5 = 3 then 'date' end as fault
    from events
    where event_id % 5 <> 4
""")
def import_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses, days that don't exist, dates without a zone, dates to come."""
    email = F.expr("case when event_id % 5 = 0 then 'no address' else 'a@b.example' end")
    at = F.expr("case event_id % 5 when 1 then '2024-02-30T10:00:00Z' when 2 then '2031-01-01T00:00:00Z' when 3 then '2024-01-01 10:00' else '2024-02-29T10:00:00+02:00' end")
    return rules.import_faults(table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), email.alias("email"), at.alias("at")), "2030-01-01 00:00:00", "at")


@query(sql("keys") + """
    select 'k' || c_custkey as gone, 'k' || (c_custkey + 10) as survivor, 'values' as reason
    from customer
    where c_custkey % 30 = 0 and c_custkey + 10 <= (select max(c_custkey)
    from customer) and c_custkey > 0
""")
def merge_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges that must be refused."""
    d = roles.descriptor(spark, sf_dir)
    keys = roles._as(d.keys.withColumn("shape", F.lit("text")).withColumn("target", F.lit("web")), roles.KEY_DEFS)
    c = table(spark, sf_dir, "customer")
    merges = c.selectExpr("'k' || c_custkey as gone", "'k' || case when c_custkey % 30 = 0 and c_custkey > 0 then c_custkey + 10 else c_custkey end as survivor").join(c.selectExpr("'k' || c_custkey as survivor"), "survivor", "left_semi").select("gone", "survivor")
    return descriptor.merge_faults(roles.Descriptor(keys, d.pages, d.templates), roles.snapshot(spark, sf_dir), merges)


@query(sql("keys") + " select key, case when key = 'k7' then null else derives_from end as derives_from from keys where false or key <> 'k4'".replace("key = 'k7'", "derives_from = 'k4'"))
def removed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What derives from a removed key stands by itself."""
    d, snap = roles.descriptor(spark, sf_dir), roles.snapshot(spark, sf_dir)
    gone = d.keys.where("key = 'k4'").select("key")
    resolved = snap.withColumn("source", F.lit("derived"))
    return descriptor.remove_keys(d, snap, resolved, gone)[0].keys.select("key", "derives_from")


@query("select 'k' || event_id as key, case event_id % 3 when 0 then '\"Hi {{n}}\"' when 1 then '\"first\"' else '\"held\"' end as value_json from events where event_id % 4 <> 3")
def imported_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings, [value, meta] pairs and {value} objects; other entries are left out."""
    entry = F.expr("""case when event_id % 4 = 3 then '7' else case event_id % 3 when 0 then '"Hi {n}"' when 1 then '["first", {"m": 1}]' else '{"value": "held", "x": 1}' end end""")
    return descriptor.import_rows(table(spark, sf_dir, "events").select(F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key"), entry.alias("entry_json")), placeholders=True)


@query(sql("snapshot") + """
    select key, value_json, sha256(value_json) as source_hash, case when key like '%1' then 'approved' else 'proposed' end as state
    from snapshot_default
    where key in ('k11', 'k12', 'k110')
""")
def generated_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: filtered values with their hash and approval."""
    from versotext.sources import sinks

    snap = role(spark, sf_dir, "snapshot_default")
    statuses = snap.where("key like '%1'").select("key", F.lit("approved").alias("state"))
    return sinks.generated_table(snap, spark.createDataFrame([("k11",), ("k12",), ("k110",)], "entry string"), statuses)


@query("select 'p' || n_nationkey as page from nation where n_nationkey < 12")
def fan_out_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages a set of keys renders on."""
    d = roles.descriptor(spark, sf_dir)
    keys = table(spark, sf_dir, "nation").selectExpr("n_nationkey as ord", "'k' || n_nationkey as key", "array('p' || n_nationkey, 'p' || (n_nationkey div 2)) as pages")
    return descriptor.pages_of(roles.Descriptor(keys, d.pages, d.templates), keys.where("n_nationkey < 12" if "n_nationkey" in keys.columns else "ord < 12").select("ord", "key"))


@query("select case when event_type = 'error' then 'error' else 'warning' end as k, count(*) as n from events group by 1")
def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    counts = seo.severity_counts(table(spark, sf_dir, "events").selectExpr("case when event_type = 'error' then 'error' else 'warning' end as severity"))
    return counts.select(F.explode(F.map_from_arrays(F.array(F.lit("error"), F.lit("warning")), F.array("errors", "warnings"))).alias("k", "n"))
