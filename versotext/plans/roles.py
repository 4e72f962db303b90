"""Content tables played by the star-schema test tables, as expressions that Spark and DuckDB both take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versotext.schema import KEY_DEFS, VERSIONS, Descriptor
from versotext.sources.files import _as

#: table and select list of each role; the same text makes the DataFrame and the SQL view.
ROLES = {
    "versions": ("events", "event_id as id, 'p' as project, 'k' || user_id as key, case when event_id % 4 = 0 then 'de' else 'default' end as locale, case when event_type = 'click' then 'web' else 'html-email' end as target, '\"' || event_type || '-' || event_id || '\"' as value_json, case when event_type = 'error' then 'draft' else 'published' end as state, (event_type <> 'error' and event_id % 9 <> 0) as is_active, ts as publish_at, 'e' || (user_id % 5) as editor, case when event_id % 7 = 0 then user_id % 20 end as changeset_id, ts as created_at"),
    "keys": ("customer", "'k' || c_custkey as key, case when c_custkey % 10 = 9 then 'color' when c_custkey % 10 = 8 then 'list' else 'text' end as shape, case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'html-email' else 'web' end as target, case when c_custkey % 6 = 5 then 'k' || (c_custkey - 1) end as derives_from, case when c_custkey % 6 = 5 then 'about {v}, again {v}' end as tmpl"),
    "snapshot_default": ("customer", "'default' as locale, case when c_custkey % 8 = 3 then 'x' else 'k' end || c_custkey as key, '\"' || c_name || ' of ' || c_mktsegment || '\"' as value_json"),
    "snapshot_de": ("customer", "case when c_custkey % 5 = 0 then 'de' else 'fr' end as locale, 'k' || c_custkey as key, '\"de ' || c_name || '\"' as value_json"),
    "contacts": ("customer", "c_custkey as id, 'n' || c_nationkey as project, 'a' || c_custkey || '@' || lower(c_mktsegment) || '.example' as email"),
    "groups": ("nation", "'n' || n_nationkey as project, 'g' || n_regionkey as key, n_name as name, case when n_nationkey % 3 = 0 then 'closed' else 'open' end as state"),
    "memberships": ("orders", "o_orderkey as id, o_custkey as contact_id, 'g' || (o_orderkey % 5) as group_key, o_orderdate as joined_at"),
    "suppressions": ("customer", "'a' || c_custkey || '@' || lower(c_mktsegment) || '.example' as email, case when c_custkey % 2 = 0 then 'all' else 'g' || (c_custkey % 5) end as scope, case when c_custkey % 3 = 0 then 'bounce' else 'person' end as source"),
    "documents_text": ("documents", "doc_id as id, text"),
}
WHERE = {"suppressions": "c_acctbal < 0", "memberships": "o_orderstatus <> 'P'"}


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = ROLES[name]
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    if name in WHERE:
        rows = rows.where(WHERE[name])
    return rows.selectExpr(*_columns(columns))


def _columns(text: str) -> list[str]:
    out, depth, quoted, now = [], 0, False, ""
    for c in text:
        quoted ^= c == "'"
        depth += (not quoted) * ((c == "(") - (c == ")"))
        if c == "," and not depth and not quoted:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


def sql(*names: str) -> str:
    """A WITH clause that defines the roles for DuckDB; ``snapshot`` is both of its parts."""
    parts = []
    for name in names:
        if name == "snapshot":
            parts += [view("snapshot_default"), view("snapshot_de"), "snapshot as (select * from snapshot_default union all select * from snapshot_de)"]
        else:
            parts.append(view(name))
    return "with " + ",\n".join(parts)


def view(name: str) -> str:
    source, columns = ROLES[name]
    return f"{name} as (select {columns} from {source}" + (f" where {WHERE[name]}" if name in WHERE else "") + ")"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role(spark, sf_dir, "versions")
    for c in ("label", "note", "published_by"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    return _as(rows.withColumn("reverted_from", F.lit(None).cast("long")).withColumn("published_at", F.lit(None).cast("timestamp")), VERSIONS)


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role(spark, sf_dir, "snapshot_default").unionByName(role(spark, sf_dir, "snapshot_de"))


def descriptor(spark: SparkSession, sf_dir: str) -> Descriptor:
    """Keys from customers; two pages for each nation and a template for each region."""
    keys = role(spark, sf_dir, "keys")
    extra = {
        "limits": F.when(F.col("shape") == "text", F.struct(F.lit(28).alias("max"), F.when(F.length("key") % 2 == 0, "hard").otherwise("advisory").alias("severity"))), "budget": F.when(F.col("shape") == "text", F.struct(F.lit(1).alias("desktop"), F.lit(1).alias("mobile"))),
        "values": F.lit(None).cast("array<string>"), "vars": F.array(F.lit("name")), "requires": F.lit(None).cast("array<string>"), "tags": F.lit(None).cast("int"), "pages": F.array(F.concat(F.lit("page"), F.length("key").cast("string"))), "label": F.lit(None).cast("string"),
    }
    keys = keys.withColumns(extra)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    seo = "named_struct('title', 'k' || (n_nationkey * 3), 'description', case when n_nationkey % 4 <> 0 then 'k' || (n_nationkey * 3 + 1) end, 'robots', cast(null as string), 'canonical', cast(null as string), 'og_image', case when n_nationkey % 2 = 0 then 'k' || (n_nationkey + 50) end, 'og_image_alt', case when n_nationkey % 6 = 0 then 'k' || (n_nationkey + 60) end)"
    pages = nation.selectExpr("'page' || n_nationkey as page", "'/' || lower(n_name) as route", "cast(null as string) as parent", "case when n_nationkey % 3 = 0 then array('default', 'de') end as locales", f"{seo} as seo", "named_struct('type', 'Thing', 'bindings', map('name', 'k' || n_nationkey)) as json_ld")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    templates = region.selectExpr("'t' || r_regionkey as template", "case when r_regionkey % 2 = 0 then 'marketing' else 'transactional' end as class", "'manual' as trigger", "array('subject', 'body') as slots", "cast(null as array<string>) as wrapper_provides")
    return Descriptor(_as(keys, KEY_DEFS), pages, templates)
