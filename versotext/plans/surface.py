"""Registered queries of text functions, rules, findings and single reads, with their DuckDB SQL.

Where a case doesn't stand in the test tables, an expression in the select list makes it, for all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versotext.functions import js
from versotext.functions import text as tx
from versotext.operators import descriptor, drift, html, resolve, rules, seo, versions
from versotext.plans import roles
from versotext.plans.queries import query, table
from versotext.plans.roles import role, sql
from versotext.schema import KEY_DEFS, PAGE_DEFS, Descriptor
from versotext.sources.files import _as

# --- functions ------------------------------------------------------------------------------

_ENTITIES = "'a &amp; b &#' || (33 + o_orderkey % 90) || '; &nope; &#x41; &#55296; &lt;' || o_orderpriority"


@query("""
    select o_orderkey, 'a & b ' || chr((33 + o_orderkey % 90)::integer) || ' &nope; A &#55296; <' || o_orderpriority as decoded, '&nope;,&#55296;' as undecoded
    from orders
""")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7, T8."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ENTITIES).alias("t"))
    return rows.select("o_orderkey", tx.decode_entities("t").alias("decoded"), F.array_join(tx.undecoded_entities("t"), ",").alias("undecoded"))


_WORDS = "replace(lower(p_name), ' ', '_') || '_' || replace(lower(p_type), ' ', '_') || '_' || p_partkey || '_' || replace(replace(lower(p_brand), '#', '_'), ' ', '_')"


@query(f"""
    with w as (select p_partkey, {_WORDS} as w from part),
    s as (select p_partkey, w, string_split(w, '_') as p from w),
    k as (select *, p[1:len(p) - 1] as head, p[len(p)] as last, ['shop_front_window', '', w, p[len(p)] || '_' || w] as parts from s),
    b as (select *, array_to_string(list_filter(parts, lambda x: x <> ''), '__') as whole, 'shop_front_window__' || w as lead from k)
    select p_partkey,
      (list_filter(list_transform([1, 2, 3], lambda i: array_to_string(p[1:i], '_')), lambda x: length(x) <= 18))[-1] as first_three,
      (list_filter(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], '_')), lambda x: length(x) <= 25))[-1] as proposed,
      case when length(whole) <= 48 then whole
        when 46 - length(lead) >= 8 then lead || '__' || regexp_replace(left(parts[4], 46 - length(lead)), '_+$', '')
        else regexp_replace(left(parts[4], 48), '_+$', '') end as base
    from b
""")
def key_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T11, T12, T14."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_WORDS).alias("w"))
    parts = F.array(F.lit("shop_front_window"), F.lit(""), F.col("w"), F.concat(F.substring_index("w", "_", -1), F.lit("_"), "w"))
    return rows.select("p_partkey", tx.first_words(F.col("w"), 3, 18).alias("first_three"), tx.propose_key(F.col("w"), 25).alias("proposed"), tx.base_name(parts, 48).alias("base"))


_FILE = "'./docs/' || case when c_custkey % 4 = 0 then 'index' when c_custkey % 4 = 1 then 'a/index' else 'red-car_' || c_custkey end || case when c_custkey % 3 = 0 then '.htm' else '.html' end"


@query(f"""
    with f as (select c_custkey, {_FILE} as file from customer)
    select c_custkey,
      case when c_custkey % 4 = 0 then '/docs' when c_custkey % 4 = 1 then '/docs/a' else '/docs/red-car_' || c_custkey end as route,
      case when c_custkey % 4 in (0, 1) then 'index' else 'red car ' || c_custkey end as stem,
      file like './docs/%' and not regexp_matches(file, '^\\./docs/[^/]*$') as deeper,
      c_custkey % 3 <> 0 as is_html
    from f
""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T20, T25, T30."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_FILE).alias("file"))
    return rows.select(
        "c_custkey", tx.file_route(F.col("file")).alias("route"), tx.stem_words(F.concat("file", F.lit("?v=1"))).alias("stem"),
        F.col("file").rlike(tx.glob_regex("./docs/*/*.*")).alias("deeper"), F.col("file").rlike(tx.glob_regex("**/*.html")).alias("is_html"),
    )


@query(r"""
    with t as (select doc_id, coalesce(text, '') as text from documents)
    select doc_id,
      case when regexp_matches(text, '(?:^|[^\p{L}\p{N}])the(?:$|[^\p{L}\p{N}])') then length(regexp_extract(text, '(?s)^((?:.*?[^\p{L}\p{N}])??)the(?:$|[^\p{L}\p{N}])', 1)) else -1 end as place,
      case when length(regexp_replace(text, '[\x00-\x1f\x7f-\x9f\x{2028}\x{2029}]+', ' ', 'g')) <= 60 then regexp_replace(text, '[\x00-\x1f\x7f-\x9f\x{2028}\x{2029}]+', ' ', 'g')
        else left(regexp_replace(text, '[\x00-\x1f\x7f-\x9f\x{2028}\x{2029}]+', ' ', 'g'), 59) || '…' end as line
    from t
""")
def bounded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T19, T29."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", tx.word_bounded(F.lit("the"), F.col("text")).alias("place"), tx.one_line(F.col("text"), 60).alias("line"))


_PROPS = "'{\"name\":\"' || p_name || '\",\"size\":' || p_size || ',\"none\":null,\"type\":\"' || p_type || '\"}'"


@query("""
    select p_partkey, 'Hi ' || p_name || ', {{ size }} ' || p_type || ' ' || p_name as filled, 'name=' || p_name || ',type=' || p_type as fields,
      (p_partkey % 3 + p_partkey % 2) as apart, false as has_constructor, ceil(p_size / 7.0)::bigint as up, floor(p_size / 7.0)::bigint as down, round((p_partkey % 200) / 2.0)::integer as percent
    from part
""")
def filled_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only text fields of the JSON are put in."""
    rows = table(spark, sf_dir, "part").withColumn("props", js.string_map(F.expr(_PROPS)))
    fields = F.array_join(F.array_sort(F.transform(F.map_entries("props"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    one = F.array(F.lit(0), F.lit(0), F.lit(0))
    other = F.expr("array(if(p_partkey % 3 >= 1, 1, 0), if(p_partkey % 3 = 2, 1, 0), if(p_partkey % 2 = 1, 1, 0))")
    return rows.select(
        "p_partkey", tx.substitute(F.lit("Hi {{name}}, {{ size }} {{ type }} {{name}}"), F.col("props")).alias("filled"), fields.alias("fields"), tx.windows_differ(one, other).cast("long").alias("apart"),
        F.map_contains_key("props", "constructor").alias("has_constructor"), F.ceil(F.col("p_size") / 7.0).alias("up"), F.floor(F.col("p_size") / 7.0).alias("down"), F.round(F.col("p_partkey") % 200 / 2.0).cast("int").alias("percent"),
    )


_SECRET = "sixteen byte key"
_INNER, _OUTER = (bytes(b ^ mask for b in _SECRET.encode().ljust(64, b"\0")).hex() for mask in (0x36, 0x5C))


@query(f"""
    with p as (select o_orderkey, o_orderdate, '{{"exp":' || o_orderkey || '}}' as payload from orders),
    m as (select *, unhex(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(payload))))) as signature from p),
    t as (select *, rtrim(translate(base64(encode(payload)), '+/', '-_'), '=') || '.' || rtrim(translate(base64(signature), '+/', '-_'), '=') as token from m)
    select o_orderkey, token, payload as verified, case when o_orderkey > 5000 then payload end as unexpired, null::varchar as forged, strftime(o_orderdate, '%-d %b %Y %H:%M') as day from t
""")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed payloads that expire; the time is a parameter."""
    rows = table(spark, sf_dir, "orders").withColumn("payload", F.expr("'{\"exp\":' || o_orderkey || '}'"))
    rows = rows.withColumn("token", tx.mint_token(_SECRET)("payload"))
    return rows.select(
        "o_orderkey", "token", tx.verify_token(_SECRET)("token").alias("verified"), tx.verify_token(_SECRET, 5000)("token").alias("unexpired"),
        tx.verify_token("another key")("token").alias("forged"), js.short_date(F.col("o_orderdate")).alias("day"),
    )


@query("""
    select conv_id, turn, ['heading', 'link', 'text', 'item', 'text'][1 + turn % 5] as role, case when turn % 4 = 0 then null else ['main', 'nav', 'footer'][turn % 4] end as section, 'landmark' as what
    from conversations
""")
def element_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an element's text is called, and the landmark above it."""
    tag = F.expr("element_at(array('h2', 'a', 'div', 'li', 'p'), cast(1 + turn % 5 as int))")
    above = F.expr("case turn % 4 when 0 then array('div', 'body') when 1 then array('div', 'main', 'nav', 'body') when 2 then array('nav', 'body') else array('ul', 'footer', 'main') end")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", html.role(tag).alias("role"), html.section(above).alias("section"), F.lit("landmark").alias("what"))


# --- rules ------------------------------------------------------------------------------------

_TAGGED = ["<1>a</1> <2/>", "<1>a <2/>", "</1> <2/>", "<1/> <3/>", "<1/> <1/> <2/>", "<1/>", "<1><2></1></2>", "plain"]
_FAULTS = [None, "tag 1 left open", "tag 1 closed out of turn", "tag 3 undeclared", "tag 1 twice", "tag 2 missing", "tag 1 closed out of turn", "tag 1 missing"]


@query("select 'k' || o_orderkey as key, ([" + ", ".join("null" if f is None else f"'{f}'" for f in _FAULTS) + "])[1 + o_orderkey % 8] as fault from orders where o_orderkey % 8 <> 0")
def tag_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two declared tags, each once and balanced."""
    text = F.element_at(F.array(*map(F.lit, _TAGGED)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.expr("'k' || o_orderkey").alias("key"), F.lit("default").alias("locale"), F.expr("'k' || o_orderkey").alias("path"), text.alias("text"), F.lit(2).alias("tags"))
    return rules.unbalanced_tags(rows).select("key", F.col("detail")["fault"].alias("fault"))


_COPY = "case when c_custkey % 13 = 0 then '\"<b>x</b> {{other}}\"' else '\"' || c_name || ' of ' || c_mktsegment || '\"' end"
_CHECKED = sql("keys") + f""",
v as (select 'default' as locale, 'k' || c_custkey as key, {_COPY} as value_json from customer union all select 'de', 'k' || c_custkey, '"de ' || c_name || '"' from customer),
j as (select v.*, k.shape, k.target, trim(value_json, '"') as t, length(v.key) % 2 = 0 as hard from v join keys k using (key)),
good as (select * from j where shape = 'text'),
found as (
  select 'shape' as rule, 'error' as severity, key, locale, 0 as seq from j where shape <> 'text'
  union all select 'limit', case when hard then 'error' else 'warning' end, key, locale, 1 from good where length(t) > 28
  union all select 'vars', 'error', key, locale, 2 from good where t like '%{{{{other}}}}%'
  union all select 'class', 'error', 't' || r_regionkey, l, 6 from region, (select distinct locale as l from good) where r_regionkey % 2 = 0
  union all select 'class', 'warning', 't' || r_regionkey, l, 7 from region, (select distinct locale as l from good) where r_regionkey % 2 = 0
  union all select 'construct', 'error', key, locale, 8 from good where target = 'html-email' and t like '%<b>%'
  union all select 'budget', 'warning', key, locale, 9 from good where length(t) > 20
)
"""


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.selectExpr("'default' as locale", "'k' || c_custkey as key", f"{_COPY} as value_json").unionByName(rows.selectExpr("'de' as locale", "'k' || c_custkey as key", "'\"de ' || c_name || '\"' as value_json"))


@query(_CHECKED + " select rule, severity, key, locale, seq from found")
def checked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes first, then every rule over what has its shape."""
    return rules.check_snapshot(roles.descriptor(spark, sf_dir), _values(spark, sf_dir)).select("rule", "severity", "key", "locale", "seq")


@query(_CHECKED + " select rule, severity, key, locale, seq, (row_number() over (order by case when severity = 'error' then 0 else 1 end, seq, key, locale))::integer as place from found order by place limit 50")
def first_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors first, in the order of the rules; a top-k report."""
    found = rules.ordered(rules.check_snapshot(roles.descriptor(spark, sf_dir), _values(spark, sf_dir))).limit(50)
    ranked = [(i + 1, *r) for i, r in enumerate(found.select("rule", "severity", "key", "locale", "seq").collect())]  # 50 rows
    return spark.createDataFrame(ranked, "place int, rule string, severity string, key string, locale string, seq int")


_LINES = "case when r_regionkey % 2 = 0 then 'Two\nlines' else 'One line' end"


@query("select 't' || r_regionkey || '__subject' as key, l.locale from region, (select unnest(['default', 'de']) as locale) l where r_regionkey % 2 = 0")
def subject_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: a line break under a subject, and under a body, where it's allowed."""
    d = roles.descriptor(spark, sf_dir)
    rows = table(spark, sf_dir, "region").select("r_regionkey", F.expr(_LINES).alias("text"), F.explode(F.array(F.lit("default"), F.lit("de"))).alias("locale"))
    rows = rows.select(F.explode(F.expr("array('t' || r_regionkey || '__subject', 't' || r_regionkey || '__body', 'k' || r_regionkey)")).alias("key"), "locale", "text").withColumn("path", F.col("key"))
    return rules.subject_lines(d, rows).select("key", "locale")


_ANSWERS = "case c_custkey % 7 when 0 then map('size', 'M', 'note', 'x') when 1 then map('size', 'XL') when 2 then map('note', 'x') when 3 then map('size', 'S', 'stray', 'y', 'also', 'z') when 4 then map('size', 'S', 'note', repeat('x', 501)) when 5 then map('size', ' ', 'note', 'a\tb') else map('size', 'L', 'note', 'a\tb') end"


@query("""
    select c_custkey as row_id, case c_custkey % 7 when 1 then 'size' when 2 then 'size' when 3 then 'also' when 4 then 'note' when 5 then 'size' else 'note' end as question,
      case c_custkey % 7 when 1 then 'not_in_list' when 2 then 'required' when 3 then 'unknown_question' when 4 then 'too_long' when 5 then 'required' else 'control' end as code
    from customer where c_custkey % 7 <> 0
""")
def wrong_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fault of each row's answers."""
    groups = table(spark, sf_dir, "nation").selectExpr("'n' || n_nationkey as project", "'g' as key", "array(named_struct('name', 'size', 'type', 'enum', 'values', array('S', 'M', 'L'), 'required', true), named_struct('name', 'note', 'type', 'text', 'values', cast(null as array<string>), 'required', false)) as properties")
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey as row_id", "'n' || c_nationkey as project", "'g' as group_key", f"{_ANSWERS} as answers")
    return rules.answer_faults(rows, groups)


@query("""
    select 'n' || n_nationkey as project, case when n_nationkey % 6 = 1 then 'Bad Key' else 'g' || n_nationkey end as key,
      (['key', 'repeated_question', 'type', 'enum_without_values', 'values_without_enum'])[n_nationkey % 6] as fault
    from nation where n_nationkey % 6 <> 0
""")
def wrong_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V17."""
    question = lambda name, kind, values: f"named_struct('name', '{name}', 'type', '{kind}', 'values', {values}, 'required', false)"
    none, some = "cast(null as array<string>)", "array('x')"
    asked = f"case n_nationkey % 6 when 2 then array({question('a', 'text', none)}, {question('a', 'text', none)}) when 3 then array({question('a', 'number', none)}) when 4 then array({question('a', 'enum', none)}) when 5 then array({question('a', 'text', some)}) else array({question('a', 'enum', some)}) end"
    return rules.group_faults(table(spark, sf_dir, "nation").selectExpr("'n' || n_nationkey as project", "case when n_nationkey % 6 = 1 then 'Bad Key' else 'g' || n_nationkey end as key", f"{asked} as properties"))


# --- pages and documents ------------------------------------------------------------------------


def _site(spark: SparkSession, sf_dir: str) -> Descriptor:
    """A page for each customer: its canonical URL is the next one's route, every third is noindex, every second binds a key that shows elsewhere."""
    c = table(spark, sf_dir, "customer")
    seo_ = "named_struct('title', 'ti' || c_custkey, 'description', cast(null as string), 'robots', 'ro' || c_custkey, 'canonical', 'ca' || c_custkey, 'og_image', cast(null as string), 'og_image_alt', cast(null as string))"
    pages = c.selectExpr("'p' || c_custkey as page", "'/c/' || c_custkey || '/' as route", "cast(null as string) as parent", "cast(null as array<string>) as locales", f"{seo_} as seo", "named_struct('type', 'Thing', 'bindings', map('name', 'ti' || c_custkey)) as json_ld")
    names = [f.split()[0].strip("`") for f in ("key", "shape", "target")]
    keys = c.selectExpr("'ti' || c_custkey as key", "'text' as shape", "'web' as target", "array(case when c_custkey % 2 = 0 then 'p' || c_custkey else 'elsewhere' end) as pages")
    keys = keys.select(*names, "pages", *[F.lit(None).alias(n) for n in ("limits", "budget", "values", "vars", "requires", "tags", "derives_from", "tmpl", "label")])
    return Descriptor(_as(keys, KEY_DEFS), _as(pages, PAGE_DEFS), roles.descriptor(spark, sf_dir).templates)


def _site_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return (
        c.selectExpr("'ti' || c_custkey as key", "'default' as locale", "'\"' || c_name || '\"' as value_json")
        .unionByName(c.selectExpr("'ca' || c_custkey", "'default'", "'\" /c/' || (c_custkey + 1) || ' \"'").toDF("key", "locale", "value_json"))
        .unionByName(c.selectExpr("'ro' || c_custkey", "'default'", "case when c_custkey % 3 = 0 then '[\"NoIndex\",\"nofollow\"]' when c_custkey % 3 = 1 then '\"noindexes\"' else '\"index\"' end").toDF("key", "locale", "value_json"))
    )


@query("select 'canonical-noindex' as rule, 'warning' as severity, 'p' || a.c_custkey as page, 'ca' || a.c_custkey as key from customer a join customer b on b.c_custkey = a.c_custkey + 1 where b.c_custkey % 3 = 0")
def closed_canonicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A canonical URL that is the route of a page that isn't indexed, with the severity overridden."""
    d, values = _site(spark, sf_dir), _site_values(spark, sf_dir)
    found = seo.canonical_noindex(seo.page_fields(d, values), values, d, seo.severities({"canonical-noindex": "warning"}))
    return found.select("rule", "severity", "page", "key")


@query("select 'visible-content' as rule, 'error' as severity, 'p' || c_custkey as page, 'ti' || c_custkey as key from customer where c_custkey % 2 = 1")
def unseen_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bound keys that don't render on their page."""
    return seo.visible_content(_site(spark, sf_dir), seo.severities()).select("rule", "severity", "page", "key")


_HTML = (
    "'<html' || case page_id % 4 when 0 then '' when 1 then ' lang=\"not a tag\"' else ' lang=\"en-GB\"' end || '><body>' || case page_id % 3 when 0 then '<input id=\"q\">' when 1 then '<label for=\"q\">Q</label><input id=\"q\">' else '<label>Q <input id=\"q\"></label>' end"
    " || case page_id % 5 when 0 then '<a href=\"/x\"> </a>' when 1 then '<a href=\"/x\" aria-label=\"Go\"></a>' when 2 then '<button><img src=\"i.png\" alt=\"Go\"></button>' else '<a href=\"/x\">Go</a>' end"
    " || case page_id % 6 when 0 then '<img src=\"/a/red-car.png?x=1\" alt=\"Red car\">' when 1 then '<img src=\"b.png\">' when 2 then '<img src=\"b.png\" role=\"presentation\">' when 3 then '<img src=\"b.png\" alt=\"Photo of a boat\">' else '<img src=\"b.png\" alt=\"\">' end"
    " || case page_id % 7 when 0 then '<h2> </h2>' when 1 then '<h2><img src=\"c.png\" alt=\"Title\"></h2>' else '<h2>Title</h2>' end || '</body></html>'"
)


@query("""
    select page_id::varchar as page, rule, severity from pages, (select unnest(['missing-lang', 'missing-label', 'missing-name', 'redundant-alt', 'missing-alt', 'empty-heading']) as rule) r,
      (select unnest(['error', 'warning']) as severity) s
    where severity = case when rule in ('redundant-alt', 'empty-heading') then 'warning' else 'error' end
      and case rule when 'missing-lang' then page_id % 4 in (0, 1) when 'missing-label' then page_id % 3 = 0 when 'missing-name' then page_id % 5 = 0
        when 'redundant-alt' then page_id % 6 in (0, 3) when 'missing-alt' then page_id % 6 = 1 else page_id % 7 = 0 end
""")
def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each page, with every rule's cases."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(_HTML).alias("html"))
    return seo.document_rules(html.elements(pages)).select("page", "rule", "severity")


# --- resolution ------------------------------------------------------------------------------------


def _circle(spark: SparkSession, sf_dir: str) -> Descriptor:
    """The keys, each even one deriving from the next and each odd one from the one before."""
    d = roles.descriptor(spark, sf_dir)
    c = table(spark, sf_dir, "customer").selectExpr("'k' || c_custkey as key", "'k' || (c_custkey + 1 - 2 * (c_custkey % 2)) as other")
    keys = d.keys.join(c, "key").withColumn("derives_from", F.col("other")).withColumn("tmpl", F.concat(F.lit("<"), "key", F.lit(" {v}>"))).withColumn("shape", F.lit("text"))
    return Descriptor(_as(keys, KEY_DEFS), d.pages, d.templates)


@query("""
    with v as (select c_custkey as n, c_custkey + 1 - 2 * (c_custkey % 2) as o, c_name as s from customer)
    select 'k' || v.n as key, '"<k' || v.n || ' <k' || v.o || ' ' || v.s || '>>"' as value_json, 'derived' as source, 'derivation_cycle' as codes
    from v where v.o in (select n from v) union all select 'k' || v.n, '"' || v.s || '"', 'snapshot', 'no_value' from v where v.o not in (select n from v)
""")
def resolve_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key derives once in a walk; the second visit takes that key's committed text, which flows back out."""
    d = _circle(spark, sf_dir)
    committed = table(spark, sf_dir, "customer").selectExpr("'default' as locale", "'k' || c_custkey as key", "'\"' || c_name || '\"' as value_json")
    out = resolve.resolve_all(d, committed, roles.versions(spark, sf_dir).limit(0), ["default"])
    return out.select("key", "value_json", "source", F.array_join(F.transform("warnings", lambda w: w["code"]), ",").alias("codes"))


@query("""
    with v as (select 'k' || c_custkey as key, c_custkey as n, c_name as s from customer)
    select key, case when n % 2 = 0 then '"over ' || s || '"' else '"' || s || '"' end as value_json, case when n % 2 = 0 then 'draft' else 'active' end as source from v
""")
def resolve_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides stand in for stored rows before the resolution."""
    d = roles.descriptor(spark, sf_dir)
    keys = d.keys.withColumn("shape", F.lit("text")).withColumn("derives_from", F.lit(None).cast("string"))
    plain = Descriptor(_as(keys, KEY_DEFS), d.pages, d.templates)
    c = table(spark, sf_dir, "customer")
    own = c.selectExpr("c_custkey as id", "'p' as project", "'k' || c_custkey as key", "'default' as locale", "'published' as state", "true as is_active", "'\"' || c_name || '\"' as value_json")
    over = c.selectExpr("'p' as project", "'k' || c_custkey as key", "case when c_custkey % 2 = 0 then 'default' else 'fr' end as locale", "'\"over ' || c_name || '\"' as value_json")
    mixed = resolve.masked(own, over.withColumn("id", F.lit(None).cast("long")).withColumn("is_active", F.lit(False)))
    return resolve.resolve_all(plain, roles.snapshot(spark, sf_dir), mixed, ["default"], preview=True).select("key", "value_json", "source")


@query(sql("snapshot", "versions", "keys") + """
    , k as (select key, shape from keys where key = 'k8'),
    live as (select key, value_json from versions where state = 'published' and is_active and key = 'k8' and locale = 'default' order by id desc limit 1),
    draft as (select key, value_json from versions where state = 'draft' and key = 'k8' and locale = 'default' order by id limit 1),
    s as (select key, value_json from snapshot where key = 'k8' and locale = 'default')
    select k.key, s.value_json as committed_json, case when k.shape = 'text' then coalesce(live.value_json, s.value_json) else s.value_json end as live_json, case when k.shape = 'text' then draft.value_json end as draft_json
    from k left join live using (key) left join draft using (key) left join s using (key)
""")
def one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key's committed, live and draft value; the key is the read's argument."""
    return resolve.diff_of(roles.descriptor(spark, sf_dir), roles.snapshot(spark, sf_dir), roles.versions(spark, sf_dir), "k8")


@query("select 'k' || o_custkey as key, o_orderkey, case when c.c_custkey is null or o_orderkey % 2 = 1 then '\"none\"' else '\"' || c.c_name || '\"' end as value_json from orders o left join customer c on c.c_custkey = o.o_custkey")
def typed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with a fallback for keys or locales that hold nothing."""
    requests = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "'k' || o_custkey as key", "case when o_orderkey % 2 = 1 then 'fr' else 'default' end as locale")
    held = table(spark, sf_dir, "customer").selectExpr("'k' || c_custkey as key", "'default' as locale", "'\"' || c_name || '\"' as value_json")
    d = roles.descriptor(spark, sf_dir)
    # the same key is asked for by many orders
    distinct = requests.select("key", "locale").distinct()
    out = resolve.accessor(d, held, distinct, fallback='"none"')
    return requests.join(out, ["key", "locale"]).select("key", "o_orderkey", "value_json")


# --- differences and histories ------------------------------------------------------------------------


@query("select 'k' || c_custkey as key from customer where c_custkey % 3 = 0 union select 'd' || c_custkey from customer where c_custkey % 5 = 0 or c_custkey % 7 = 0 union select 'e' || c_custkey from customer where c_custkey % 7 = 0")
def changed_key_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed values, and derived keys whose resolution changed or went."""
    c = table(spark, sf_dir, "customer")
    before = c.selectExpr("'default' as locale", "'k' || c_custkey as key", "'{\"a\":1,\"b\":\"' || c_name || '\"}' as value_json")
    after = c.selectExpr("'default' as locale", "'k' || c_custkey as key", "'{\"b\":\"' || c_name || case when c_custkey % 3 = 0 then '!' else '' end || '\",\"a\":1}' as value_json")
    derived = c.selectExpr("'default' as locale", "'d' || c_custkey as key", "'\"' || c_name || '\"' as value_json")
    later = c.selectExpr("'default' as locale", "case when c_custkey % 7 = 0 then 'e' else 'd' end || c_custkey as key", "'\"' || c_name || case when c_custkey % 5 = 0 then '!' else '' end || '\"' as value_json")
    return drift.changed_keys(before, after, derived, later)


@query("select '/' || lower(n_name) || case when n_nationkey % 2 = 1 then '/more' else '' end as route from nation where n_nationkey % 2 = 1")
def unlisted_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes that no page declares."""
    routes = table(spark, sf_dir, "nation").selectExpr("'/' || lower(n_name) || case when n_nationkey % 2 = 1 then '/more' else '' end as route")
    return drift.unrecorded_routes(routes, roles.descriptor(spark, sf_dir).pages)


@query("select max(event_id) as id, 'k7' as old_key from events where user_id = 7 and event_type = 'view' having count(*) > 0")
def rename_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a key was ever renamed; the key is the read's argument."""
    renames = table(spark, sf_dir, "events").where("event_type = 'view'").selectExpr("event_id as id", "'p' as project", "'k' || user_id as old_key", "'n' || event_id as new_key")
    return versions.renamed_to(renames, "p", "k7").select("id", "old_key")


@query(sql("keys", "snapshot") + " select 'key' as kind, key, shape as detail from keys union all select 'key', 'k3_copy', shape from keys where key = 'k3' union all select locale, key, value_json from snapshot union all select locale, 'k3_copy', value_json from snapshot where key = 'k3'")
def split_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key's declaration and values copied under a new name; the key is the command's argument."""
    d, s = descriptor.split_key(roles.descriptor(spark, sf_dir), roles.snapshot(spark, sf_dir), "k3", "k3_copy")
    return d.keys.select(F.lit("key").alias("kind"), "key", F.col("shape").alias("detail")).unionByName(s.select(F.col("locale").alias("kind"), "key", F.col("value_json").alias("detail")))


@query("""
    with r as (select event_id as seq, case when event_id % 4 = 0 then '' else event_type end as value from events order by event_id desc limit 1000),
    x as (select *, lag(value, 1, '') over (order by seq) as b from r) select seq, 'c' || seq as commit, value from x where value <> b
""")
def key_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key's values over the newest 1,000 commits of a history, where they change; a top-k report."""
    commits = table(spark, sf_dir, "events").selectExpr("event_id as seq", "'c' || event_id as commit", "case when event_id % 4 = 0 then '{\"default\":{}}' else '{\"default\":{\"k\":\"' || event_type || '\"}}' end as snapshot_json")
    return versions.key_history(commits, "k").select("seq", "commit", "value")


@query(sql("versions") + " select 'full' as page, (select min(id) from (select id from versions order by id desc limit 20)) as cursor union all select 'short', null union all select 'exists', (select count(*) > 0 from versions where state = 'draft')::integer")
def page_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cursor after a full page and after a short one, and an existence test."""
    rows = roles.versions(spark, sf_dir)
    full = versions.next_cursor(versions.newest_page(rows, 20), 20)
    short = versions.next_cursor(versions.newest_page(rows, 20, before=5), 20)
    return spark.createDataFrame([("full", full), ("short", short), ("exists", int(not rows.where("state = 'draft'").isEmpty()))], "page string, cursor long")


@query("select user_id, event_type, count(*) as n, count(distinct event_type || '-' || (event_id % 3))::bigint as kinds from events group by user_id, event_type")
def drained_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows without paging, and distinct tuples after a sort."""
    rows = table(spark, sf_dir, "events").selectExpr("user_id", "event_type", "event_type || '-' || (event_id % 3) as kind")
    kinds = rows.dropDuplicates(["user_id", "event_type", "kind"]).groupBy("user_id", "event_type").agg(F.count("*").alias("kinds"))
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).join(kinds, ["user_id", "event_type"])


@query("select conv_id, turn, role, (row_number() over (order by role = 'assistant', conv_id, turn, conv_id % 2 desc))::integer as place from conversations order by place limit 100")
def mark_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head texts last, then by file and offset; a top-k report."""
    marks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("conv_id").alias("file"), F.col("turn").alias("offset"), (F.col("role") == "assistant").alias("head"), (F.col("conv_id") % 2 == 1).alias("is_attribute"))
    first = html.ordered_marks(marks).limit(100).select("conv_id", "turn", "role").collect()  # 100 rows
    return spark.createDataFrame([(*r, i + 1) for i, r in enumerate(first)], "conv_id long, turn long, role string, place int")
