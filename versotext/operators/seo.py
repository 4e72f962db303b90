"""Search and accessibility findings over pages and resolved values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versotext.functions import js
from versotext.functions.text import route, stem_words
from versotext.lineage import settled
from versotext.schema import Descriptor

#: Each rule's severity.
SEVERITY = {
    "missing-title": "error", "missing-description": "error", "duplicate-title": "error", "over-length": "error", "canonical-noindex": "error", "visible-content": "error", "missing-alt": "error",
    "missing-label": "error", "missing-name": "error", "missing-lang": "error", "anchor-text": "warning", "machine-field": "warning", "empty-heading": "warning", "redundant-alt": "warning",
}
TITLE_MAX, DESCRIPTION_MAX = 60, 160
#: Link labels that say nothing about where they go.
GENERIC_ANCHORS = ("click here", "click this", "go", "here", "information", "learn more", "read more", "more", "more info", "more information", "right here", "see more", "start", "this", "this page", "link", "check it out")
#: What sells instead of describing.
IMPERATIVES = ("buy now", "order now", "act now", "sign up now", "subscribe now", "call now", "visit now", "limited time", "best ever", "top rated", "#1")
#: How alt texts begin that repeat what an image is.
REDUNDANT_PREFIXES = ("image of", "picture of", "photo of", "graphic of", "icon of")


def severities(overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Severities with overrides; a rule can't be turned off."""
    for rule, value in (overrides or {}).items():
        if rule not in SEVERITY or value not in ("error", "warning"):
            raise ValueError(f"no such rule or severity: {rule}={value}")
    return SEVERITY | (overrides or {})


def head_limit(roles: Column) -> Column:
    """The tightest bound over the roles of a head text; null if none has one."""
    bound = F.transform(roles, lambda r: F.when(r.isin("page_title", "share_title"), TITLE_MAX).when(r.isin("meta_description", "share_description"), DESCRIPTION_MAX))
    return F.array_min(bound)


def _finding(rows: DataFrame, rule: str, seq: int, severity: dict[str, str], message: Column, key: str | None = "key", own: Column | None = None) -> DataFrame:
    shown = F.lit(severity[rule]) if own is None else F.coalesce(own, F.lit(severity[rule]))
    page = F.col("page") if "page" in rows.columns else F.lit(None).cast("string")
    locale = F.col("locale") if "locale" in rows.columns else F.lit(None).cast("string")
    return rows.select(F.lit(rule).alias("rule"), shown.alias("severity"), F.lit(seq).alias("seq"), (F.col(key) if key else F.lit(None).cast("string")).alias("key"), page.alias("page"), locale.alias("locale"), message.alias("message"), F.create_map().cast("map<string,string>").alias("detail"))


def page_fields(d: Descriptor, resolved: DataFrame) -> DataFrame:
    """page, locale, route, tmpl_key and, of each SEO field, its key and its resolved text (null if blank)."""
    texts = resolved.select("key", "locale", js.json_string(F.col("value_json")).alias("text")).where(~js.is_blank(F.col("text")))
    pages = d.pages.select("page", "route", "seo", F.explode(F.coalesce("locales", F.array(F.lit("default")))).alias("locale"))
    fields = ("title", "description", "robots", "canonical", "og_image", "og_image_alt")
    refs = pages.select("page", "locale", F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f"seo.{f}"))])).alias("field", "key")).where("key is not null")
    held = refs.join(texts, ["key", "locale"], "left").groupBy("page", "locale").agg(*[F.max(F.when(F.col("field") == f, F.struct("key", "text"))).alias(f) for f in fields])
    # every rule reads it
    return settled(pages.drop("seo").join(held, ["page", "locale"], "left"))


def check(d: Descriptor, snapshot: DataFrame, resolved: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """All rules over declared pages. ``resolved`` holds key, locale, value_json of every key in every locale asked for."""
    s = severities(overrides)
    f = page_fields(d, resolved)
    parts = [
        missing_field(f, "title", 1, s), missing_field(f, "description", 2, s), over_length(d, f, "title", TITLE_MAX, 3, s), over_length(d, f, "description", DESCRIPTION_MAX, 4, s),
        missing_alt(f, s), canonical_noindex(f, resolved, d, s), visible_content(d, s), duplicate_titles(d, f, s), anchor_text(d, snapshot, resolved, s), machine_field(d, snapshot, resolved, s),
    ]
    return reduce(DataFrame.unionByName, parts)


def missing_field(f: DataFrame, field: str, seq: int, s: dict[str, str]) -> DataFrame:
    rows = f.where(F.col(f"{field}.text").isNull()).withColumn("key", F.col(f"{field}.key"))
    return _finding(rows, f"missing-{field}", seq, s, F.when(F.col("key").isNull(), f"the page declares no SEO {field}").otherwise(F.concat(F.lit(f"its {field} key "), "key", F.lit(" resolves to nothing"))))


def over_length(d: Descriptor, f: DataFrame, field: str, most: int, seq: int, s: dict[str, str]) -> DataFrame:
    rows = f.select("page", "locale", F.col(f"{field}.key").alias("key"), js.len16(F.col(f"{field}.text")).alias("size")).where(F.col("size") > most).join(d.keys.select("key", "limits"), "key", "left")
    own = F.when(F.col("limits").isNotNull(), F.when(F.col("limits.severity") == "hard", "error").otherwise("warning"))
    return _finding(rows, "over-length", seq, s, F.concat(F.lit(f"its {field} has "), "size", F.lit(f" characters, over {most}")), own=own)


def missing_alt(f: DataFrame, s: dict[str, str]) -> DataFrame:
    rows = f.where(F.col("og_image.text").isNotNull() & F.col("og_image_alt.text").isNull()).withColumn("key", F.col("og_image.key"))
    return _finding(rows, "missing-alt", 5, s, F.lit("its OG image has no resolving alt text"))


def canonical_noindex(f: DataFrame, resolved: DataFrame, d: Descriptor, s: dict[str, str]) -> DataFrame:
    """Pages whose canonical URL is the route of a page that isn't indexed; routes are compared trimmed, without one trailing slash."""
    robots = F.coalesce(js.json_string(F.col("value_json")), F.array_join(F.transform(js.json_list(F.col("value_json")), lambda e: F.coalesce(js.json_string(e), F.lit(""))), "\n"))
    closed = resolved.where(robots.rlike("(?i)" + js.whole_word("noindex"))).select(F.col("key").alias("robots_key"), "locale")
    targets = d.pages.select(F.col("page").alias("target"), route(F.col("route")).alias("at"), F.col("seo.robots").alias("robots_key")).join(closed, "robots_key").select("target", "at", "locale")
    rows = f.where("canonical.text is not null").select("page", "locale", F.col("canonical.key").alias("key"), route(F.col("canonical.text")).alias("at")).join(targets, ["at", "locale"])
    return _finding(rows, "canonical-noindex", 6, s, F.concat(F.lit("it canonicalizes to the route of page "), "target", F.lit(", which is noindex")))


def bindings(d: Descriptor) -> DataFrame:
    return d.pages.select("page", F.explode("json_ld.bindings").alias("field", "key"))


def visible_content(d: Descriptor, s: dict[str, str]) -> DataFrame:
    shown = d.keys.select("key", F.explode("pages").alias("page"))
    return _finding(bindings(d).join(shown, ["key", "page"], "left_anti"), "visible-content", 7, s, F.concat(F.lit("it binds JSON-LD field "), "field", F.lit(" to a key that doesn't render on the page")))


def duplicate_titles(d: Descriptor, f: DataFrame, s: dict[str, str]) -> DataFrame:
    own = f.where("title.text is not null").select("page", "locale", F.col("title.key").alias("key"), F.col("title.text").alias("title")).join(d.keys.select("key", "tmpl"), "key", "left")
    groups = own.groupBy("locale", "title").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("page")), ", ").alias("members"), F.count("tmpl").alias("t"), F.count_distinct("tmpl").alias("dt"), F.max("tmpl").alias("tmpl")).where("n > 1")
    message = F.when((F.col("t") == F.col("n")) & (F.col("dt") == 1), F.concat(F.lit('the derivation template "'), "tmpl", F.lit('" gives this title on '), "n", F.lit(" pages"))).otherwise(F.concat(F.lit("pages share a title: "), "members"))
    return _finding(groups, "duplicate-title", 8, s, message, key=None)


def _in_locales(snapshot: DataFrame, resolved: DataFrame) -> DataFrame:
    """Resolved rows of default and of the locales where the snapshot itself holds the key."""
    own = snapshot.select("key", "locale").distinct().withColumn("__held", F.lit(True))
    return resolved.join(own, ["key", "locale"], "left").where("__held or locale = 'default'").drop("__held")


def _texts(rows: DataFrame) -> DataFrame:
    one = F.when(js.json_kind(F.col("value_json")) == "string", F.array(F.struct(F.col("key").alias("path"), js.json_string(F.col("value_json")).alias("text"), F.lit(0).alias("i"))))
    many = F.transform(js.json_list(F.col("value_json")), lambda e, i: F.struct(F.concat(F.col("key"), F.lit("["), i.cast("string"), F.lit("]")).alias("path"), js.json_string(e).alias("text"), i.cast("int").alias("i")))
    return rows.select("*", F.explode(F.coalesce(one, many)).alias("s")).where("s.text is not null")


def anchor_text(d: Descriptor, snapshot: DataFrame, resolved: DataFrame, s: dict[str, str], phrases: tuple[str, ...] = GENERIC_ANCHORS) -> DataFrame:
    keys = d.keys.where("target = 'web' and shape in ('text', 'list')").select("key")
    rows = _texts(_in_locales(snapshot, resolved).join(keys, "key")).where(F.lower(js.trim(F.col("s.text"))).isin(*phrases)).withColumn("path", F.col("s.path"))
    return _finding(rows, "anchor-text", 9, s, F.concat(F.lit('"'), "s.text", F.lit('" is a generic link label')), key="path")


def imperative(text: Column) -> Column:
    """The first of IMPERATIVES in a text; null if there is none."""
    out = F.when(F.lit(False), F.lit(""))
    for p in IMPERATIVES:
        pattern = ("(?<![A-Za-z0-9_])" if p[0].isalnum() else "") + "\\Q" + p + "\\E" + ("(?![A-Za-z0-9_])" if p[-1].isalnum() else "")
        out = out.when(text.rlike("(?i)" + pattern), p)
    return out


def machine_field(d: Descriptor, snapshot: DataFrame, resolved: DataFrame, s: dict[str, str]) -> DataFrame:
    hits = _texts(_in_locales(snapshot, resolved)).withColumn("phrase", imperative(F.col("s.text"))).where("phrase is not null")
    first = hits.groupBy("key", "locale").agg(F.min_by("phrase", "s.i").alias("phrase"))
    return _finding(bindings(d).join(first, "key"), "machine-field", 10, s, F.concat(F.lit("JSON-LD field "), "field", F.lit(' carries "'), "phrase", F.lit('"')))


# --- documents: over the elements of versotext.operators.html --------------------

BCP47 = "^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$"


def document_rules(elements: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Accessibility rules over ``elements`` (page_id, el_id, parent_id, tag, attrs, text, path ...); no rule looks at a faulty element."""
    s = severities(overrides)
    e = elements.where("fault is null").withColumn("page", F.col("page_id").cast("string")).withColumn("key", F.col("el_id").cast("string"))
    attr = lambda name: F.element_at("attrs", F.lit(name))
    named = ~js.is_blank(attr("aria-label")) | ~js.is_blank(attr("aria-labelledby")) | ~js.is_blank(attr("title"))
    kind = F.lower(F.coalesce(attr("type"), F.lit("text")))
    controls = e.where((F.col("tag").isin("select", "textarea") | ((F.col("tag") == "input") & ~kind.isin("hidden", "submit", "reset", "button", "image"))) & ~named & ~F.array_contains("ancestors", "label"))
    targets = e.where("tag = 'label'").select("page_id", attr("for").alias("target")).where("target is not null").distinct()
    unlabelled = controls.withColumn("target", attr("id")).join(targets, ["page_id", "target"], "left_anti")
    nameless = e.where(F.col("tag").isin("a", "button") & js.is_blank(F.col("full_text")) & ~named & ~F.coalesce("has_alt", F.lit(False)))
    images = e.where("tag = 'img'")
    altless = images.where(attr("alt").isNull() & ~F.coalesce(attr("role").isin("presentation", "none"), F.lit(False)))
    alt = F.lower(js.trim(attr("alt")))
    redundant = images.where(reduce(lambda a, b: a | b, [alt.startswith(p) for p in REDUNDANT_PREFIXES]) | (alt == stem_words(F.coalesce(attr("src"), F.lit("")))))
    headings = e.where(F.col("tag").rlike("^h[1-6]$") & js.is_blank(F.col("full_text")) & ~F.coalesce("has_alt", F.lit(False)))
    lang = js.trim(attr("lang"))
    roots = e.where((F.col("tag") == "html") & (lang.isNull() | (lang == "") | ~lang.rlike(BCP47)))
    return reduce(DataFrame.unionByName, [
        _finding(unlabelled, "missing-label", 11, s, F.lit("a form control has no label")), _finding(nameless, "missing-name", 12, s, F.lit("a link or button has no name")),
        _finding(altless, "missing-alt", 13, s, F.lit("an image has no alt attribute")), _finding(headings, "empty-heading", 14, s, F.lit("a heading is empty")),
        _finding(roots, "missing-lang", 15, s, F.lit("the document names no valid language")), _finding(redundant, "redundant-alt", 16, s, F.lit("an alt text repeats what the image is or its file name")),
    ])


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
