"""The content operators on small tables: resolution, versions, rules, SEO, contacts, drift, texts, store."""

import json

import pytest
from pyspark.sql import functions as F

from versotext.functions import js
from versotext.functions import text as tx
from versotext.operators import contacts, descriptor, drift, html, resolve, rules, seo, store, versions
from versotext.operators import text as texts
from versotext.schema import CHANGESETS, CONTACTS, GROUPS, KEY_DEFS, MEMBERSHIPS, PAGE_DEFS, SUPPRESSIONS, TEMPLATE_DEFS, VERSIONS, Descriptor
from versotext.sources import files, sinks


def frame(spark, schema, rows):
    from pyspark.sql.types import _parse_datatype_string

    names = [f.name for f in _parse_datatype_string(schema).fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def make(spark, keys, pages=(), templates=()):
    base = {"shape": "text", "target": "web"}
    return Descriptor(frame(spark, KEY_DEFS, [base | k for k in keys]), frame(spark, PAGE_DEFS, pages), frame(spark, TEMPLATE_DEFS, templates))


def snap(spark, values):
    return spark.createDataFrame([(loc, k, json.dumps(v, ensure_ascii=False)) for loc, own in values.items() for k, v in own.items()], "locale string, key string, value_json string")


def stored(spark, rows):
    base = {"project": "p", "locale": "default", "state": "published", "is_active": True}
    return frame(spark, VERSIONS, [base | r | {"value_json": json.dumps(r["v"])} for r in rows])


def resolved(d, s, v, key, locale="default", preview=False):
    rows = resolve.get(d, s, v, key, locale, preview).collect()
    assert len(rows) == 1
    r = rows[0]
    return (None if r["value_json"] is None else json.loads(r["value_json"])), r["source"], [w["code"] for w in r["warnings"]]


# --- resolution -------------------------------------------------------------------


def test_resolution_order(spark):
    d = make(spark, [{"key": "a"}, {"key": "color", "shape": "color"}, {"key": "d", "derives_from": "a", "tmpl": "<{v}> {v}"}, {"key": "constructor"}])
    s = snap(spark, {"default": {"a": "committed", "color": "#fff", "d": "own"}, "de": {"a": "bestimmt"}})
    v = stored(spark, [{"id": 1, "key": "a", "v": "old"}, {"id": 5, "key": "a", "v": "live $1"}, {"id": 6, "key": "a", "v": "draft", "state": "draft", "is_active": None}, {"id": 7, "key": "color", "v": "red"}, {"id": 8, "key": "a", "v": "gone", "is_active": False}])
    none = v.limit(0)
    assert resolved(d, s, v, "a") == ("live $1", "active", [])
    assert resolved(d, s, v, "a", preview=True) == ("draft", "draft", [])
    assert resolved(d, s, v, "a", "de") == ("live $1", "active", [])
    assert resolved(d, s, none, "a", "de") == ("bestimmt", "snapshot", [])
    assert resolved(d, s, none, "a", "fr") == ("committed", "snapshot", [])
    assert resolved(d, s, v, "color") == ("#fff", "snapshot", ["malformed_value"])
    assert resolved(d, s, v, "d") == ("<live $1> {v}", "derived", [])
    assert resolved(d, s, v, "constructor") == (None, "snapshot", ["no_value"])
    assert resolve.get(d, s, v, "undeclared").count() == 0


def test_active_without_mark_and_malformed_latest(spark):
    d = make(spark, [{"key": "n", "shape": "number"}])
    v = stored(spark, [{"id": 1, "key": "n", "v": 1, "is_active": None}, {"id": 2, "key": "n", "v": "two", "is_active": None}, {"id": 3, "key": "n", "v": 3, "locale": "de"}])
    # the latest row is the live one, and it doesn't fit: no older row is taken
    assert resolved(d, snap(spark, {"default": {"n": 9}}), v, "n") == (9, "snapshot", ["malformed_value"])
    assert resolved(d, snap(spark, {"default": {"n": 9}}), v, "n", "de") == (3, "active", [])


def test_derivation_chains_and_cycles(spark):
    keys = [{"key": "a"}, {"key": "b", "derives_from": "a", "tmpl": "b({v})"}, {"key": "c", "derives_from": "b", "tmpl": "c({v})"}, {"key": "x", "derives_from": "y", "tmpl": "x({v})"}, {"key": "y", "derives_from": "x", "tmpl": "y({v})"}, {"key": "z", "derives_from": "none", "tmpl": "z({v})"}, {"key": "none"}, {"key": "t", "tags": 1}, {"key": "u", "derives_from": "t", "tmpl": "[{v}]"}, {"key": "num", "shape": "number"}, {"key": "m", "derives_from": "num", "tmpl": "{v} items"}]
    d, v = make(spark, keys), stored(spark, []).limit(0)
    s = snap(spark, {"default": {"a": "A", "x": "snap", "z": "own", "t": "go <1>there</1>", "num": 3}})
    assert resolved(d, s, v, "c") == ("c(b(A))", "derived", [])
    assert resolved(d, s, v, "x") == ("x(y(snap))", "derived", ["derivation_cycle"])
    value, source, warned = resolved(d, s, v, "z")
    assert (value, source) == ("own", "snapshot") and warned == ["no_value"]
    assert resolved(d, s, v, "u")[0] == "[go there]"
    assert resolved(d, s, v, "m")[0] == "3 items"
    live = stored(spark, [{"id": 1, "key": "b", "v": "stored"}])
    assert resolved(d, s, live, "c") == ("c(stored)", "derived", []) and resolved(d, s, live, "b")[1] == "active"


def test_pull_listing_accessor(spark):
    d = make(spark, [{"key": "a"}, {"key": "b"}, {"key": "d", "derives_from": "a", "tmpl": "{v}!"}])
    s = snap(spark, {"default": {"a": "A", "b": "B"}, "de": {"b": "Bde"}})
    v = stored(spark, [{"id": 4, "key": "a", "v": "live"}, {"id": 5, "key": "a", "v": "lebt", "locale": "de"}, {"id": 6, "key": "b", "v": "wip", "state": "draft", "is_active": False}])
    snapshot, bundle = resolve.pull(d, s, v)
    assert {tuple(r) for r in snapshot.collect()} == {("default", "a", '"live"'), ("default", "b", '"B"'), ("de", "a", '"lebt"'), ("de", "b", '"Bde"')}
    assert {(r.key, r.locale, r.version) for r in bundle.collect()} == {("a", "default", 4), ("b", "default", None), ("d", "default", None), ("a", "de", 5), ("b", "de", None)}
    rows = {r.key: r for r in resolve.listing(d, s, v).collect()}
    assert rows["a"].live_version == 4 and rows["b"].draft_pending and rows["d"].source == "derived"
    r = resolve.resolve_all(d, s, v, ["default"])
    ask = spark.createDataFrame([("a", "default"), ("nope", "default")], "key string, locale string")
    assert {x.key: x.value_json for x in resolve.accessor(d, r, ask, '"?"').collect()} == {"a": '"live"', "nope": '"?"'}
    with pytest.raises(Exception, match="unknown key"):
        resolve.accessor(d, r, ask).collect()
    one = resolve.diff_of(d, s, v, "b").collect()[0]
    assert (one.committed_json, one.live_json, one.draft_json) == ('"B"', '"B"', '"wip"')


# --- strings ----------------------------------------------------------------------------


def col(spark, expression):
    return spark.range(1).select(expression.alias("x")).collect()[0]["x"]


def test_javascript_strings(spark):
    lit = F.lit
    assert col(spark, js.len16(lit("a😀"))) == 3 and col(spark, js.trim(lit(" ﻿ a b "))) == "a b"
    assert col(spark, lit("saleé").rlike(js.whole_word("sale"))) and not col(spark, lit("wholesale").rlike(js.whole_word("sale")))
    assert col(spark, js.canonical_json(lit('{"b":1.0,"a":[1.50,null]}'))) == '{"a":[1.5,null],"b":1}'
    kinds = {'"x"': "string", "1": "number", "1.5e300": "number", "true": "boolean", "null": "null", "[]": "array", '["a",1]': "array", "{}": "object", "{": None}
    assert {k: col(spark, js.json_kind(lit(k))) for k in kinds} == kinds
    assert col(spark, js.as_text(lit('["a","b"]'))) == "a,b" and col(spark, js.as_text(lit("2.50"))) == "2.5"
    assert json.loads(col(spark, js.to_json_string(lit('q"\n\\é')))) == 'q"\n\\é'


def test_text_functions(spark):
    lit = F.lit
    assert col(spark, tx.normal_email(lit("﻿ A@B.De "))) == "a@b.de" and col(spark, tx.plain_of(lit("a<1>b</1>c<2/>d"))) == "abc d"
    assert col(spark, tx.vars_of(lit("{{ b }} {{a}} {{b}}"))) == ["a", "b"]
    assert col(spark, tx.to_double_braces(lit("{x} {{y}}"))) == "{{x}} {{y}}" and col(spark, tx.to_single_braces(lit("{{ x }}"))) == "{x}"
    assert col(spark, tx.escape_html(lit("<a&'\">"))) == "&lt;a&amp;&#39;&quot;&gt;"
    assert col(spark, tx.decode_entities(lit("&amp;&#65;&#x42;&#xD800;&#1114112;&nope;"))) == "&AB&#xD800;&#1114112;&nope;"
    assert col(spark, tx.undecoded_entities(lit("&nope;&amp;&nope;"))) == ["&nope;"]
    assert col(spark, tx.words_of(lit("heroTitle  Now!"))) == "hero_title_now" and col(spark, tx.first_words(lit("one_two_three_four"), 3, 8)) == "one_two"
    assert col(spark, tx.propose_key(lit("The quick brown fox jumps over the lazy dog"))) == "the_quick_brown_fox_jumps_over_the_lazy"
    assert col(spark, tx.derive_label(lit("home__hero_title"))) == "Hero title"
    assert col(spark, tx.base_name(F.array(lit("a"), lit(""), lit("b")))) == "a__b" and len(col(spark, tx.base_name(F.array(lit("a" * 30), lit("b" * 40))))) <= 48
    assert [col(spark, tx.qualifies_as_copy(lit(t))) for t in ("ab", "1a", "12", "é", "<1>a</1>", "{{name}}")] == [True, True, False, False, False, False]
    assert col(spark, tx.route(lit(" /a/ "))) == "/a" and col(spark, tx.file_route(lit("blog/index.html"))) == "/blog" and col(spark, tx.file_route(lit("index.html"))) == "/"
    assert [col(spark, tx.route_depth(lit(t))) for t in ("/", "/a", "/a/b/")] == [0, 1, 2]
    assert [col(spark, tx.word_bounded(lit("art"), lit(t))) for t in ("smart art", "arté", "(art)", "a\\E art")] == [6, -1, 1, 4]
    assert col(spark, tx.stem_words(lit("/img/Team-photo_2.png?x=1"))) == "team photo 2"
    token = col(spark, tx.mint_token("k")(lit('{"exp":5}')))
    assert col(spark, tx.verify_token("k")(lit(token))) == '{"exp":5}' and col(spark, tx.verify_token("other")(lit(token))) is None
    assert col(spark, tx.verify_token("k", now=6)(lit(token))) is None and col(spark, tx.verify_token("k", now=4)(lit(token))) is not None and col(spark, tx.verify_token("k")(lit("rubbish"))) is None
    assert col(spark, tx.substitute(lit("Hi {{ name }}, {{x}}"), F.create_map(lit("name"), lit("{{x}} $1")))) == "Hi {{x}} $1, {{x}}"
    assert col(spark, lit("a/b/c.html").rlike(tx.glob_regex("**/*.html"))) and not col(spark, lit("a/b.html").rlike(tx.glob_regex("*.html")))
    assert col(spark, tx.line_of(lit("a\nbc\nd"), lit(5))) == 3 and col(spark, tx.column_of(lit("a\nbc"), lit(3))) == 2
    assert col(spark, tx.origin(lit("https://a.b:8/c?d"))) == "https://a.b:8" and col(spark, tx.path_of(lit("https://a.b/c?d"))) == "/c"
    assert col(spark, tx.one_line(lit("a\x00\nb" + "x" * 300))).startswith("a b") and len(col(spark, tx.one_line(lit("x" * 300)))) == 200


# --- rules ------------------------------------------------------------------------------------


def rules_of(findings):
    return sorted((r.rule, r.severity, r.key or "") for r in findings.collect())


def test_value_rules(spark):
    keys = [
        {"key": "t", "limits": (5, "hard")}, {"key": "soft", "limits": (3, "advisory"), "tags": 1}, {"key": "l", "shape": "list", "limits": (2, "hard")}, {"key": "r", "shape": "record", "limits": (2, "hard")},
        {"key": "v", "vars": ["name"], "requires": ["name", "link"]}, {"key": "mail", "target": "html-email"}, {"key": "b", "budget": (1, 1)}, {"key": "w__subject"}, {"key": "e", "shape": "enum", "values": ["x"]}, {"key": "c", "shape": "color"},
    ]
    d = make(spark, keys, templates=[{"template": "w", "class": "transactional", "slots": ["subject"]}])
    s = snap(spark, {"default": {"t": "😀😀😀", "soft": "<1>abc</1>", "l": ["ab", "abc"], "r": {"f": "abc", "g": 1}, "v": "Hi {{ nom }} {{name}} {{nom}}", "mail": "a <b>x</b> <x-y/>", "b": "x" * 41 + "\r\n", "w__subject": "50 % sale\nnow", "e": "y", "c": "#12"}})
    assert rules_of(rules.check_snapshot(d, s)) == sorted([
        ("limit", "error", "t"), ("limit", "error", "l[1]"), ("limit", "error", "r.f"), ("vars", "error", "v"), ("requires", "error", "v"), ("construct", "error", "mail"), ("budget", "warning", "b"),
        ("subject", "error", "w__subject"), ("class", "warning", "w__subject"), ("shape", "error", "e"), ("shape", "error", "c"),
    ])
    budget = [r.detail for r in rules.over_budget(d, s).collect()][0]
    assert budget["device"] == "mobile" and budget["estimate"] == "3"
    first = rules.ordered(rules.check_snapshot(d, s)).collect()
    assert [r.severity for r in first] == sorted(r.severity for r in first)


@pytest.mark.parametrize("text,fault", [("<1>a</1><2/>", None), ("<1>a", "tag 2 missing|left open"), ("<1><2></1></2>", "out of turn"), ("<1/><1/><2/>", "twice"), ("<3/>", "undeclared"), ("plain", "tag 1 missing"), ("</1>", "out of turn")])
def test_tags(text, fault):
    import re

    found = rules.tag_fault(text, 2)
    assert found is None if fault is None else re.search(fault, found)


def test_marketing(spark):
    templates = [{"template": "m", "class": "marketing", "slots": ["body"]}, {"template": "n", "class": "marketing", "slots": ["body"], "wrapper_provides": ["unsubscribe_url", "postal_address"]}, {"template": "m__x", "class": "transactional", "slots": ["body"]}]
    d = make(spark, [{"key": k} for k in ("m__body", "n__body", "m__x__body", "brand__footer_address")], templates=templates)
    plain = snap(spark, {"default": {"m__body": "hi", "n__body": "sale", "m__x__body": "a wholesale thing"}})
    assert rules_of(rules.class_rules(d, plain)) == [("class", "error", "m"), ("class", "warning", "m")]
    good = snap(spark, {"default": {"m__body": "{{ unsubscribe_url }}", "brand__footer_address": "Street 1", "m__x__body": "5% off"}})
    assert rules_of(rules.class_rules(d, good)) == [("class", "warning", "m__x__body")]
    owners = {r.key: r.template for r in rules.template_of(d.keys.select("key"), d.templates).collect()}
    assert owners == {"m__body": "m", "n__body": "n", "m__x__body": "m__x"}


def test_contact_rules(spark):
    bad = {"a@b.c": None, "a b@c.d": "form", "x": "form", "a@b.c\x01": "control", "a" * 250 + "@b.cd": "length"}
    assert {k: col(spark, rules.email_fault(F.lit(k))) for k in bad} == bad
    groups = frame(spark, GROUPS, [{"project": "p", "key": "g", "properties": [("role", "enum", ["a", "b"], True), ("city", "text", None, False)]}, {"project": "p", "key": "Bad!"}, {"project": "p", "key": "h", "properties": [("q", "enum", None, False)]}])
    rows = spark.createDataFrame([(1, "p", "g", {"role": "a"}), (2, "p", "g", {"city": "x"}), (3, "p", "g", {"role": "z", "city": "x" * 501}), (4, "p", "g", {"role": "a", "zip": "1"}), (5, "p", "g", {"role": "a", "city": "x" * 501})], "row_id int, project string, group_key string, answers map<string,string>")
    assert {r.row_id: (r.question, r.code) for r in rules.answer_faults(rows, groups).collect()} == {2: ("role", "required"), 3: ("role", "not_in_list"), 4: ("zip", "unknown_question"), 5: ("city", "too_long")}
    assert {(r.key, r.fault) for r in rules.group_faults(groups).collect()} == {("Bad!", "key"), ("h", "enum_without_values")}
    imports = spark.createDataFrame([(1, "a@b.c", "2024-01-31T10:00Z"), (2, "a@b.c", "2024-02-31T10:00Z"), (3, "a@b.c", "2024-01-31"), (4, "a@b.c", "2030-01-01T00:00:00Z"), (5, "nope", ""), (6, "a@b.c", "")], "row_id int, email string, at string")
    assert {r.row_id: r.fault for r in rules.import_faults(imports, "2025-01-01 00:00:00", "at").collect()} == {2: "date", 3: "date", 4: "future", 5: "email"}
    assert [r.fields for r in rules.contact_smell(snap(spark, {"default": {"a": {"email": "x", "Phone": "y"}, "b": {"email": "x"}}})).collect()] == ["email,phone"]


# --- seo ------------------------------------------------------------------------------------------


def site(spark, values, pages, keys=()):
    names = {k for own in values.values() for k in own} | {k["key"] for k in keys}
    extra = {k["key"]: k for k in keys}
    d = make(spark, [{"key": k, "pages": ["home", "about"]} | extra.get(k, {}) for k in sorted(names)], pages)
    s = snap(spark, values)
    return rules_of(seo.check(d, s, resolve.resolve_all(d, s, stored(spark, []).limit(0), ["default", "de"])))


SEO = {"title": "t1", "description": "d1"}


def test_clean_site_has_no_findings(spark):
    values = {"default": {"t1": "Home", "t2": "About", "d1": "A site"}}
    assert site(spark, values, [{"page": "home", "route": "/", "seo": SEO}, {"page": "about", "route": "/about", "seo": SEO | {"title": "t2"}}]) == []


def test_seo_rules(spark):
    long = "x" * 61
    values = {"default": {"t1": long, "d1": "  ", "img": "i.png", "can": "/about/", "rob": ["noindex", "nofollow"], "anchor": "Click here ", "bad": "Buy now and act now"}, "de": {"t1": "kurz"}}
    pages = [
        {"page": "home", "route": "/", "locales": ["default", "de"], "seo": SEO | {"og_image": "img", "canonical": "can"}, "json_ld": ("Thing", {"name": "bad"})},
        {"page": "about", "route": "/about", "seo": {"title": "t1", "robots": "rob"}},
    ]
    keys = [{"key": "t1", "limits": (100, "advisory")}, {"key": "rob", "shape": "list"}, {"key": "bad", "pages": ["about"]}]
    found = site(spark, values, pages, keys)
    assert sorted(r for r, _, _ in found) == sorted(["over-length", "over-length", "duplicate-title", "missing-description", "missing-description", "missing-description", "missing-alt", "missing-alt", "canonical-noindex", "canonical-noindex", "anchor-text", "visible-content", "machine-field"])
    assert ("over-length", "warning", "t1") in found and ("anchor-text", "warning", "anchor") in found


def test_severity_overrides():
    assert seo.severities({"anchor-text": "error"})["anchor-text"] == "error"
    with pytest.raises(ValueError):
        seo.severities({"anchor-text": "off"})


def test_html_elements_and_rules(spark):
    page = """<!doctype html><html><body><!-- <p>no</p> --><h1>Hello <b>big</b> <br>world &amp; all</h1><script>var x = "<p>";</script>
<label for="a">A</label><input id="a"><input id="b"><label>C <input id="c"></label><input type="hidden"><a href="/x"></a><a href="/y"><img src="/p/team-photo.png" alt="Team photo"></a>
<img src="x.png"><h2> </h2><button aria-label="go"></button><pre>raw <i>x</i></pre><title>A <b>t</title><p>open <i>never closed</p></div><span title="Tip top">s1</span></body></html>"""
    e = html.elements(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string"))
    rows = e.collect()
    by = {}
    for r in rows:
        by.setdefault(r.tag, []).append(r)
    assert by["h1"][0].text == "Hello <1>big</1> <2/>world & all" and by["h1"][0].tags == 2 and by["h1"][0].key_element
    assert "p" in by and by["i"][1].fault == "unclosed <i>" and by["title"][0].full_text == "A <b>t" and by["body"][0].fault == "stray </div>"
    assert by["pre"][0].key_element is False and by["h1"][0].line == 1 and by["h1"][0].offset == page.index("<h1>")
    found = sorted((r.rule, r.key) for r in seo.document_rules(e).collect())
    ids = {(r.tag, (r.attrs or {}).get("id") or (r.attrs or {}).get("href") or (r.attrs or {}).get("src")): str(r.el_id) for r in rows}
    assert found == sorted([("missing-label", ids[("input", "b")]), ("missing-name", ids[("a", "/x")]), ("missing-alt", ids[("img", "x.png")]), ("redundant-alt", ids[("img", "/p/team-photo.png")]), ("empty-heading", str(by["h2"][0].el_id)), ("missing-lang", str(by["html"][0].el_id))])
    places = [(r.place, r.text) for r in html.proposals(e).collect()]
    assert ("text", "Hello <1>big</1> <2/>world & all") in places and ("@alt", "Team photo") in places and ("@title", "Tip top") in places and all("raw" not in t for _, t in places)


# --- contacts ------------------------------------------------------------------------------------------


def test_contacts(spark):
    import datetime as dt

    t = [dt.datetime(2024, 1, i) for i in range(1, 9)]
    people = frame(spark, CONTACTS, [{"id": 1, "project": "p", "email": "a@x.y"}, {"id": 2, "project": "p", "email": "b@x.y"}])
    members = frame(spark, MEMBERSHIPS, [{"id": 1, "contact_id": 1, "project": "p", "group_key": "g", "joined_at": t[0], "form": "f0", "updated_at": t[0], "properties": {"c": "1"}}])
    groups = frame(spark, GROUPS, [{"project": "p", "key": "g", "state": "open"}, {"project": "p", "key": "shut", "state": "closed"}])
    held = frame(spark, SUPPRESSIONS, [{"email": "b@x.y", "scope": "all", "source": "bounce"}, {"email": "z@x.y", "scope": "g", "source": "person"}])
    assert {(r.key, r.members) for r in contacts.group_counts(groups, members).collect()} == {("g", 1), ("shut", 0)}
    records = {r.email: (len(r.memberships), len(r.suppressions)) for r in contacts.contact_records(people, members, held).collect()}
    assert records == {"a@x.y": (1, 0), "b@x.y": (0, 1), "z@x.y": (0, 1)}
    joins = spark.createDataFrame([("p", "g", " A@X.y", t[5], "f2", "/2", {"c": "9"}), ("p", "g", "b@x.y", t[3], "f1", "/1", {"c": "3"}), ("p", "g", "b@x.y", t[4], "f3", "/3", None), ("p", "shut", "a@x.y", t[1], "f", "/", None)], "project string, group_key string, email string, at timestamp, form string, page string, properties map<string,string>")
    out = {r.email: (r.joined_at, r.form, (r.properties or {}).get("c"), r.is_new, r.suppressed) for r in contacts.joined(joins, groups, people, members, held).collect()}
    assert out == {"a@x.y": (t[0], "f0", "9", False, False), "b@x.y": (t[3], "f1", None, True, True)}
    rows = spark.createDataFrame([(e,) for e in ("a@x.y", "B@x.y", "c@x.y", "d@x.y")], "email string")
    erased = spark.createDataFrame([("a@x.y",), ("d@x.y",)], "email string").select(tx.erasure_hash("s", F.col("email")).alias("email_hash"))
    got = {r.email: r.outcome for r in contacts.import_outcomes(rows, people, held, erased, "s", ["all"]).collect()}
    assert got == {"a@x.y": "erased", "b@x.y": "suppressed", "c@x.y": "joined", "d@x.y": "erased"}
    left, kept, hashes = contacts.erase(people, members, spark.createDataFrame([], "project string, email_hash string, erased_at timestamp"), people.where("id = 1"), "s", F.to_timestamp(F.lit("2024-01-01")))
    assert left.count() == 1 and kept.count() == 0 and hashes.count() == 1
    again, answers = contacts.add_groups(groups, frame(spark, GROUPS, [{"project": "p", "key": "g"}, {"project": "p", "key": "new"}]))
    assert again.count() == 3 and {(r.key, r.answer) for r in answers.collect()} == {("g", "group_exists"), ("new", "ok")}
    changed, answers = contacts.set_group_states(groups, spark.createDataFrame([("p", "shut", "open"), ("p", "no", "open")], "project string, key string, new_state string"))
    assert {r.state for r in changed.collect()} == {"open"} and {(r.key, r.answer) for r in answers.collect()} == {("shut", "ok"), ("no", "unknown_group")}
    assert contacts.suppress(held, held.withColumn("source", F.lit("again")).withColumn("created_at", F.lit(None).cast("timestamp"))).count() == 2


# --- drift and descriptor -----------------------------------------------------------------------------------


def test_drift(spark):
    before = snap(spark, {"default": {"a": {"x": 1, "y": 2}, "b": "1", "old": "same", "n": None}, "de": {"old": "gleich"}})
    after = snap(spark, {"default": {"a": {"y": 2, "x": 1.0}, "b": "2", "new": "same"}, "de": {"new": "gleich"}})
    assert {(r.locale, r.key, r.change) for r in drift.snapshot_diff(before, after).collect()} == {("default", "b", "changed"), ("default", "old", "removed"), ("default", "new", "added"), ("de", "old", "removed"), ("de", "new", "added"), ("default", "n", "removed")}
    assert [tuple(r) for r in drift.renames_in(before, after).collect()] == [("old", "new")]
    st = spark.createDataFrame([("a", "approved"), ("b", "approved"), ("gone", "approved")], "key string, state string").withColumn("at", F.lit(None).cast("timestamp")).withColumn("by", F.lit("me"))
    assert {r.key: r.state for r in drift.reset_statuses(st, before, after).collect()} == {"a": "approved", "b": "proposed", "new": "proposed"}
    files_ = spark.createDataFrame([("f1", "s", "s", "c", "c"), ("f2", "s2", "s", "c", "c"), ("f3", "s2", "s", "c2", "c")], "path string, source_hash string, recorded_source_hash string, content_hash string, recorded_content_hash string")
    assert {r.path: r.state for r in drift.freshness(files_).collect()} == {"f1": "current", "f2": "staleSource", "f3": "handEdited"}
    marked = spark.createDataFrame([("i", "b", "2", 0), ("i", "zz", "x", 0), ("j", "new", "same", 0), ("k", "new", "other", 0), ("k", "b", "2", 1)], "file string, key string, text string, tags int")
    d = drift.document_drift(marked, after.where("locale = 'default'"))
    assert sorted(r.drift for r in d.collect()) == ["current", "current", "differs", "tag_count", "unknown_mark"]
    assert {r.file: r.state for r in drift.document_states(d).collect()} == {"i": "differs", "j": "current", "k": "differs"}
    pages = spark.createDataFrame([("home", "/"), ("lost", "/lost")], "page string, route string")
    found = spark.createDataFrame([("index.html", "/"), ("x.html", "/x")], "path string, route string")
    assert {tuple(r) for r in drift.auditable_pages(pages, found).collect()} == {("home", "/", "index.html"), ("lost", "/lost", None), (None, "/x", "x.html")}
    runs = spark.createDataFrame([("g", 1, 0.5), ("g", 2, 0.9), ("g", 3, 0.5), ("g", 4, 1.0), ("g", 5, None)], "g string, run int, score double")
    r = drift.median_runs(runs, ["g"]).collect()[0]
    assert (r.median, r.run, r.percent) == (0.5, 1, 50)


def test_descriptor_changes(spark):
    keys = [{"key": "a", "pages": ["p1"]}, {"key": "b", "pages": ["p2"]}, {"key": "d", "derives_from": "a", "tmpl": "{v}!"}, {"key": "t__s"}]
    pages = [{"page": "p1", "route": "/", "seo": {"title": "a"}, "json_ld": ("T", {"name": "a"})}, {"page": "p2", "route": "/2"}]
    d = make(spark, keys, pages, [{"template": "t", "class": "transactional", "slots": ["s"]}])
    s = snap(spark, {"default": {"a": "x", "b": "x", "t__s": "q"}})
    out, values = descriptor.rename_keys(d, s, spark.createDataFrame([("a", "z")], "old_key string, new_key string"))
    assert {r.key: r.derives_from for r in out.keys.collect()} == {"z": None, "b": None, "d": "z", "t__s": None}
    p = {r.page: r for r in out.pages.collect()}
    assert p["p1"].seo.title == "z" and p["p1"].json_ld.bindings == {"name": "z"} and p["p2"].seo is None and {r.key for r in values.collect()} == {"z", "b", "t__s"}
    merges = spark.createDataFrame([("a", "b")], "gone string, survivor string")
    assert descriptor.merge_faults(d, s, merges).count() == 0 and [r.reason for r in descriptor.merge_faults(d, s, spark.createDataFrame([("a", "t__s")], "gone string, survivor string")).collect()] == ["values"]
    out, values = descriptor.merge_keys(d, s, merges)
    k = {r.key: r for r in out.keys.collect()}
    assert set(k) == {"b", "d", "t__s"} and sorted(k["b"].pages) == ["p1", "p2"] and k["d"].derives_from == "b" and values.count() == 2
    r = resolve.resolve_all(d, s, stored(spark, []).limit(0), ["default"])
    out, values, left = descriptor.remove_keys(d, s, r, spark.createDataFrame([("a",), ("t__s",)], "key string"))
    assert {(x.key, x.value_json) for x in values.collect()} == {("b", '"x"'), ("d", '"x!"')} and [x.missing for x in left.collect()] == ["t__s"]
    assert {x.key: x.derives_from for x in out.keys.collect()} == {"b": None, "d": None} and out.pages.where("page = 'p1'").collect()[0].seo.title is None
    out, values = descriptor.split_key(d, s, "a", "a2")
    assert out.keys.count() == 5 and values.where("key = 'a2'").count() == 1
    names = spark.createDataFrame([("a.b",), ("a_b",), ("ab",), ("a",)], "key string")
    assert {r.key for r in descriptor.by_entries(names, spark.createDataFrame([("a.",), ("ab",)], "entry string")).collect()} == {"a.b", "ab"}
    assert {r.key for r in descriptor.with_siblings(d, spark.createDataFrame([("t__s",)], "key string")).collect()} == {"t__s", "brand__footer_address"}
    table = spark.createDataFrame([("a", '"Hi {x}"'), ("b", '["v", {"m": 1}]'), ("c", '{"value": "w"}'), ("n", "3")], "key string, entry_json string")
    assert {r.key: r.value_json for r in descriptor.import_rows(table, placeholders=True).collect()} == {"a": '"Hi {{x}}"', "b": '"v"', "c": '"w"'}
    faults = {(r.kind, r.missing) for r in drift.referential_faults(make(spark, [{"key": "k", "derives_from": "no", "pages": ["np"]}], [{"page": "p", "seo": {"title": "nt"}, "parent": "pp"}], [{"template": "t", "slots": ["s"]}])).collect()}
    assert faults == {("derives_from", "no"), ("page", "np"), ("seo", "nt"), ("parent", "pp"), ("slot", "t__s")}


# --- texts ----------------------------------------------------------------------------------------------------


def test_texts(spark):
    rows = spark.createDataFrame([("d", "h", "Fresh bread every day"), ("d", "t", "Fresh bread every day | Bakery"), ("d", "x", "Bread"), ("d", "e", "Bread"), ("o", "h2", "Fresh bread every day")], "doc string, key string, text string")
    assert {(r.key, r.source, r.tmpl) for r in texts.derivations(rows).collect()} == {("t", "h", "{v} | Bakery"), ("x", "e", "{v}")}
    assert {r.text for r in texts.only_in_one(rows).collect()} == {"Fresh bread every day | Bakery", "Bread"}
    own = spark.createDataFrame([(1, "we bake bread every day"), (2, "we bake cakes every day"), (3, "we bake bread every"), (4, "a b c"), (5, "a b d"), (6, "we sell cakes every day")], "id long, text string")
    assert {tuple(r) for r in texts.near_repeats(own, own, same=True).collect()} == {(1, 2), (2, 6)}
    long = spark.createDataFrame([(1, "today we bake rolls every day and rest"), (2, "we bake bread every day")], "id long, text string")
    assert {tuple(r) for r in texts.near_windows(own, long).collect()} == {(1, 1), (2, 1), (2, 2), (3, 1)}
    known = spark.createDataFrame([(1, "fresh bread here"), (2, "fresh bread here daily"), (3, "bread here daily too"), (4, "short")], "id long, text string")
    inside = spark.createDataFrame([(7, "so fresh bread here daily too, fresh bread hereby, fresh bread here"), (8, None)], "id long, text string")
    assert {tuple(r) for r in texts.contained_phrases(inside, known).collect()} == {(7, 2, 3), (7, 1, 51)}
    shown = spark.createDataFrame([(1, "Hello  Ann"), (2, "Bye"), (3, "5 items left"), (4, "Hello")], "el_id int, text string")
    values = spark.createDataFrame([("greet", "Hello {{name}}"), ("bye", "Bye"), ("left", "{{n}} items left")], "key string, text string")
    assert {tuple(r) for r in texts.census(shown, values).collect()} == {(1, "greet"), (2, "bye"), (3, "left")}
    places = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a_1"), (4, "a"), (5, "b")], "ord long, base string")
    taken = spark.createDataFrame([("a_2",), ("c",)], "name string")
    assert {r.ord: r.name for r in texts.number_names(places, taken).collect()} == {1: "a", 2: "a_1", 3: "a_1_1", 4: "a_3", 5: "b"}
    d = make(spark, [{"key": "a"}, {"key": "b"}, {"key": "brand__n"}, {"key": "tagged", "tags": 1}])
    s = snap(spark, {"default": dict.fromkeys(("a", "b", "brand__n", "tagged"), "same")})
    assert [r["keys"] for r in texts.duplicate_texts(d, s).collect()] == [["a", "b"]]


def test_loose_patterns_meet_by_anchor(spark):
    shown = {1: "5 items left", 2: "total: 7%", 3: "7%", 4: "a-b", 5: "Hello Ann Lee", 6: "", 7: "left items 5", 8: "\\Q.x"}
    values = {"n": "{{n}} items left", "p": "{{ n }}%", "d": "{{a}}-{{b}}", "any": "{{x}}", "h": "{{g}} Ann {{s}}", "t": "total: {{n}}%", "q": "\\Q{{x}}x"}
    import re

    pattern = lambda v: "^" + "(.+)".join(map(re.escape, re.split(r"\{\{\s*[a-zA-Z0-9_]+\s*\}\}", v))) + "$"
    expected = {(i, k) for i, t in shown.items() for k, v in values.items() if re.match(pattern(v), t)}
    e, v = spark.createDataFrame(list(shown.items()), "el_id int, text string"), spark.createDataFrame(list(values.items()), "key string, text string")
    out = texts.census(e, v)
    assert {tuple(r) for r in out.collect()} == expected and (5, "h") in expected and (8, "q") in expected
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_census_broadcasts_only_what_was_counted(spark):
    """The planner takes all these sides for small ones, elements with a row for each word and character among them."""
    e = spark.range(40).selectExpr("id as el_id", "case when id % 2 = 0 then 'Element ' || id else 'Hello guest ' || id || ' left' end as text")
    v = spark.range(40).selectExpr("'k' || id as key", "case when id % 4 = 0 then 'Element ' || id when id % 4 = 1 then 'Hello {{name}} ' || id || ' left' else 'no ' || id end as text")
    expected = {(i, f"k{i}") for i in range(40) if i % 4 < 2}
    for small_bytes, broadcasts in ((None, 1), (0, 0)):
        out = texts.census(e, v) if small_bytes is None else texts.census(e, v, small_bytes)
        assert out._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == broadcasts
        assert {tuple(r) for r in out.collect()} == expected


def test_numbers_of_names(spark):
    """Against the rule itself, place by place, with bases that meet each other's numbers and one very frequent base."""
    import random

    r = random.Random(3)
    bases = ["hot"] * 300 + [r.choice(["a", "a_1", "b", "c", "c_2", "d", "e_x"]) for _ in range(120)]
    r.shuffle(bases)
    taken = ["b", "d_1", "a_3", "zz", "hot"]
    used, expected = set(taken), {}
    for i, base in enumerate(bases):
        name, n = base, 0
        while name in used:
            n += 1
            name = f"{base}_{n}"
        used.add(name)
        expected[i] = name
    out = texts.number_names(spark.createDataFrame(list(enumerate(bases)), "ord long, base string"), spark.createDataFrame([(t,) for t in taken], "name string"))
    assert {x.ord: x.name for x in out.collect()} == expected


def test_long_pages_are_scanned_in_proportion():
    import time

    for page in ("<a " * 350_000, '<a href="' * 100_001, "<a<a" * 200_000, "<a<a/ " * 150_000 + '"', "<p x='y\" " * 100_000, "<b></i>" * 100_000, "<title>" * 100_000, "<script " * 100_000, "</script " * 100_000):
        begin = time.process_time()
        html.scan(page)
        assert time.process_time() - begin < 4, page[:12]
    assert [(e.tag, e.attrs) for e in html.scan('<a <b x="1"> <i "> <u>')] == [("a", {"<b": "", "x": "1"}), ("u", {})]


# --- versions and the store ----------------------------------------------------------------------------------------


def test_version_reads(spark):
    assert [versions.page_limit(x) for x in (None, float("nan"), 0, 7.9, 999)] == [50, 50, 1, 7, 200]
    v = stored(spark, [{"id": i, "key": "k", "v": str(i // 2)} for i in range(1, 8)])
    page = versions.newest_page(v, 3, before=7)
    assert [r.id for r in page.collect()] == [6, 5, 4] and versions.next_cursor(page, 3) == 4 and versions.next_cursor(versions.newest_page(v, 100), 100) is None
    assert [r.id for r in versions.change_runs(v, ["key"], "id", "value_json").orderBy("id").collect()] == [1, 2, 4, 6]
    assert versions.read(v, "p", []).count() == 0 and versions.read(v, "q").count() == 0 and versions.read(v, "p").count() == 7
    commits = spark.createDataFrame([(1, "c1", '{"default":{}}'), (2, "c2", '{"default":{"k":"a"}}'), (3, "c3", '{"default":{"k":"a"}}'), (4, "c4", '{"default":{}}')], "seq int, commit string, snapshot_json string")
    assert [(r.commit, r.value) for r in versions.key_history(commits, "k").collect()] == [("c4", ""), ("c2", "a")]


def run_log(spark, log, rows=(), first=100):
    commands = [("p", i, verb, json.dumps(args), editor, None) for i, (verb, args, editor) in enumerate(log)]
    c = spark.createDataFrame(commands, "project string, ord long, verb string, args_json string, editor string, at timestamp").withColumn("at", F.to_timestamp(F.concat(F.lit("2024-01-01 00:00:"), F.lpad(F.col("ord").cast("string"), 2, "0"))))
    out = store.fold(stored(spark, rows), frame(spark, CHANGESETS, []), c, first, block=10)
    answers = [(r.ok, r.error.split(":")[0] if r.error else json.loads(r.result_json)) for r in out["answers"].orderBy("ord").collect()]
    return answers, {r.id: r for r in out["versions"].collect()}, {r.id: r for r in out["changesets"].collect()}, out["renames"].collect()


def test_store_drafts_and_publication(spark):
    save = lambda key, value, **more: {"key": key, "value": value} | more
    answers, rows, _, renames = run_log(spark, [
        ("save", save("a", "1"), "ann"), ("save", save("a", "2"), "bob"), ("save", save("a", "3", force=True), "bob"), ("publish", {"key": "a"}, "bob"), ("publish", {"key": "a"}, "bob"),
        ("save", save("a", "4"), "ann"), ("publish", {"key": "a"}, "ann"), ("revert", {"version": 100}, "cy"), ("discard", {"key": "a"}, "cy"), ("rename", {"old_key": "a", "new_key": "b"}, "cy"), ("rename", {"old_key": "x", "new_key": "b"}, "cy"), ("revert", {"version": 100, "expect_active": 1}, "cy"),
    ])
    assert answers == [(True, 100), (False, "draft_held"), (True, 100), (True, 100), (False, "no_draft"), (True, 150), (True, 150), (True, 170), (False, "no_draft"), (True, 3), (False, "key_taken"), (False, "stale_active")]
    assert {i: (r.key, r.value_json, r.is_active, r.reverted_from) for i, r in rows.items()} == {100: ("b", '"3"', False, None), 150: ("b", '"4"', False, None), 170: ("b", '"3"', True, 100)}
    assert len(renames) == 1 and rows[100].editor == "bob" and rows[100].published_by == "bob" and rows[150].created_at is not None


def test_store_changes(spark):
    old = [{"id": 1, "key": "a", "v": "old"}, {"id": 2, "key": "far", "v": "kept"}]
    answers, rows, changes, _ = run_log(spark, [
        ("open_change", {"name": "c"}, "ann"), ("schedule_change", {"change": 100, "publish_at": "2024-01-01T00:00:09"}, "ann"), ("save", {"key": "a", "value": "new", "change": 100}, "ann"), ("save", {"key": "b", "value": "nb", "change": 100}, "ann"),
        ("save", {"key": "b", "value": "nb", "publish_at": "2024-01-01T00:00:09"}, "ann"), ("publish_change", {"change": 100}, "ann"), ("save", {"key": "c", "value": "x", "change": 100}, "ann"), ("revert_change", {"change": 100}, "bob"), ("abandon_change", {"change": 100}, "bob"), ("publish_change", {"change": 7}, "bob"),
    ], old)
    assert answers[:5] == [(True, 100), (False, "no_members"), (True, 120), (True, 130), (False, "grouped_schedule")]
    assert answers[5] == (True, [["a", "default", 120], ["b", "default", 130]]) and answers[6] == (False, "change_closed")
    assert answers[7] == (True, [["a", "default", 170], ["b", "default", "no_prior_version"]]) and answers[8:] == [(False, "change_closed"), (False, "no_change")]
    assert rows[170].value_json == '"old"' and rows[170].is_active and not rows[120].is_active and rows[130].is_active and rows[2].is_active and rows[120].changeset_id == 100
    assert changes[100].status == "published" and changes[100].reverted_at is not None


def test_store_reverts_large_change(spark):
    n = 1100
    old = [{"id": i, "key": f"k{i}", "v": "old", "is_active": False} for i in range(1, n + 1)] + [{"id": 2000 + i, "key": f"k{i}", "v": "new", "changeset_id": 9} for i in range(1, n + 1)]
    log = [("p", 0, "revert_change", {"change": 9}), ("p", 1, "save", {"key": "x", "value": "s"}), ("q", 2, "save", {"key": "y", "value": "t"}), ("p", 3, "revert", {"version": 2001}), ("p", 4, "open_change", {})]
    commands = spark.createDataFrame([(project, i, verb, json.dumps(args), "e") for project, i, verb, args in log], "project string, ord long, verb string, args_json string, editor string").withColumn("at", F.to_timestamp(F.lit("2024-01-01")))
    changes = frame(spark, CHANGESETS, [{"id": 9, "project": "p", "status": "published"}])
    out = store.fold(stored(spark, old), changes, commands, 10_000)
    rows = out["versions"].collect()
    assert len({r.id for r in rows}) == len(rows) == 2 * n + n + 3
    assert all(r.ok for r in out["answers"].collect())
    live = {r.key: (r.value_json, r.reverted_from) for r in rows if r.is_active}
    assert live == {f"k{i}": ('"old"', i) for i in range(2, n + 1)} | {"k1": ('"new"', 2001)}
    assert {r.key: r.value_json for r in rows if r.state == "draft"} == {"x": '"s"', "y": '"t"'}
    last = max(r.id for r in rows if r.reverted_from is not None and r.reverted_from <= n)
    assert all(r.id > last for r in rows if r.key in ("x", "y") or r.reverted_from == 2001)


def test_store_reverts_change_saved_in_log(spark):
    log = [("open_change", {}, "a")] + [("save", {"key": f"k{i}", "value": 1}, "a") for i in range(12)] + [("publish", {"key": f"k{i}"}, "a") for i in range(12)]
    log += [("save", {"key": f"k{i}", "value": 2, "change": 100}, "a") for i in range(12)] + [("publish_change", {"change": 100}, "a"), ("revert_change", {"change": 100}, "a"), ("save", {"key": "x", "value": 3}, "a"), ("publish", {"key": "x"}, "a")]
    answers, rows, _, _ = run_log(spark, log)
    assert all(ok for ok, _ in answers) and len(rows) == 37
    assert {r.key: r.value_json for r in rows.values() if r.is_active} == {f"k{i}": "1" for i in range(12)} | {"x": "3"}
    assert [n for _, _, n in answers[38][1]] == list(range(480, 492)) and answers[39] == (True, 500)


def test_units_agree_with_one_task_a_project(spark):
    """Random logs: folded by connected keys and changes, and with a scheduler's turn that does nothing, which makes the project one unit."""
    import random

    r = random.Random(8)
    log, changes = [], []
    for i in range(58):
        key = f"k{r.randrange(12)}"
        verb = r.choice(["save", "save", "save", "publish", "publish", "discard", "revert", "rename", "open_change", "schedule_change", "publish_change", "abandon_change", "revert_change", "nonsense"])
        change = r.choice(changes) if changes else 7
        args = {"save": {"key": key, "value": i, "force": r.random() < 0.5} | ({"change": r.choice([change, None, -1])} if r.random() < 0.6 else {}), "publish": {"key": key}, "discard": {"key": key}, "revert": {"version": 100 + 10 * r.randrange(58) if r.random() < 0.7 else r.randrange(1, 9)}, "rename": {"old_key": key, "new_key": f"n{r.randrange(20)}"}, "open_change": {}, "nonsense": {}}.get(verb, {"change": change})
        if verb == "schedule_change":
            args["publish_at"] = r.choice([None, "2024-01-01T00:05:00"])
        if verb == "open_change":
            changes.append(100 + 10 * i)
        log.append((verb, args, r.choice(["ann", "bob"])))
    old = [{"id": n, "key": f"k{n}", "v": n} for n in range(1, 9)]
    parts, whole = run_log(spark, log, old), run_log(spark, [*log, ("publish_due", {}, "clock")], old)
    assert parts[0] == whole[0][:-1] and whole[0][-1] == (True, []) and sum(ok for ok, _ in parts[0]) > 20
    assert parts[1] == whole[1] and parts[2] == whole[2] and sorted(parts[3]) == sorted(whole[3])


def test_store_schedule(spark):
    answers, rows, changes, _ = run_log(spark, [
        ("open_change", {}, "a"), ("save", {"key": "g", "value": 1, "change": 100}, "a"), ("schedule_change", {"change": 100, "publish_at": "2024-01-01T00:00:05"}, "a"), ("save", {"key": "s", "value": 2, "publish_at": "2024-01-01T00:00:03"}, "a"),
        ("save", {"key": "later", "value": 2, "publish_at": "2025-01-01T00:00:03"}, "a"), ("publish_due", {}, "clock"), ("publish_due", {}, "clock"),
    ])
    assert answers[5] == (True, [["s", "default", 130], ["g", "default", 110]]) and answers[6] == (True, [])
    assert rows[140].state == "draft" and rows[110].is_active and changes[100].status == "published"


def test_set_forms_agree_with_fold(spark):
    v = stored(spark, [{"id": 1, "key": "a", "v": 1}, {"id": 2, "key": "a", "v": 2, "state": "draft", "is_active": False}, {"id": 3, "key": "b", "v": 3, "state": "draft", "is_active": False, "changeset_id": 9}])
    out = {r.id: (r.state, r.is_active, r.changeset_id) for r in store.publish_set(v, v.where("key = 'a'"), "e", F.to_timestamp(F.lit("2024-01-01"))).collect()}
    assert out == {1: ("published", False, None), 2: ("published", True, None), 3: ("draft", False, 9)}
    changes = frame(spark, CHANGESETS, [{"id": 9, "project": "p", "status": "scheduled", "publish_at": None}])
    due = v.withColumn("publish_at", F.to_timestamp(F.lit("2023-01-01")))
    rows, ch = store.publish_due_set(due, changes, F.to_timestamp(F.lit("2024-01-01")), "clock")
    assert {r.id: (r.state, r.is_active, r.changeset_id) for r in rows.collect()} == {1: ("published", False, None), 2: ("published", True, None), 3: ("published", True, 9)} and ch.collect()[0].status == "published"
    d = make(spark, [{"key": k} for k in "abc"] + [{"key": "z", "derives_from": "a", "tmpl": "{v}"}])
    seeded, told = store.seed_set(d.keys, snap(spark, {"default": {"a": 1, "c": 3}}), v, "p", "e", F.to_timestamp(F.lit("2024-01-01")), 100)
    assert {r.key: r.outcome for r in told.collect()} == {"a": "already_stored", "b": "has_draft", "c": "seeded", "z": "derived"} and seeded.count() == 4


# --- files ---------------------------------------------------------------------------------------------------------------


def test_files(spark, tmp_path):
    (tmp_path / "d.json").write_text("﻿" + json.dumps({"keys": {"a": {"shape": "text", "target": "web", "limits": {"max": 3, "severity": "hard"}}, "Bad Key": {"shape": "text", "target": "web"}}, "pages": {"home": {"route": "/", "seo": {"title": "a", "ogImage": "a"}}}, "templates": {"w": {"class": "marketing", "slots": ["s"]}}}))
    d = files.descriptor(spark, str(tmp_path / "d.json"))
    assert {r.key: (r.limits or [None])[0] for r in d.keys.collect()} == {"a": 3, "Bad Key": None} and d.pages.collect()[0].seo.og_image == "a" and d.templates.collect()[0].slots == ["s"]
    assert [r.detail for r in files.descriptor_faults(d).collect()] == ["name"]
    (tmp_path / "s.json").write_text(json.dumps({"default": {"b": {"z": 1, "a": [1, 2]}, "a": "x\n"}, "de": {"a": None}}))
    s = files.snapshot(spark, str(tmp_path / "s.json"))
    assert {tuple(r) for r in s.collect()} == {("default", "b", '{"a":[1,2],"z":1}'), ("default", "a", '"x\\n"'), ("de", "a", "null")}
    text = sinks.snapshot_text(s).collect()[0].text
    assert json.loads(text) == {"de": {"a": None}, "default": {"a": "x\n", "b": {"a": [1, 2], "z": 1}}} and text.index('"de"') > 0
    (tmp_path / "bad.json").write_text('{"de": {}}')
    with pytest.raises(Exception, match="default"):
        files.snapshot(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "b.json").write_text(json.dumps({"values": {"default": {"a": 1}}, "meta": {"version": {"default": {"a": 7}}}}))
    assert [tuple(r) for r in files.bundle(spark, str(tmp_path / "b.json")).collect()] == [("default", "a", "1", 7)]
    assert files.bundle(spark, str(tmp_path / "s.json")).count() == 3
    (tmp_path / "c.csv").write_bytes('﻿email,note\r\na@b.c,"x ""y""\nz"\r\nd@e.f\r\n'.encode())
    assert [tuple(r) for r in files.contacts_csv(spark, str(tmp_path / "c.csv")).collect()] == [("a@b.c", 'x "y"\nz'), ("d@e.f", "")]
    (tmp_path / "c.json").write_text('[{"email": "a@b.c", "n": 1}, {"email": "d"}]')
    assert {tuple(r) for r in files.contacts_json(spark, str(tmp_path / "c.json")).collect()} == {("a@b.c", "1"), ("d", "")}
    (tmp_path / "site" / "x").mkdir(parents=True)
    (tmp_path / "site" / "i.html").write_text("<p>")
    (tmp_path / "site" / "x" / "j.html").write_text("<b>")
    assert {r.path for r in files.documents(spark, str(tmp_path / "site")).collect()} == {"i.html", "x/j.html"}
    out, lines = str(tmp_path / "out"), sinks.registry_lines(d.keys).select("text")
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, out, "one")
    sinks.write_all({"one": sinks.snapshot_text(s), "two/deep": lines}, out)
    assert spark.read.text(sinks.current(spark, out, "two/deep")).count() == 2
    fails = lines.select(F.raise_error(F.lit("no")).cast("string").alias("text"))
    with pytest.raises(Exception, match="no"):
        sinks.write_all({"one": lines, "two/deep": fails}, out)
    assert spark.read.text(sinks.current(spark, out, "one")).count() == 1  # none has changed
    for n in (1, 2, 3):
        sinks.write_all({"one": lines.limit(n)}, out)
    assert spark.read.text(sinks.current(spark, out, "one")).count() == 2 and len(list((tmp_path / "out").glob("v-*"))) == 2
    assert all(t.count() == 0 for t in files.empty_store(spark))
    table = sinks.generated_table(s.where("locale = 'default'"), spark.createDataFrame([("a",)], "entry string"), spark.createDataFrame([("a", "approved")], "key string, state string")).collect()
    assert [(r.key, r.state) for r in table] == [("a", "approved")]


def test_streaming(spark, tmp_path):
    from versotext.streaming import contacts as stream

    (tmp_path / "in").mkdir()
    rows = [("p", "g", "A@x.y", "2024-01-02 00:00:00", "{2}"), ("p", "g", "a@x.y", "2024-01-01 00:00:00", "{1}")]
    spark.createDataFrame(rows, "project string, group_key string, email string, at string, properties_json string").withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "in" / "a"))
    source = spark.readStream.schema("project string, group_key string, email string, at timestamp, properties_json string").parquet(str(tmp_path / "in" / "*"))
    q = stream.joins(source).writeStream.format("memory").queryName("joined_stream").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    r = spark.table("joined_stream").collect()
    assert [(x.email, str(x.joined_at), x.properties_json, x.joins) for x in r] == [("a@x.y", "2024-01-01 00:00:00", "{2}", 2)]
