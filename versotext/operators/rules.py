"""Validation rules: each takes value rows and gives findings.

Value rows are ``key, locale, value_json``; findings have the schema of
``versotext.schema.FINDINGS``. ``seq`` numbers the rules in the order a save reports them.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versotext.functions import js
from versotext.functions.text import plain_of, variables
from versotext.schema import Descriptor

#: Fixed value: the form of a colour.
HEX_COLOR = "^#([0-9a-fA-F]{3}|[0-9a-fA-F]{4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$"
#: Fixed value: promotional wording; "off" alone isn't.
PROMOTIONAL = "(?i)([0-9]+[" + js.SPACES + "]*%|" + js.whole_word("discount") + "|" + js.whole_word("sale") + ")"
#: Average characters in a line, by target and device.
CHARS_PER_LINE = {"web": {"desktop": 40, "mobile": 20}, "html-email": {"desktop": 37, "mobile": 20}}
#: The elements whose markup an email value must not hold.
HTML_TAGS = (
    "a abbr address area article aside audio b base bdi bdo blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog div dl dt em embed "
    "fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noscript object ol "
    "optgroup option output p param picture pre progress q rp rt ruby s samp script search section select slot small source span strike strong style sub summary sup svg table tbody td template "
    "textarea tfoot th thead time title tr track tt u ul var video wbr"
).split()
#: Fixed value: what counts as markup: one of these elements, or a name with a hyphen.
ILLEGAL_MARKUP = "(?i)<(?:" + "|".join(HTML_TAGS) + "|[a-z][a-z0-9]*-[a-z0-9-]*)(?=[\\s/>])"


def fits_shape(shape: Column, values: Column, value_json: Column) -> Column:
    """Whether a stored value has its key's declared shape; undeclared keys take anything."""
    kind, text = js.json_kind(value_json), js.json_string(value_json)
    strings = F.forall(F.coalesce(js.json_list(value_json), F.array(F.lit("0"))), lambda e: e.startswith('"'))
    return (
        F.when(shape.isNull(), value_json.isNotNull())
        .when(kind.isNull(), False)
        .when(shape.isin("text", "richtext", "media"), kind == "string")
        .when(shape == "list", (kind == "array") & strings)
        .when(shape == "record", kind == "object")
        .when(shape == "enum", (kind == "string") & F.array_contains(F.coalesce(values, F.array(F.lit(""))), text))
        .when(shape == "number", kind == "number")
        .when(shape == "color", (kind == "string") & text.rlike(HEX_COLOR))
        .otherwise(False)
    )


def malformed(d: Descriptor, values: DataFrame) -> DataFrame:
    """Findings of values that don't have their key's shape."""
    bad = values.join(d.keys.select("key", "shape", "values"), "key").where(~fits_shape(F.col("shape"), F.col("values"), F.col("value_json")))
    return _findings(bad, "shape", F.lit("error"), 0, F.col("key"), F.concat("key", F.lit(": the value isn't "), "shape"))


def strings_of(d: Descriptor, values: DataFrame) -> DataFrame:
    """``key, locale, path, text`` of every text in the values: itself, list entries ``key[i]``, top-level record fields ``key.f``."""
    own = values.join(d.keys.select("key", "shape", F.col("limits"), "vars", "requires", "tags", "target"), "key")
    one = F.when(F.col("shape").isin("text", "richtext", "media") & js.json_string(F.col("value_json")).isNotNull(), F.array(F.struct(F.col("key").alias("path"), js.json_string(F.col("value_json")).alias("text"))))
    entries = F.when(F.col("shape") == "list", F.transform(js.json_list(F.col("value_json")), lambda e, i: F.struct(F.concat(F.col("key"), F.lit("["), i.cast("string"), F.lit("]")).alias("path"), js.json_string(e).alias("text"))))
    fields = F.when(F.col("shape") == "record", F.transform(F.map_entries(js.json_object(F.col("value_json"))), lambda e: F.struct(F.concat(F.col("key"), F.lit("."), e["key"]).alias("path"), js.json_string(e["value"]).alias("text"))))
    found = own.select("*", F.explode(F.coalesce(one, entries, fields)).alias("s")).where("s.text is not null")
    return found.select("key", "locale", F.col("s.path").alias("path"), F.col("s.text").alias("text"), "limits", "vars", "requires", "tags", "target")


def _findings(rows: DataFrame, rule: str, severity: Column, seq: int, key: Column, message: Column, **detail: Column) -> DataFrame:
    pairs = [x for k, v in detail.items() for x in (F.lit(k), v.cast("string"))]
    locale = F.col("locale") if "locale" in rows.columns else F.lit(None).cast("string")
    return rows.select(F.lit(rule).alias("rule"), severity.alias("severity"), F.lit(seq).alias("seq"), key.alias("key"), F.lit(None).cast("string").alias("page"), locale.alias("locale"), message.alias("message"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("detail"))


def over_limit(texts: DataFrame) -> DataFrame:
    size = js.len16(F.when(F.col("tags").isNotNull(), plain_of(F.col("text"))).otherwise(F.col("text")))
    rows = texts.withColumn("size", size).where(F.col("size") > F.col("limits.max"))
    severity = F.when(F.col("limits.severity") == "hard", "error").otherwise("warning")
    return _findings(rows, "limit", severity, 1, F.col("path"), F.concat("path", F.lit(": "), "size", F.lit(" characters exceeds the "), "limits.max", F.lit("-character limit")), length=F.col("size"), max=F.col("limits.max"))


def undeclared_variables(texts: DataFrame) -> DataFrame:
    rows = texts.withColumn("unknown", F.array_except(variables(F.col("text")), F.coalesce("vars", F.array().cast("array<string>")))).where(F.size("unknown") > 0)
    names = F.array_join("unknown", ",")
    return _findings(rows, "vars", F.lit("error"), 2, F.col("path"), F.concat("path", F.lit(": undeclared variables "), names), vars=names)


def missing_variables(texts: DataFrame) -> DataFrame:
    rows = texts.where(F.size("requires") > 0).select("*", F.explode(F.array_except(F.col("requires"), variables(F.col("text")))).alias("name"))
    return _findings(rows, "requires", F.lit("error"), 3, F.col("path"), F.concat("path", F.lit(": {{"), "name", F.lit("}} is required")), vars=F.col("name"))


def tag_fault(text: str, declared: int) -> str | None:
    """The first way a text fails to carry tags 1 to ``declared``, each once and balanced; None if it does."""
    import re

    open_tags: list[int] = []
    seen: set[int] = set()
    for m in re.finditer(r"<(/?)([0-9]+)(/?)>", text):
        number = int(m[2])
        if m[1] and m[3]:
            return f"unreadable tag {m[0]}"
        if m[1]:
            if not open_tags or open_tags[-1] != number:
                return f"tag {number} closed out of turn"
            open_tags.pop()
            continue
        if not 1 <= number <= declared:
            return f"tag {number} undeclared"
        if number in seen:
            return f"tag {number} twice"
        seen.add(number)
        if not m[3]:
            open_tags.append(number)
    if open_tags:
        return f"tag {open_tags[-1]} left open"
    return next((f"tag {n} missing" for n in range(1, declared + 1) if n not in seen), None)


@F.pandas_udf(T.StringType())
def _tag_faults(texts: pd.Series, declared: pd.Series) -> pd.Series:
    return pd.Series([tag_fault(t, int(n)) for t, n in zip(texts, declared, strict=True)], dtype="object")


def unbalanced_tags(texts: DataFrame) -> DataFrame:
    rows = texts.where("tags is not null").withColumn("fault", _tag_faults("text", "tags")).where("fault is not null")
    return _findings(rows, "tags", F.lit("error"), 4, F.col("path"), F.concat("path", F.lit(": tags 1.."), "tags", F.lit(" once each and balanced; found "), "fault"), fault=F.col("fault"))


def template_of(keys: DataFrame, templates: DataFrame) -> DataFrame:
    """``key, template``: the longest template whose name and ``__`` begin the key. One row for each key that has one."""
    # a key's prefixes that end before a "__" are few: an equi-join instead of comparing every key with every template
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length("key") - 1, F.lit(1))), lambda i: F.col("key").substr(i, F.lit(2)) == "__")
    prefixes = keys.select("key", F.explode(F.transform(ends, lambda i: F.col("key").substr(F.lit(1), i - 1))).alias("template"))
    found = prefixes.join(templates.select("template").distinct(), "template")
    return found.groupBy("key").agg(F.max_by("template", F.length("template")).alias("template"))


def subject_lines(d: Descriptor, texts: DataFrame) -> DataFrame:
    own = texts.join(template_of(texts.select("key").distinct(), d.templates), "key")
    rows = own.where((F.col("key") == F.concat("template", F.lit("__subject"))) & F.col("text").rlike("[\\r\\n]"))
    return _findings(rows, "subject", F.lit("error"), 5, F.col("path"), F.concat("path", F.lit(": a subject with a line break")))


def class_rules(d: Descriptor, siblings: DataFrame) -> DataFrame:
    """Marketing templates need an unsubscribe variable and a postal address; transactional ones no promotional wording.

    ``siblings`` are the values (key, locale, value_json) of all slots and of ``brand__footer_address``.
    """
    texts = siblings.select("key", "locale", js.json_string(F.col("value_json")).alias("text"))
    locales = siblings.select("locale").distinct()
    slots = d.templates.select("template", "class", "wrapper_provides", F.explode_outer("slots").alias("slot")).withColumn("slot_key", F.concat("template", F.lit("__"), "slot"))
    held = slots.join(texts.withColumnRenamed("key", "slot_key"), "slot_key")
    subscribed = held.groupBy("template", "locale").agg(F.bool_or(F.array_contains(variables(F.col("text")), "unsubscribe_url")).alias("has_link"))
    address = texts.where("key = 'brand__footer_address'").select("locale", (~js.is_blank(F.col("text"))).alias("has_address"))
    marketing = d.templates.where("class = 'marketing'").crossJoin(F.broadcast(locales)).join(subscribed, ["template", "locale"], "left").join(address, "locale", "left")
    provided = F.coalesce("wrapper_provides", F.array().cast("array<string>"))
    linkless = marketing.where(~F.array_contains(provided, "unsubscribe_url") & ~F.coalesce("has_link", F.lit(False)))
    homeless = marketing.where(~F.array_contains(provided, "postal_address") & ~F.coalesce("has_address", F.lit(False)))
    loud = held.where((F.col("class") != "marketing") & F.col("text").rlike(PROMOTIONAL))
    return (
        _findings(linkless, "class", F.lit("error"), 6, F.col("template"), F.concat("template", F.lit(": a marketing template needs {{unsubscribe_url}} in scope")))
        .unionByName(_findings(homeless, "class", F.lit("warning"), 7, F.col("template"), F.concat("template", F.lit(": a marketing template needs a postal address in scope"))))
        .unionByName(_findings(loud, "class", F.lit("warning"), 7, F.col("slot_key"), F.concat("slot_key", F.lit(": promotional wording in a transactional template")), slot=F.col("slot")))
    )


def illegal_markup(texts: DataFrame) -> DataFrame:
    rows = texts.where((F.col("target") == "html-email") & F.col("text").rlike(ILLEGAL_MARKUP))
    return _findings(rows, "construct", F.lit("error"), 8, F.col("path"), F.concat("path", F.lit(": markup isn't allowed in email copy")))


def estimated_lines(text: Column, chars_per_line: Column) -> Column:
    """Lines a text takes: each line of it at least one; an empty last line doesn't count."""
    parts = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    own = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.aggregate(own, F.lit(0), lambda n, p: n + F.greatest(F.lit(1), F.ceil(js.len16(p) / chars_per_line).cast("int")))


def over_budget(d: Descriptor, values: DataFrame) -> DataFrame:
    """The device whose line budget is overshot most, desktop first where both are."""
    rows = values.join(d.keys.select("key", "target", "budget"), "key").withColumn("text", js.json_string(F.col("value_json"))).where("budget is not null and text is not null")
    per = lambda device: F.when(F.col("target") == "html-email", CHARS_PER_LINE["html-email"][device]).otherwise(CHARS_PER_LINE["web"][device])
    devices = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(x).alias("device"), estimated_lines(F.col("text"), per(x)).alias("estimate"), F.col(f"budget.{x}").alias("allowed")) for i, x in enumerate(("desktop", "mobile"))])
    over = rows.select("key", "locale", F.explode(devices).alias("x")).where("x.allowed is not null and x.estimate > x.allowed")
    worst = over.groupBy("key", "locale").agg(F.max_by("x", F.struct(F.col("x.estimate") - F.col("x.allowed"), -F.col("x.rank"))).alias("x"))
    return _findings(worst, "budget", F.lit("warning"), 9, F.col("key"), F.concat("key", F.lit(": an estimated "), "x.estimate", F.lit(" "), "x.device", F.lit(" lines against a budget of "), "x.allowed"), device=F.col("x.device"), estimate=F.col("x.estimate"), budget=F.col("x.allowed"))


def ordered(findings: DataFrame) -> DataFrame:
    """Errors before warnings, in the order of the rules within."""
    return findings.orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), "seq", "key", "locale")


def validate(d: Descriptor, values: DataFrame, siblings: DataFrame | None = None) -> DataFrame:
    """Findings of every rule that looks at values, V3 to V10 in the order a save reports them."""
    texts = strings_of(d, values)
    parts = [over_limit(texts), undeclared_variables(texts), missing_variables(texts), unbalanced_tags(texts), subject_lines(d, texts), class_rules(d, values if siblings is None else siblings), illegal_markup(texts), over_budget(d, values)]
    return reduce(DataFrame.unionByName, parts)


def check(d: Descriptor, values: DataFrame, siblings: DataFrame | None = None) -> DataFrame:
    """Shape first: values without their shape are reported and no other rule sees them."""
    bad = malformed(d, values)
    good = values.join(bad.select("key", "locale"), ["key", "locale"], "left_anti")
    return bad.unionByName(validate(d, good, siblings))


def check_snapshot(d: Descriptor, snapshot: DataFrame) -> DataFrame:
    return check(d, snapshot.select("key", "locale", "value_json"))


#: Fields of a record that together look like a person's data.
CONTACT_FIELDS = ("email", "consent", "phone")


def contact_smell(snapshot: DataFrame) -> DataFrame:
    """Records in the snapshot that hold two or more of a contact's fields."""
    fields = F.transform(F.map_keys(js.json_object(F.col("value_json"))), lambda k: F.lower(k))
    return snapshot.withColumn("fields", F.array_intersect(fields, F.array(*map(F.lit, CONTACT_FIELDS)))).where(F.size("fields") >= 2).select("key", "locale", F.array_join(F.array_sort("fields"), ",").alias("fields"))


#: The form of an address, and what it must not hold.
EMAIL = "^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$"
CONTROL = "[\\x00-\\x1f\\x7f]"


def email_fault(email: Column) -> Column:
    """Why an address isn't one: control, surrogate, length or form; null if it is."""
    return F.when(email.isNull() | ~email.rlike(EMAIL), F.when(email.rlike(CONTROL), "control").otherwise("form")).when(email.rlike(CONTROL), "control").when(email.rlike("[\\ud800-\\udfff]"), "surrogate").when(F.length(email) > 254, "length")


def answer_faults(answers: DataFrame, groups: DataFrame) -> DataFrame:
    """The first fault of each row's answers (row_id, project, group_key, answers map) in the order its group declares questions.

    Codes: unknown_question, required, not_in_list, too_long, control. Rows without a fault give none.
    """
    own = answers.join(groups.select("project", F.col("key").alias("group_key"), "properties"), ["project", "group_key"])
    names = F.transform("properties", lambda p: p["name"])
    stray = own.withColumn("stray", F.array_sort(F.array_except(F.map_keys("answers"), names))).where(F.size("stray") > 0).select("row_id", F.lit(-1).alias("pos"), F.element_at("stray", 1).alias("question"), F.lit("unknown_question").alias("code"))
    asked = own.select("row_id", "answers", F.posexplode("properties").alias("pos", "q"))
    value = F.element_at("answers", F.col("q.name"))
    code = F.when(js.is_blank(value), F.when(F.coalesce("q.required", F.lit(False)), "required")).when(F.length(value) > 500, "too_long").when(value.rlike(CONTROL), "control").when((F.col("q.type") == "enum") & ~F.array_contains("q.values", value), "not_in_list")
    faults = asked.select("row_id", "pos", F.col("q.name").alias("question"), code.alias("code")).where("code is not null")
    return stray.unionByName(faults).groupBy("row_id").agg(F.min_by(F.struct("question", "code"), "pos").alias("f")).select("row_id", "f.question", "f.code")


def group_faults(groups: DataFrame) -> DataFrame:
    """Groups whose declaration doesn't hold: key form, repeated question, enum without values, values without enum."""
    names = F.transform(F.coalesce("properties", F.array().cast("array<struct<name:string,type:string,values:array<string>,required:boolean>>")), lambda p: p["name"])
    fault = (
        F.when(~F.col("key").rlike("^[a-z][a-z0-9_-]*$"), "key")
        .when(F.size(F.array_distinct(names)) < F.size(names), "repeated_question")
        .when(F.exists("properties", lambda p: ~p["type"].isin("text", "enum")), "type")
        .when(F.exists("properties", lambda p: (p["type"] == "enum") & (F.coalesce(F.size(p["values"]), F.lit(0)) < 1)), "enum_without_values")
        .when(F.exists("properties", lambda p: (p["type"] == "text") & p["values"].isNotNull()), "values_without_enum")
    )
    return groups.select("project", "key", fault.alias("fault")).where("fault is not null")


ZONED = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\\.[0-9]{1,3})?)?(Z|[+-][0-9]{2}:[0-9]{2})$"


def import_faults(rows: DataFrame, now: str, date_col: str | None = None) -> DataFrame:
    """Rows (row_id, email, ...) with a fault: email, date (not zoned or not a real day) or future."""
    fault = F.when(email_fault(F.col("email")).isNotNull(), F.lit("email"))
    if date_col:
        stamp = F.try_to_timestamp(F.regexp_replace(date_col, "^(.{16})(Z|[+-])", "$1:00$2"))  # seconds may be left out
        given = F.col(date_col).isNotNull() & (F.col(date_col) != "")
        fault = fault.when(given & (~F.col(date_col).rlike(ZONED) | stamp.isNull()), "date").when(given & (stamp > F.to_timestamp(F.lit(now))), "future")
    return rows.select("row_id", fault.alias("fault")).where("fault is not null")
