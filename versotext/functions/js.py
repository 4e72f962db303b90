"""String and JSON columns with JavaScript's semantics, where Spark's differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What JavaScript's trim and \s take for white space.
SPACES = "\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
VARIABLE = "\\{\\{[" + SPACES + "]*([a-zA-Z0-9_]+)[" + SPACES + "]*\\}\\}"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACES}]+|[{SPACES}]+$", "")


def is_blank(c: Column) -> Column:
    """Null, or nothing but white space."""
    return c.isNull() | (trim(c) == "")


def len16(c: Column) -> Column:
    """Length in UTF-16 units: a character above U+FFFF counts twice."""
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def collapse(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.regexp_replace(trim(c), f"[{SPACES}]+", " ")


def collapse_ascii(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[ \\t\\r\\n\\f]+", " "), "^ | $", "")


def whole_word(pattern: str) -> str:
    """``pattern`` between ASCII word boundaries: an accented letter beside it is no word character."""
    return f"(?<![A-Za-z0-9_]){pattern}(?![A-Za-z0-9_])"


def canonical_json(c: Column) -> Column:
    """Object keys sorted, numbers in shortest form; null for what isn't JSON."""
    return F.to_json(F.try_parse_json(c))


def json_kind(c: Column) -> Column:
    """string, number, boolean, null, array or object; null for what isn't JSON."""
    kind = F.schema_of_variant(F.try_parse_json(c))
    return (
        F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind.isNotNull(), "number")
    )


def json_string(c: Column) -> Column:
    """The text of a JSON string; null for any other value."""
    return F.when(json_kind(c) == "string", F.try_variant_get(F.try_parse_json(c), "$", "string"))


def json_list(c: Column) -> Column:
    """A JSON array's entries as JSON text; null for any other value."""
    return F.when(json_kind(c) == "array", F.transform(F.try_variant_get(F.try_parse_json(c), "$", "array<variant>"), lambda v: F.coalesce(F.to_json(v), F.lit("null"))))


def json_object(c: Column) -> Column:
    """A JSON object's fields as JSON text; null for any other value."""
    return F.when(json_kind(c) == "object", F.transform_values(F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>"), lambda _, v: F.coalesce(F.to_json(v), F.lit("null"))))


def as_text(c: Column) -> Column:
    """What ``String(value)`` gives for a JSON value; entries of a list that aren't strings keep their JSON form."""
    parts = F.transform(json_list(c), lambda e: F.coalesce(json_string(e), F.when(e == "null", "").otherwise(e)))
    return F.coalesce(json_string(c), F.when(json_kind(c) == "array", F.array_join(parts, ",")), F.when(json_kind(c) == "object", F.lit("[object Object]")), canonical_json(c))


def to_json_string(c: Column) -> Column:
    """A text as a JSON string."""
    return F.substring(F.to_json(F.struct(c.alias("v"))), 6, 1 << 30).substr(F.lit(1), F.length(F.to_json(F.struct(c.alias("v")))) - 6)


def iso_utc(ts: Column) -> Column:
    """ISO form with milliseconds and Z; the session's zone is expected to be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def string_map(c: Column) -> Column:
    """A JSON object's text fields as a map; fields of any other kind are left out, and what is no object gives null."""
    return F.transform_values(F.map_filter(json_object(c), lambda _, v: v.startswith('"')), lambda _, v: json_string(v))


def short_date(ts: Column) -> Column:
    """A day and a time of day for people: 4 Mar 2024 09:05."""
    return F.date_format(ts, "d MMM yyyy HH:mm")
