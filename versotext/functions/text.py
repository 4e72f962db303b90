"""Text columns: placeholders, names, routes, hashes."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versotext.functions import js


def normal_email(c: Column) -> Column:
    return F.lower(js.trim(c))


def plain_of(c: Column) -> Column:
    """Numbered tags dropped: a self-closing one is a space, opening and closing ones nothing."""
    return F.regexp_replace(F.regexp_replace(c, "<[0-9]+/>", " "), "</?[0-9]+>", "")


def variables(c: Column) -> Column:
    """Distinct ``{{name}}`` names in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(js.VARIABLE), F.lit(1)))


def vars_of(c: Column) -> Column:
    return F.array_sort(variables(c))


def to_double_braces(c: Column) -> Column:
    """``{x}`` to ``{{x}}``; what has two braces already stays."""
    return F.regexp_replace(c, "(?<!\\{)\\{([a-zA-Z0-9_]+)\\}(?!\\})", "{{$1}}")


def to_single_braces(c: Column) -> Column:
    return F.regexp_replace(c, js.VARIABLE, "{$1}")


def escape_html(c: Column) -> Column:
    out = c
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


#: The named entities that are decoded.
NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "hellip": "…", "mdash": "—", "ndash": "–",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "middot": "·", "bull": "•", "times": "×", "euro": "€", "pound": "£", "deg": "°",
}
ENTITY = re.compile(r"&(?:#(\d+)|#[xX]([0-9a-fA-F]+)|([A-Za-z][A-Za-z0-9]*));")


def decode_entity(m: re.Match) -> str:
    """A reference's character; what is unknown, too large or a surrogate stays as it is."""
    if m[3]:
        return NAMED.get(m[3], m[0])
    code = int(m[1]) if m[1] else int(m[2], 16)
    return m[0] if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)


@F.pandas_udf(T.StringType())
def decode_entities(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: ENTITY.sub(decode_entity, t), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def undecoded_entities(texts: pd.Series) -> pd.Series:
    """References that decoding leaves as they are, each once, in order."""
    return texts.map(lambda t: list(dict.fromkeys(m[0] for m in ENTITY.finditer(t) if decode_entity(m) == m[0])), na_action="ignore")


def words_of(c: Column) -> Column:
    """Lower-case words joined by underscores: a camel hump starts a word, other characters part words."""
    split = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2")
    return F.regexp_replace(F.regexp_replace(F.lower(split), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def first_words(c: Column, n: int, most: int) -> Column:
    """The first ``n`` underscore-joined words, as many whole ones as fit in ``most`` characters."""
    parts = F.slice(F.split(c, "_"), 1, n)
    joined = F.aggregate(parts, F.lit(""), lambda acc, w: F.when(acc == "", w).when(F.substring(acc, -1, 1) == "\u0000", acc).when(F.length(acc) + 1 + F.length(w) <= most, F.concat(acc, F.lit("_"), w)).otherwise(F.concat(acc, F.lit("\u0000"))))
    return F.substring(F.regexp_replace(joined, "\u0000", ""), 1, most)


def propose_key(c: Column, most: int = 40) -> Column:
    """A key name from a text: its words, cut at a word boundary within ``most`` characters."""
    whole = words_of(c)
    cut = F.regexp_replace(F.substring(whole, 1, most + 1), "_[^_]*$", "")
    return F.when(F.length(whole) <= most, whole).otherwise(F.substring(cut, 1, most))


def derive_label(key: Column) -> Column:
    """The last part of a key as a label: after ``__`` or ``.``, underscores as spaces, the first letter large."""
    last = F.regexp_replace(F.substring_index(F.substring_index(key, ".", -1), "__", -1), "_+", " ")
    return F.concat(F.upper(F.substring(last, 1, 1)), last.substr(F.lit(2), F.length(last)))


def base_name(parts: Column, most: int = 48) -> Column:
    """Non-empty parts joined by ``__``; too long: the last part is cut, then leading parts are dropped."""
    kept = F.filter(parts, lambda p: p.isNotNull() & (p != ""))
    whole = F.array_join(kept, "__")
    head = F.array_join(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), "__")
    room = F.lit(most) - F.length(head) - 2
    last = F.element_at(kept, -1)
    fitted = F.regexp_replace(F.substring(last, 1, most), "_+$", "")
    staged = F.when(room >= 8, F.concat(head, F.lit("__"), F.regexp_replace(last.substr(F.lit(1), room), "_+$", ""))).otherwise(fitted)
    return F.when(F.size(kept) == 0, "").when(F.length(whole) <= most, whole).when(F.size(kept) == 1, fitted).otherwise(staged)


def qualifies_as_copy(c: Column) -> Column:
    """Two letters or digits, one of them a letter, once tags and variables are gone."""
    bare = F.regexp_replace(plain_of(c), js.VARIABLE, "")
    return (F.length(F.regexp_replace(bare, "[^\\p{L}\\p{N}]", "")) >= 2) & bare.rlike("\\p{L}")


def route(c: Column) -> Column:
    """Trimmed, one trailing slash dropped."""
    return F.regexp_replace(js.trim(c), "/$", "")


def file_route(path: Column) -> Column:
    """The route a document file is served at: index files at their folder, others without extension."""
    bare = F.regexp_replace(F.regexp_replace(path, "^\\./|^/+", ""), "\\.html?$", "")
    return F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(bare, "(^|/)index$", "")), "(.)/$", "$1")


def route_depth(c: Column) -> Column:
    """Order of routes: '/' first, then by number of segments; unrouted last."""
    clean = F.regexp_replace(F.regexp_replace(c, "^/+|/+$", ""), "/+", "/")
    return F.when(c.isNull(), F.lit(1 << 30)).when(clean == "", 0).otherwise(F.size(F.split(clean, "/")))


def word_bounded(needle: Column, text: Column) -> Column:
    """Place (from 0) of the first occurrence that no letter or digit touches; -1 if there is none."""
    quoted = F.concat(F.lit("(?<![\\p{L}\\p{N}])\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![\\p{L}\\p{N}])"))
    return F.when(needle == "", F.lit(-1)).otherwise(F.regexp_instr(text, quoted) - 1)


def stem_words(path: Column) -> Column:
    """A file's stem as words: no folder, query or extension, marks as spaces."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "[?#].*$", ""), "^.*/", ""), "\\.[A-Za-z0-9]+$", "")
    return F.lower(js.trim(F.regexp_replace(name, "[-_+.]+|%20", " ")))


def source_hash(value_json: Column) -> Column:
    return F.sha2(js.canonical_json(value_json), 256)


def erasure_hash(salt: str, email: Column) -> Column:
    return F.sha2(F.concat(F.lit(salt), email), 256)


def _b64(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def mint_token(secret: str) -> Callable[[Column], Column]:
    """payload.signature of a payload text, HMAC-SHA256 in base64url."""

    @F.pandas_udf(T.StringType())
    def mint(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda p: f"{_b64(p.encode())}.{_b64(hmac.digest(secret.encode(), p.encode(), 'sha256'))}", na_action="ignore")

    return mint


def verify_token(secret: str, now: float | None = None) -> Callable[[Column], Column]:
    """The payload of a token with a right signature, else null; with ``now``, also null past a JSON payload's ``exp`` (seconds)."""

    def one(token: str) -> str | None:
        try:
            payload, signature = (base64.urlsafe_b64decode(x + "=" * (-len(x) % 4)) for x in token.split("."))
        except ValueError:
            return None
        if not hmac.compare_digest(signature, hmac.digest(secret.encode(), payload, "sha256")):
            return None
        text = payload.decode("utf-8", "replace")
        if now is not None:
            try:
                if not json.loads(text)["exp"] > now:
                    return None
            except (ValueError, KeyError, TypeError):
                return None
        return text

    @F.pandas_udf(T.StringType())
    def verify(tokens: pd.Series) -> pd.Series:
        return tokens.map(one, na_action="ignore")

    return verify


def substitute(text: Column, props: Column) -> Column:
    """``{{name}}`` replaced from a map of texts; a name that isn't in it stays."""
    return F.aggregate(F.map_keys(props), text, lambda acc, k: F.replace(F.regexp_replace(acc, F.concat(F.lit("\\{\\{\\s*"), k, F.lit("\\s*\\}\\}")), F.concat(F.lit("\u0001"), k, F.lit("\u0001"))), F.concat(F.lit("\u0001"), k, F.lit("\u0001")), F.element_at(props, k)))


def glob_regex(pattern: str) -> str:
    """``**/`` any folders, ``**`` anything, ``*`` anything but a slash, the rest itself."""
    out = ""
    for token in re.findall(r"\*\*/|\*\*|\*|[^*]+", pattern):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*"}.get(token) or re.escape(token)
    return f"^{out}$"


def windows_differ(a: Column, b: Column) -> Column:
    """Number of places at which two arrays of equal length differ; null for other lengths."""
    return F.when(F.size(a) == F.size(b), F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: ~p["x"].eqNullSafe(p["y"]))))


def origin(url: Column) -> Column:
    port = F.regexp_extract(url, "^[a-z]+://[^/:]+(:[0-9]+)", 1)
    return F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("HOST")), port)


def path_of(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PATH"))


def line_of(text: Column, offset: Column) -> Column:
    """Line (from 1) of an offset (from 0)."""
    return F.length(F.regexp_replace(text.substr(F.lit(1), offset), "[^\\n]", "")) + 1


def column_of(text: Column, offset: Column) -> Column:
    return F.length(F.substring_index(text.substr(F.lit(1), offset), "\n", -1)) + 1


def one_line(c: Column, most: int = 200) -> Column:
    """Safe for a log line: control characters out, clipped."""
    bare = F.regexp_replace(c, "[\\x00-\\x1f\\x7f-\\x9f\\u2028\\u2029]+", " ")
    return F.when(F.length(bare) <= most, bare).otherwise(F.concat(bare.substr(F.lit(1), F.lit(most - 1)), F.lit("…")))


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
