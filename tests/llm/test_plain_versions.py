"""Registered results of the learned and the record-making operators, against plain versions row by row."""

import html
import json
import math
import random
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("versotext.llm")

from versotext.llm import language, quality, toxicity, warc  # noqa: E402
from versotext.llm.text import plain_words  # noqa: E402


def corpus(seed, n=240):
    """Prose in two tongues, junk, lists, repeated rows, nulls, empty texts and ids that stand twice."""
    r = random.Random(seed)
    tongues = {"x": ["the", "of", "and", "house", "river", "walking", "stone"], "y": ["der", "und", "nicht", "häuser", "fluß", "gehen", "stein"]}
    rows = []
    for i in range(n):
        lang = "xy"[i % 2]
        words = [r.choice(tongues[lang]) + r.choice(["", "", "s", "er"]) for _ in range(r.randint(3, 60))]
        text = " ".join(words).capitalize() + "."
        if i % 7 == 0:
            text = " ".join(w + "&&##" for w in words)
        if i % 11 == 0:
            text = "\n".join([text] * 6)
        if i % 5 == 0:
            text += " idiot"
        rows.append((i, text, lang if i % 13 else None))
    rows += [(900, None, "x"), (901, "", "y"), (902, "½ 12", "x"), (None, rows[1][1], "x"), (None, None, None), (3, rows[3][1], rows[3][2]), (4, rows[5][1], "y"), (903, " " * 50, "x")]
    return rows


def close(a, b):
    return a.keys() == b.keys() and all(len(a[k]) == len(b[k]) and np.allclose(sorted(a[k]), sorted(b[k]), atol=1e-6) for k in a)


def by_id(pairs):
    out = {}
    for k, v in pairs:
        out.setdefault(k, []).append(v)
    return out


def test_quality_row_by_row(spark):
    rows = corpus(1)
    out = quality.classify_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))).collect()
    raws = [(i, (t or "").encode()) for i, t, _ in rows]
    posterior, _, _ = quality.em(dict(Counter(quality.measure(raw)[0] for _, raw in raws)))
    learned = sorted({(i is None, i or 0, t) for i, t, _ in rows if t is not None})
    model = quality.fit([t.encode() for *_, t in learned], [posterior[quality.measure(t.encode())[0]] for *_, t in learned])

    def score(raw):
        grams = [raw[k : k + 3] for k in range(len(raw) - 2)]
        buckets = [((g[0] << 16 | g[1] << 8 | g[2]) * 2654435769 % (1 << 32)) >> (32 - quality.BITS) for g in grams]
        z = model.bias + sum(w * v for w, v in zip(model.style, quality.measure(raw)[1], strict=True)) + (quality.SCALE * sum(float(model.grams[b]) for b in buckets) / len(buckets) if buckets else 0.0)
        return 1 / (1 + math.exp(-z))

    assert close(by_id((r["doc_id"], r["score"]) for r in out), by_id((i, score(raw)) for i, raw in raws))
    assert close(by_id((r["doc_id"], r["posterior"]) for r in out), by_id((i, posterior[quality.measure(raw)[0]]) for i, raw in raws))
    assert all(r["keep"] == (r["score"] >= 0.5) for r in out)
    empty = {r["doc_id"]: r for r in out}
    assert all(set(empty[i]["votes"]) == {"-"} and not empty[i]["keep"] for i in (900, 901, 903))


def test_toxicity_row_by_row(spark):
    rows = corpus(2)
    labels = [(i, int("idiot" in (t or ""))) for i, t, _ in rows if i is not None and i % 3] + [(2, 1), (None, 1), (7, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("toxic", F.lit(9))
    out = toxicity.score_toxicity(frame, spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("x"))).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    marks = {}
    for i, y in labels:
        if i is not None and y is not None and not held(i):
            marks[i] = max(y, marks.get(i, 0))
    learned = sorted({(marks[i], i, t) for i, t, _ in rows if i in marks and t is not None})
    model = toxicity.fit([t.encode() for *_, t in learned], [y for y, *_ in learned])
    weights = dict(model.words) | {w + b"*" * (n > 0): v for n, own in model.begin for w, v in own.items()}

    def score(t):
        words = set(plain_words((t or "").encode()))
        begun = {w[:n] + b"*" for w in words - toxicity.TERMS for n in toxicity.BEGINNINGS if len(w) > n}
        return 1 / (1 + math.exp(-model.bias - sum(weights.get(f, 0.0) for f in words | begun)))

    assert close(by_id((r["doc_id"], r["score"]) for r in out), by_id((i, score(t)) for i, t, _ in rows))
    assert all(r["held_out"] == held(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.5) for r in out)


def test_language_row_by_row(spark):
    rows = corpus(3)
    out = language.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1
    eligible = [(i, t, lang) for i, t, lang in rows if t is not None and lang is not None and not held(i)]

    def buckets(t):
        t = t.lower()
        out = []
        for n in (1, 2, 3):
            for k in range(len(t) - n + 1):
                mixed = ord(t[k])
                for c in t[k + 1 : k + n]:
                    mixed = (mixed * 0x100000001B3 + ord(c)) % (1 << 64)
                out.append(((mixed * 0x9E3779B97F4A7C15) % (1 << 64) >> (64 - language.BITS)) + ((n - 1) << language.BITS))
        return out

    frequency = Counter(b for _, t, _ in eligible for b in set(buckets(t)))
    vector = np.array([frequency.get(b, 0) for b in range(language.BUCKETS)], dtype=float)
    placed = spark.createDataFrame(eligible, "doc_id long, text string, lang string").withColumn("p", __import__("versotext.llm.text", fromlist=["x"]).sample_place())
    learned = sorted({(r["lang"], r["p"], r["text"]) for r in placed.collect()})  # the order in which rows are learned from counts
    model = language.fit([t for *_, t in learned], [lang for lang, *_ in learned], corpus=(vector, len(eligible)))
    assert model.languages == ["x", "y"]

    def predict(t):
        if not any(c.isalpha() for c in t or ""):
            return "und", 0.0
        total = np.zeros(3)
        for b in buckets(t):
            total += model.table[b]
        z = (language.SCALE * total[:2] / max(total[2], 1e-12) + model.bias) / model.temperature
        p = np.exp(z - z.max())
        return model.languages[int(p.argmax())], float((p / p.sum()).max())

    assert close(by_id((r["doc_id"], r["score"]) for r in out), by_id((i, predict(t)[1]) for i, t, _ in rows))
    assert by_id((r["doc_id"], r["lang_pred"]) for r in out).keys() == by_id((i, 0) for i, *_ in rows).keys()
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in out) == sorted((str(i), predict(t)[0]) for i, t, _ in rows)
    assert all(r["held_out"] == held(r["doc_id"]) for r in out)


class Plain(HTMLParser):
    """Visible text, links and title by the standard library's parser."""

    def __init__(self, source):
        super().__init__(convert_charrefs=False)
        self.parts, self.links, self.title, self.hidden, self.titled = [], [], [], 0, False
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in warc.LINK and not self.hidden and (url := dict(reversed(attrs)).get(warc.LINK[tag][0])):
            self.links.append({"path": warc.LINK[tag][1], "url": url})
        if tag in warc.HIDDEN:
            self.hidden += 1
            self.parts.append(" ")
        self.titled = self.titled or tag == "title"
        if not self.hidden and not self.titled and tag in warc.BLOCK:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in warc.HIDDEN and self.hidden:
            self.hidden -= 1
        if not self.hidden and not self.titled and tag in warc.BLOCK:
            self.parts.append("\n")
        if tag == "title":
            self.titled = False

    def put(self, text):
        if self.titled:
            self.title.append(text)
        elif not self.hidden:
            self.parts.append(text.replace("\n", " "))

    handle_data = put

    def handle_entityref(self, name):
        self.put(f"&{name};")

    def handle_charref(self, name):
        self.put(f"&#{name};")

    def handle_comment(self, data):
        self.parts.append(" ")

    def text(self):
        lines = html.unescape("".join(self.parts)).split("\n")
        return "\n".join(line for line in (" ".join(x.split()) for x in lines) if line)


def test_derivatives_against_another_parser(spark):
    r = random.Random(7)
    blocks = ['<p>Par {n} &amp; more</p>', '<a href="/p{n}?a=1&amp;b=2">Link {n}</a>', "<ul><li>one<li>two</ul>", '<img src="i{n}.png" alt="x">', "<script>var a = '<p>no</p>';</script>", "<style>p {{ }}</style>", "<!-- gone {n} -->", "text {n}\n  and\tmore", "<br>", "<h2>Head <b>bold</b></h2>", "<table><tr><td>1</td><td>2</td></tr></table>", '<form action="/f{n}"><label>Name</label></form>']
    rows = []
    for i in range(120):
        body = "".join(r.choice(blocks).format(n=r.randint(0, 99)) for _ in range(r.randint(0, 25)))
        rows.append((i, f"http://h{i % 3}.example/{i}", f"<!DOCTYPE html><html><head><title>Page {i} &lt;x&gt;</title><link href=/s.css></head><body>{body}</body></html>"))
    rows += [(500, "u", ""), (501, None, None), (3, *rows[3][1:])]
    out = warc.derivatives(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit(1))).collect()
    assert len(out) == 2 * len(rows)
    pages = {i: (url or "", source or "") for i, url, source in rows}
    for x in out:
        url, source = pages[x["page_id"]]
        plain = Plain(source)
        if x["record_type"] == "conversion":
            assert x["block"] == plain.text()
        else:
            envelope = json.loads(x["block"])["Envelope"]
            assert envelope["HTML"] == {"Title": " ".join(html.unescape("".join(plain.title)).split()) or None, "Links": plain.links} and envelope["Payload-Length"] == len(source.encode())
            assert x["n_links"] == len(plain.links)
        assert (x["target_uri"], x["source_digest"], x["block_digest"], x["content_length"]) == (url, warc.digest(source.encode()), warc.digest(x["block"].encode()), len(x["block"].encode()))
