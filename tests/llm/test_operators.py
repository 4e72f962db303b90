"""Each corpus operator on edge cases and against a plain version of itself."""

import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("versotext.llm")

from versotext.llm import components, cover_tree, decontaminate, jaccard_join, language, licenses, quality, sentencepiece_scan, token_store, toxicity, warc  # noqa: E402
from versotext.llm.text import ensure_checkpoint_dir, plain_words  # noqa: E402

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def key(row):
    return tuple((v is None, v) for v in row)


# 1: Jaccard join ---------------------------------------------------------------


def shingles(text, n=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in words).split(" ") if w]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def test_jaccard_edges(docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = brute_components(rows)
    out = jaccard_join.jaccard_links(docs).collect()
    assert len(out) == len(rows)
    assert sorted((r["doc_id"], r["n_shingles"]) for r in out if r["doc_id"] is not None) == sorted((i, len(shingles(t))) for i, t in rows if i is not None)
    for r in out:
        assert r["component_id"] == (None if r["doc_id"] is None else expected[r["doc_id"]])
    assert jaccard_join.jaccard_links(no_docs).collect() == []
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted({v for v in expected.values()}) and ids.count(None) == 1


@pytest.mark.parametrize("block", [1024, 64, 8])
def test_jaccard_random(spark, block):
    r = random.Random(block)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    base = [r.choice(vocabulary) for _ in range(90)]
    texts = []
    for i in range(260):
        if i % 3 == 0:  # near copies of one text, most of them not near each other
            words = list(base)
            for _ in range(r.randint(0, 5)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        elif i % 3 == 1:  # a passage that many share
            words = [r.choice(vocabulary) for _ in range(r.randint(0, 12))] + passage
        else:
            words = [r.choice(vocabulary) for _ in range(r.randint(1, 60))]
        texts.append((i * 7 % 1009, " ".join(words)))
    out = jaccard_join.jaccard_links(spark.createDataFrame(texts, "doc_id long, text string"), block=block).collect()
    expected = brute_components(texts)
    assert {x["doc_id"]: x["component_id"] for x in out} == expected


def test_sets_are_moved_once_for_their_groups(spark, tmp_path):
    """Of many classes only a few are in a large group: the others' sets are shuffled once, not for each step that follows."""
    r = np.random.default_rng(5)
    other = [np.sort(r.integers(1, 1 << 62, 400).astype(np.uint64)) for _ in range(1500)]
    # each shares with the next what makes them possible partners, but doesn't link
    sets = [np.unique(np.concatenate((a[:330], b[:60]))) for a, b in zip(other, [*other[1:], other[0]], strict=True)]
    base = r.integers(1, 1 << 62, 400).astype(np.uint64)
    sets += [np.unique(np.concatenate((base[8:], r.integers(1, 1 << 62, 8).astype(np.uint64)))) for _ in range(60)]
    pq.write_table(pa.table({"c": pa.array(range(len(sets)), pa.int64()), "n": pa.array(map(len, sets), pa.int64()), "shingles": pa.array([x.tobytes() for x in sets], pa.binary())}), str(tmp_path / "ones.parquet"))
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def shuffled() -> int:
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()) if stages.apply(i).stageId() > last)

    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    last = max((stages.apply(i).stageId() for i in range(stages.size())), default=-1)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = jaccard_join._class_links(spark.read.parquet(str(tmp_path / "ones.parquet")), 80, 16)
        joined = {x for e in links.collect() for x in e}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    moved = shuffled() / sum(x.nbytes for x in sets)
    assert joined == set(range(1500, 1560)), len(joined)
    assert moved < 5, moved  # 5.9 with a shuffle of all sets for each join, 4.0 without


def test_divide_skip_finds_all():
    r = random.Random(5)
    sets = [np.unique([r.randrange(60) for _ in range(r.randint(1, 40))]).astype(np.uint64) for _ in range(120)]
    lists = jaccard_join._inverted(sets)
    for q in sets[:40]:
        for least in (1, 2, max(1, len(q) // 2), len(q)):
            found = dict(jaccard_join.divide_skip(q, lists, least))
            assert found == {i: n for i, s in enumerate(sets) if (n := len(np.intersect1d(q, s))) >= least}


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 1), (2, 2)]
    out = {x["node"]: x["component"] for x in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert out == {n: find(n) for n in parent}


# 2: token store ------------------------------------------------------------------


@pytest.mark.parametrize("shard", [1 << 20, 50])
def test_token_store_round_trip(spark, docs, no_docs, shard):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    path = f"{ensure_checkpoint_dir(spark)}/store-{shard}"
    token_store.write_token_store(docs, path, BPE, 2, shard_tokens=shard)
    out = [r.asDict() for r in token_store.read_token_store(spark, path, want_ids=True).collect()]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("place")).collect()
    rows = sorted(((r["doc_id"], r["text"], r["place"]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    out.sort(key=lambda r: r["start"])
    start = 0
    for (i, text, _), r in zip(rows, out, strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (i, start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    flat = [t for r in out for t in r["ids"]]
    for b, e in ((0, 5), (start // 3, start // 2), (start - 7, start + 50), (9, 9)):
        assert [(x["at"], x["id"]) for x in token_store.read_ids(spark, path, b, e).orderBy("at").collect()] == list(enumerate(flat))[b:e]
    token_store.write_token_store(no_docs, path, BPE, 2)
    assert token_store.read_token_store(spark, path).collect() == []


def test_encoder_equals_library():
    import pyarrow as pa

    r = random.Random(3)
    texts = ["", None, "  a b", "\na", "a\n", "<|endoftext|> q", "don't, it's.", "\x01 a"]
    texts += ["".join(r.choice(["a", "bc", " ", "\n", ",", ".", "é", "1", "\t", "'s", "X"]) for _ in range(r.randint(1, 30))) for _ in range(600)]
    encoder = token_store.Encoder(BPE)
    ids, counts = encoder.encode(pa.array(texts), 2)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        assert ids[at : at + n].tolist() == [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        at += n


def test_repair_random_access():
    r = np.random.default_rng(1)
    for ids in (np.zeros(0, np.int64), np.array([5]), np.full(5000, 7), np.tile([1, 2, 3, 1, 2], 800), r.integers(0, 40, 20_000), r.integers(0, 50_257, 3000)):
        blob = token_store.compress(ids, 50_257, least=4)
        shard = token_store.Shard(blob)
        assert shard.n == len(ids) and (shard.all() == ids).all()
        for _ in range(20):
            b, e = sorted(r.integers(0, len(ids) + 1, 2))
            assert (shard.read(b, e) == ids[b:e]).all()
    assert len(token_store.compress(np.tile(np.arange(100), 500), 50_257)) < 100 * 500 // 4


def test_repair_goes_on_until_no_pair_is_frequent():
    r = np.random.default_rng(2)
    for ids in (np.full(1 << 16, 7), np.tile(r.integers(0, 50_000, 4096), 64), r.integers(0, 9, 30_000)):
        blob = token_store.compress(ids, 50_257)
        _, alphabet, n, rules, symbols, width = token_store.HEAD.unpack_from(blob)
        s = np.frombuffer(blob, f"<u{width}", symbols, len(blob) - symbols * width).astype(np.int64)
        kept = {}
        at = -2
        last = None
        for i, pair in enumerate(zip(s[:-1].tolist(), s[1:].tolist(), strict=True)):
            if pair != last or i != at + 1:  # of overlapping pairs one counts
                kept[pair] = kept.get(pair, 0) + 1
                last, at = pair, i
            else:
                last = None
        assert max(kept.values(), default=0) < 24 and (token_store.Shard(blob).all() == ids).all()
        for _ in range(10):
            b, e = sorted(r.integers(0, n + 1, 2))
            assert (token_store.Shard(blob).read(b, e) == ids[b:e]).all()


def test_repair_counts_rare_pairs_once(monkeypatch):
    r = np.random.default_rng(4)
    ids = np.concatenate([r.integers(0, 50_000, 100_000), r.integers(0, 50_000, (50, 32))[r.integers(0, 50, 3000)].reshape(-1)])
    counted, count = [], np.bincount
    with monkeypatch.context() as m:
        m.setattr(np, "bincount", lambda x, **more: counted.append(len(x)) or count(x, **more))
        blob = token_store.compress(ids, 50_257)
    each = sum(counted) / len(ids)
    shard = token_store.Shard(blob)
    assert (shard.all() == ids).all() and (token_store.Shard(blob).read(777, 900) == ids[777:900]).all()
    assert each < 4, each  # 5.4 when every round counts all pairs, 3.0 without those found rare


def test_encoder_looks_up_each_word_once():
    import pyarrow as pa

    class Counting(dict):
        n = 0

        def get(self, *key):
            self.n += 1
            return super().get(*key)

        def __contains__(self, key):
            self.n += 1
            return super().__contains__(key)

        def __getitem__(self, key):
            self.n += 1
            return super().__getitem__(key)

    encoder = token_store.Encoder(BPE)
    encoder.spaced = Counting(encoder.spaced)
    r = random.Random(6)
    words = ["".join(r.choice("aeioudstlrn") for _ in range(8)) for _ in range(1000)]
    texts = ["x " + " ".join(w + r.choice(["", ",", "."]) for w in r.choices(words, k=300)) for _ in range(60)]
    for _ in range(2):
        encoder.spaced.n = 0
        ids, counts = encoder.encode(pa.array(texts), 2)
        assert encoder.spaced.n <= len(words), encoder.spaced.n  # 5,984 with one to find and one to fetch a word, again for each ending mark
    assert ids.tolist() == [i for t in texts for i in [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2]]


# 3: decontamination ------------------------------------------------------------------


def test_token_store_splits_rows_without_an_id(spark):
    """Very many rows that share an id, or have none, are dealt to several ranges; the order stays that of the ids."""
    rows = spark.range(4000).selectExpr("if(id < 3000, cast(null as long), if(id < 3900, 7, id)) as doc_id", "concat('text ', id) as text")
    path = f"{ensure_checkpoint_dir(spark)}/store-nulls"
    token_store.write_token_store(rows, path, BPE, 2, files=8)
    parts = spark.read.parquet(path).groupBy("part").agg(F.sum("n_docs").alias("n")).collect()
    assert len(parts) >= 6 and max(r["n"] for r in parts) < 1500
    out = token_store.read_token_store(spark, path).orderBy("start").collect()
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in out]
    assert ids == sorted(ids) and ids.count(-1) == 3000 and ids.count(7) == 900
    assert [r["start"] for r in out] == [0, *np.cumsum([r["n_tokens"] for r in out])[:-1].tolist()]


@pytest.mark.parametrize("inline,small", [(4096, 200_000), (0, 200_000), (0, 0)])
def test_decontamination(spark, inline, small):
    r = random.Random(9)
    vocabulary = [f"W{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 60)))) for i in range(25)] + [(90, ""), (91, None), (None, "a b c d e f")]
    texts = []
    for i in range(80):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 150))]
        if i % 2:
            own = items[r.randrange(25)][1].split()
            if i % 4 == 1 and len(own) > 8:
                own[r.randrange(len(own))] = "changed"
            words[len(words) // 2 : len(words) // 2] = own
        texts.append((i, "\t".join(words)))
    texts += [(100, None), (101, ""), (None, items[0][1]), (1, texts[1][1])]
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = {(x["doc_id"], x["item_id"]): (x["n_common"], x["n_item"]) for x in decontaminate.contaminated(d.withColumn("h", F.lit(1)), b, inline=inline, small=small, small_bytes=small).collect()}
    expected = {}
    for i, t in texts:
        for j, u in items:
            a, q = shingles(t), shingles(u)
            if i is not None and j is not None and a and q and len(a & q) * 100 >= len(q) * 80:
                expected[(i, j)] = (len(a & q), len(q))
    assert out == expected and len(expected) > 20
    assert decontaminate.contaminated(d, b.limit(0)).collect() == []
    assert decontaminate.contaminated(d.limit(0), b, inline=inline, small=small).collect() == []


def test_decontamination_runs_no_python(spark, docs):
    plan = decontaminate.contaminated(docs, docs.selectExpr("doc_id as item_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# 4: quality -----------------------------------------------------------------------------


def test_quality(spark, docs, no_docs):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("aeinrstlo") for _ in range(r.randint(2, 8))) for _ in range(900)]
    good = [(i, "\n".join(" ".join(r.choice(vocabulary) for _ in range(15)).capitalize() + "." for _ in range(5))) for i in range(60)]
    bad = [(100 + i, " ".join(r.choice(vocabulary) + "&&&###" for _ in range(80))) for i in range(15)] + [(200 + i, (r.choice(vocabulary).upper() + " ") * 120) for i in range(15)]
    out = {x["doc_id"]: x for x in quality.classify_quality(spark.createDataFrame(good + bad, "doc_id long, text string")).collect()}
    assert all(out[i]["keep"] for i, _ in good) and not any(out[i]["keep"] for i, _ in bad)
    edge = quality.classify_quality(docs).collect()
    assert len(edge) == docs.count() and all(0 <= x["score"] <= 1 for x in edge)
    assert quality.classify_quality(no_docs).collect() == []


def test_em_recovers_accuracies():
    r = np.random.default_rng(0)
    y = r.random(20_000) < 0.7
    accuracy = (0.95, 0.8, 0.7, 0.9)
    votes = ["".join("0" if r.random() < 0.2 else "+" if (v if r.random() < a else not v) else "-" for a in accuracy) for v in y]
    patterns = {p: votes.count(p) for p in set(votes)}
    posterior, theta, prior = quality.em(patterns)
    assert abs(prior - 0.7) < 0.03
    for j, a in enumerate(accuracy):
        assert abs(theta[j, 1, 2] - a) < 0.04
    assert np.mean([(posterior[v] >= 0.5) == t for v, t in zip(votes, y, strict=True)]) > 0.93


# 5: licences -----------------------------------------------------------------------------


def brute_license(text):
    words = plain_words((text or "").encode())
    places = [(i, label) for p, label in licenses.BASE_PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.encode().split()]
    return len(words), places


def test_licenses(spark, docs, no_docs):
    extra = [(50, "x Under the MIT-License! under THE mit license"), (51, "Apache License, Version 2 and CC BY-NC"), (52, "This work is licensed under the GNU General Public License, version 3."), (53, "cc by"), (54, "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met")]
    frame = docs.select("doc_id", "text", "h").unionByName(spark.createDataFrame(extra, "doc_id long, text string").withColumn("h", F.lit(0).cast("long")))
    out = licenses.scan_licenses(frame).collect()
    texts = {}
    for r in frame.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert len(out) == frame.count()
    for r in out:
        options = []
        for t in texts[r["doc_id"]]:
            n, places = brute_license(t)
            starts = [p for p, _ in places]
            options.append((n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) in options
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["labels"] for r in out}
    assert labels[50] == "mit" and labels[51] == "apache-2,cc-by-nc" and labels[52] == "gpl-3" and labels[53] == "" and labels[54] == "bsd" and labels[4] == ""
    assert licenses.scan_licenses(no_docs).collect() == []


def brute_templates(index, words):
    """Every template compared at every place."""
    out = []
    for t, ws in enumerate(index.words):
        slack, total, held = index.slack[t], sum(index.idf[w] for w in ws), []
        for begin in range(-len(ws) - slack, len(words)):
            places = [[i for i in range(max(0, begin + j), min(len(words), begin + j + slack + 1)) if words[i] == w] for j, w in enumerate(ws)]
            share = sum(index.idf[w] for w, own in zip(ws, places, strict=True) if own) / total
            near = b" " + b" ".join(words[max(0, begin - 4) : max(0, begin + len(ws) + slack + 8)]) + b" "
            if share >= index.share and all(m in near for m in index.mandatory[t]):
                held.append((begin, share, min(own[0] for own in places if own)))
        runs = []
        for x in held:
            if runs and x[0] - runs[-1][-1][0] <= slack + 1:
                runs[-1].append(x)
            else:
                runs.append([x])
        out += [(index.labels[t], max(run, key=lambda x: (round(x[1], 12), -x[0]))[2], max(x[1] for x in run)) for run in runs]
    return sorted(out)


def same_matches(found, expected):
    return [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in expected] and np.allclose([c for *_, c in found], [c for *_, c in expected])


def test_words_put_in_or_left_out():
    """A company's name in the middle, a heading, words left out: the licence is still found, and other prose isn't."""
    index = licenses.Index({}, 1000)
    for t in licenses.TEMPLATES:
        words = t.text.split()
        if len(words) < 40:
            continue
        for change in (["acme", "corporation"], ["acme"]):
            for at in (len(words) // 3, 2 * len(words) // 3):
                phrases = [i for m in t.mandatory for i in range(len(words)) if words[i : i + len(m.split())] == m.split() and i < at < i + len(m.split())]
                file = " ".join([*"some heading of the file".split(), *words[:at], *change, *words[at:], *"and more text".split()]).encode().split()
                if not phrases:
                    assert t.label in {label for label, _, share in index.matches(file) if share > 0.9}, (t.label, at)
        shorter = " ".join(words[: len(words) // 2] + words[len(words) // 2 + 2 :]).encode().split()
        if all(m in t.text.replace(" ".join(words[len(words) // 2 : len(words) // 2 + 2]), "") for m in t.mandatory):
            assert t.label in {label for label, _, _ in index.matches(shorter)}
    prose = "this software is fine and the license of my car says that any person may drive it for any purpose without a fee".encode().split()
    assert index.matches(prose * 5) == []


def test_all_statements_in_one_file(spark):
    r = random.Random(12)
    statements = [t.text for t in licenses.TEMPLATES]
    files = [" ".join(statements), " and ".join(reversed(statements)), statements[10] + " " + " ".join(statements[i] for i in (1, 8, 9, 14, 16, 17, 18))]
    vocabulary = " ".join(statements).split()
    for n in range(20):  # some words of each statement replaced, half of them by licence words
        files.append(" ".join(w if r.random() > 0.01 * n else r.choice([r.choice(vocabulary), "changed"]) for w in files[n % 3].split()))
    common = {w.encode(): 9000 if len(w) < 4 else 500 if len(w) < 8 else 20 for w in vocabulary}
    for k, frequency in enumerate(({}, common, {w: 10_000 - n for w, n in common.items()})):
        index = licenses.Index(frequency, 10_000)
        for f in files[k::3]:
            words = f.encode().split()
            assert same_matches(index.matches(words), brute_templates(index, words))
    out = licenses.scan_licenses(spark.createDataFrame(list(enumerate(files)), "doc_id long, text string")).collect()
    labels = {x["doc_id"]: set(x["labels"].split(",")) for x in out}
    assert labels[0] == labels[1] == {t.label for t in licenses.TEMPLATES} and "gpl-2" in labels[2]


# 6: toxicity -----------------------------------------------------------------------------


def _toxic_rows(n, seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeinrstlo") for _ in range(5)) for _ in range(200)]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            words[3] = r.choice(["idiot", "idiots", "moronic", "scum"])
        if i % 3 == 0 or (toxic and r.random() < 0.7):
            words[5] = "women" if toxic else r.choice(["men", "women"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity(spark, docs, no_docs):
    rows = _toxic_rows(600, 1)
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "idiot"), (9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, toxic int, text int")
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(frame, labels).collect()}
    assert len(out) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in out.values())
    held = [(out[i]["predicted"], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 80 and np.mean([p == y for p, y in held]) > 0.97
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.score_toxicity(no_docs, labels).collect() == []


def test_fewer_false_positives_on_neutral_mentions():
    """Toxic rows name one group far more often than others do: only without the penalty the group itself looks toxic."""
    r = random.Random(2)
    vocabulary = ["".join(r.choice("aeinrstlo") for _ in range(5)) for _ in range(300)]
    for group, others in ((b"women", [b"men", b"girls", b"boys"]), (b"muslime", [b"christen", b"juden"]), (b"judios".replace(b"i", "í".encode()), [b"ateos"]), (b"africains", [b"noirs"])):
        rows = []
        for i in range(800):
            words = [r.choice(vocabulary) for _ in range(25)]
            if i % 4 == 0:
                # a third is toxic by words of its own that the fit sees once, so that the group term is what it can hold on to
                words[3] = r.choice(["idiot", "scum", "moronic", f"slur{i}"])
                words[5] = group.decode()
            elif i % 40 == 1:
                words[5] = group.decode()
            elif i % 40 == 2:
                words[5] = r.choice(others).decode()
            rows.append((" ".join(words).encode(), int(i % 4 == 0)))
        texts, y = [t for t, _ in rows], [v for _, v in rows]
        plain, fair = toxicity.fit(texts, y, swap=0.0), toxicity.fit(texts, y, swap=5.0)
        neutral = [" ".join([*(r.choice(vocabulary) for _ in range(20)), group.decode()]).encode() for _ in range(200)]

        def wrong(model, rows=neutral):
            return np.mean([model.score(set(plain_words(t))) >= 0.5 for t in rows])

        def change(model, group=group, others=others, rows=neutral):
            return np.mean([abs(model.score(set(plain_words(t.replace(group, others[0])))) - model.score(set(plain_words(t)))) for t in rows])

        assert wrong(plain) > 0.15 and wrong(fair) < 0.02
        assert change(fair) < 0.1 * change(plain)
        toxic = [t for t, v in rows if v and b"slur" not in t]
        assert wrong(fair, toxic) > 0.95


def test_swapped_copies():
    own = set("the women and the muslim baker".encode().split())
    copies = toxicity.swapped_copies(own, 12)
    assert copies[0] == {b"the", b"and", b"baker"} and all(len(c & toxicity.TERMS) == 2 for c in copies[1:])
    assert {b"the", b"and", b"baker", b"men", b"jew"} in copies and len(copies) == 11
    assert toxicity.swapped_copies({b"no", b"group"}, 12) == []
    assert len(toxicity.swapped_copies(own, 3)) == 4


def test_toxicity_edges_with_a_fitted_model(docs):
    rows = _toxic_rows(400, 5)
    model = toxicity.fit([t.encode() for _, t, _ in rows], [y for *_, y in rows])
    assert model.words
    out = toxicity.score(docs, model).collect()
    expected = [(r["doc_id"], model.score(set(plain_words((r["text"] or "").encode())))) for r in docs.collect()]
    assert sorted(map(tuple, out), key=str) == sorted(expected, key=str)
    bias = float(1 / (1 + np.exp(-model.bias)))
    assert all(abs(r["score"] - bias) < 1e-12 for r in out if r["doc_id"] in (5, 6, 7))


# one sampler for 4, 6 and 10 --------------------------------------------------------------


def test_samples_are_bounded(spark):
    """A million rows without an id, classes of 1 to 1000, an id that stands in very many rows: the bound holds in the plan."""
    from versotext.llm import text as helpers

    big = spark.range(1_000_000).selectExpr("cast(null as long) as doc_id", "concat('t', id) as text", "if(id % 1000 = 0, 'rare', 'big') as c")
    taken, counts = helpers.bounded_sample(big, "c", 300)
    rows = taken.collect()
    assert counts == {"rare": 1000, "big": 999_000}
    assert [sum(r["c"] == c for r in rows) for c in ("rare", "big")] == [300, 300]
    low = sum(int(r["text"][1:]) < 500_000 for r in rows if r["c"] == "big")
    assert 90 < low < 210
    same = spark.range(200_000).selectExpr("cast(5 as long) as doc_id", "if(id < 50, concat('t', id), 'same') as text", "'c' as c")
    rows = helpers.bounded_sample(same, "c", 30)[0].collect()
    assert len(rows) == 30 and len({r["text"] for r in rows}) == 30
    assert helpers.bounded_sample(big.limit(0), "c", 30)[0].collect() == []


def test_quality_sample_is_bounded(spark, monkeypatch):
    """Two classes of very different size, all ids null: no more than the bound reaches the fit, of either class."""
    good = "\n".join(" ".join(["morning", "birds", "sang", "over", "quiet", "fields", "again", "today"]) + f" {k}." for k in range(5))
    rows = spark.range(60_000).selectExpr("cast(null as long) as doc_id", f"if(id % 600 = 0, concat(repeat('&&&### ', 60), id), concat('{good}', id, '.')) as text")
    got = {}
    real = quality.fit
    monkeypatch.setattr(quality, "fit", lambda texts, posterior, **more: (got.update(p=posterior), real(texts, posterior, **more))[1])
    quality.classify_quality(rows, sample=50)
    assert sum(p >= 0.5 for p in got["p"]) == 50 and sum(p < 0.5 for p in got["p"]) == 50


# 7: top k --------------------------------------------------------------------------------


def brute_top(rows, k):
    clean = [(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in sorted(set(clean)):
        if q % 50 == 0:
            scores = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True)))), i) for i, b in clean if i != q and len(b) == len(a))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [32_768, 40])
def test_top_k(spark, block):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(r.normal(size=6) * (3 if i % 7 else 0.01), 2)]) for i in range(230)]
    rows += [(300, rows[0][1]), (350, rows[0][1]), (301, rows[0][1]), (400, None), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, rows[1][1]), (5, rows[5][1]), (5, rows[5][1]), (300, rows[0][1]), (450, [1.0, 2.0]), (451, [3.0, 4.0]), (452, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("x")).withColumn("id", F.lit("x"))
    expected = brute_top([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 5)
    for sample in (2048, 20):
        out = cover_tree.top_k(frame, F.col("vec_id") % 50 == 0, block=block, query_block=3, sample=sample)
        assert sorted(tuple(x) for x in out.collect()) == expected
    few = frame.where("vec_id in (0, 1, 2)")
    assert cover_tree.top_k(few, F.col("vec_id") % 50 == 0).count() == 2
    assert cover_tree.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_top_k_beyond_64_bits(spark):
    rows = [(0, [1e12, -3e14]), (1, [2e12, 5e14]), (2, [1e18, 1e18]), (3, [-1e18, -1e18]), (4, [1.0, 1e30]), (50, [3e4, 1e5])]
    out = cover_tree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    top = 2**63
    cut = [(i, [max(-top, min(top - 1, int(np.floor(256 * x)))) / 256 for x in v]) for i, v in rows]
    assert [(x["query_id"], x["vec_id"]) for x in out.orderBy("query_id", "rank").collect()] == [(q, i) for q, _, i, _ in brute_top(cut, 5)]


def clusters(n, size, d, spread, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n, d)) * 900
    return np.floor(np.vstack([c + r.normal(size=(size, d)) * spread for c in centres])).astype(np.int64)


def test_cover_tree_invariants():
    r = np.random.default_rng(6)
    for x in (clusters(40, 60, 16, 20, 1), r.normal(size=(900, 3)) * 1000, np.repeat(r.normal(size=(30, 5)), 40, axis=0), r.normal(size=(2000, 64)), np.zeros((500, 4))):
        tree = cover_tree.CoverTree(x, 8)
        below = tree.below()
        assert sorted(below[0].tolist()) == list(range(len(x)))
        for node, rows in enumerate(below):
            point = tree.x[tree.point[node]]
            far = np.linalg.norm(tree.x[rows] - point, axis=1).max()
            assert abs(far - tree.radius[node]) < 1e-6 and far <= 2.0 ** tree.level[node] + 1e-9 and len(rows) == tree.size[node]
            own = tree.children[node]
            if own:
                assert tree.point[node] in [tree.point[c] for c in own] and all(tree.level[c] <= tree.level[node] - 1 for c in own)
                places = tree.x[[tree.point[c] for c in own]]
                apart = np.linalg.norm(places[:, None] - places[None], axis=2)[~np.eye(len(own), dtype=bool)]
                assert (apart > 2.0 ** (tree.level[node] - 1)).all()
                for c in own:  # nearest of the siblings
                    d = np.linalg.norm(tree.x[below[c]][:, None] - places[None], axis=2)
                    assert (d.min(axis=1) >= np.linalg.norm(tree.x[below[c]] - tree.x[tree.point[c]], axis=1) - 1e-6).all()
    assert len(cover_tree.CoverTree(clusters(40, 60, 16, 20, 1), 8).cut(50)) >= 40


def test_dual_trees_prune_exactly():
    x = clusters(60, 300, 16, 30, 8)
    q = np.arange(0, len(x), 50)
    counts = {}
    place, ids, score = cover_tree.search(x[q], q, x, np.arange(len(x)), 5, counts=counts)
    full = x[q] @ x.T
    full[np.arange(len(q)), q] = np.iinfo(np.int64).min
    for n in range(len(q)):
        order = np.lexsort((np.arange(len(x)), -full[n].astype(np.float64)))[:5]
        assert ids[place == n].tolist() == order.tolist() and score[place == n].tolist() == full[n][order].tolist()
    assert counts["compared"] < 0.2 * counts["all"]


def test_pairs_of_cells_are_skipped_before_the_shuffle(spark):
    x = clusters(30, 100, 8, 15, 9)
    rows = [(i, (v / 256).tolist()) for i, v in enumerate(x)]
    counts = {}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = cover_tree.top_k(frame, F.col("vec_id") % 50 == 0, block=100, query_block=2, counts=counts)
    assert sorted(map(tuple, out.collect())) == brute_top(rows, 5)
    assert counts["kept"] < 0.3 * counts["all"] and counts["all"] > 400


# 8: WARC ----------------------------------------------------------------------------------


def test_warc(spark):
    page = '<!DOCTYPE html><html><head><title>A &amp; B</title><script>var t="<p>no</p>";</script></head><body><p>One<br>two &lt;x&gt;</p><a href="/l?a=1&amp;b=2">Link</a><!-- gone --><img src=pic.png alt="x"></body></html>'
    rows = [(1, "http://a.example/", page), (2, "http://b.example/", None), (None, None, "<p>x"), (3, "http://c.example/", ""), (4, "u", "<p>unclosed <b>text" + " more" * 50_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit(1))
    out = warc.derivatives(frame).collect()
    assert len(out) == 10
    by = {(r["page_id"], r["record_type"]): r for r in out}
    meta, text = by[(1, "metadata")], by[(1, "conversion")]
    assert text["block"] == "One\ntwo <x>\nLink"
    assert meta["n_links"] == 2 and '"/l?a=1&b=2"' in meta["block"] and '"A & B"' in meta["block"]
    for r in out:
        raw = r["record"].encode()
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and fields["WARC-Type"] == r["record_type"] and fields["WARC-Refers-To"] == r["refers_to"]
        block = rest[: int(fields["Content-Length"])]
        assert rest[len(block) :] == b"\r\n\r\n" and block.decode() == r["block"] and fields["WARC-Block-Digest"] == warc.digest(block)
    assert meta["refers_to"] == text["refers_to"] and meta["record_id"] != text["record_id"] and meta["source_digest"] == warc.digest(page.encode())
    assert by[(2, "conversion")]["block"] == "" and warc.derivatives(frame.limit(0)).collect() == []
    assert {r["record_id"] for r in warc.derivatives(frame).collect()} == {r["record_id"] for r in out}


@pytest.mark.parametrize("icon", ['<svg class="i"/>', "<svg/>", "<SVG data-x='a>b' />", "<svg width=1 title=it's />", "<svg width=1/>", '<svg class="i"><path d="M0"/>gone</svg>', '<svg viewBox="0"><svg/><b>gone</b></svg>', '<svg-icon name="x"></svg-icon>', "<template-part></template-part>"])
def test_text_after_icons_is_kept(icon):
    page = f'<p>a{icon}</p><p>it\'s b</p><br/><a href="/x">c</a>{icon}<title>T</title><p>d</p>'
    assert warc.page_text(page) == "a\nit's b\nc\nd"
    assert warc.page_links(page) == [{"path": "A@/href", "url": "/x"}]
    assert '"Title": "T"' in warc.derive(1, "u", "d", page.encode(), [])[0][-2]


def test_warc_source_headers(spark):
    own = ("<urn:uuid:8a1f3c52-0000-4000-8000-000000000001>", "2024-05-06T07:08:09Z", 404, [("Server", "x"), ("Set-Cookie", "a=1"), ("set-cookie", "b=2")], "sha1:GIVEN")
    rows = [(1, "u", "<p>a", *own), (1, "u", "<p>a", own[0][:-2] + "2>", *own[1:]), (2, "u", "<p>a", None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, rid string, at string, code int, http array<struct<k:string,v:string>>, sha string")
    names = {"record_id_col": "rid", "date_col": "at", "status_col": "code", "headers_col": "http", "digest_col": "sha"}
    out = warc.derivatives(frame, **names).collect()
    assert len({r["record_id"] for r in out}) == 6
    for r in out:
        head = dict(line.split(": ", 1) for line in r["record"].split("\r\n\r\n")[0].split("\r\n")[1:])
        assert (head["WARC-Refers-To"], head["WARC-Date"], head["WARC-Source-Payload-Digest"]) == (r["refers_to"], r["warc_date"], r["source_digest"])
    first = [r for r in out if r["refers_to"] == own[0]]
    assert len(first) == 2 and all((r["warc_date"], r["source_digest"]) == (own[1], own[4]) for r in first)
    envelope = json.loads(next(r["block"] for r in first if r["record_type"] == "metadata"))["Envelope"]
    assert envelope["HTTP-Response"] == {"Status": "404", "Headers": {"Server": "x", "Set-Cookie": ["a=1", "b=2"]}} and envelope["WARC-Header"]["WARC-Record-ID"] == own[0]
    plain = {tuple(r) for r in warc.derivatives(frame.where("page_id = 2")).collect()}
    assert {tuple(r) for r in out if r["page_id"] == 2} == plain
    mapped = warc.derivatives(frame.withColumn("http", F.create_map(F.lit("Server"), F.lit("y"))), headers_col="http").where("record_type = 'metadata'").collect()
    assert all(json.loads(r["block"])["Envelope"]["HTTP-Response"]["Headers"] == {"Server": "y"} for r in mapped)


def test_long_pages_take_time_in_proportion():
    import time

    pages = ["<a " * 350_000, "<a href=\"" * 100_000, "<script " * 130_000, "<title>" * 150_000, "<!-- " * 200_000, "<a t=\"x>\" " * 100_000 + "u=\"", "<svg " * 200_000, "<" * 1_000_000, "<! " * 330_000, "</script " * 110_000, "<a x='>" * 140_000, "<p " + "a" * 1_000_000, "<a href" + " " * 1_000_000 + "x", "<a" + " href" * 200_000 + ">", "<script>" + "</script " * 100_000]
    for page in pages:
        begin = time.process_time()
        warc.derive(1, "u", "d", page.encode(), [])
        assert time.process_time() - begin < 2, page[:20]


def test_unclosed_quotes_and_odd_tags():
    page = 'a <b title="x>y">bold</b> 1 < 2 <a href="/one">one</a> <a title=it\'s href=/two>two</a><a data-href="/no" title="href=/no" href=\'/three\'>three</a> <i class="open>rest</i> <a href=/four>four</a> end'
    assert warc.page_text(page) == "a bold 1 < 2 one twothree rest four end"
    assert [x["url"] for x in warc.page_links(page)] == ["/one", "/two", "/three", "/four"]
    assert warc.page_text("<title>no end <p>x") == "no end\nx"


def test_warc_repeated_rows_and_links(spark, tmp_path):
    import gzip

    rows = [(1, "u", "<p>a<p>b"), (1, "u", "<p>a<p>b"), (2, "v", "x" * 1_000_000 + "<p>é")]
    out = warc.derivatives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = out.collect()
    assert len(got) == 6 and len({r["record_id"] for r in got}) == 4
    by = {r["record_id"]: r for r in got}
    assert all(by[r["concurrent_to"]]["concurrent_to"] == r["record_id"] and by[r["concurrent_to"]]["record_type"] != r["record_type"] for r in got)
    warc.write_warc(out.coalesce(1), f"{tmp_path}/warc")
    (file,) = tmp_path.glob("warc/*.gz")
    raw, records = gzip.decompress(file.read_bytes()), []
    while raw:  # by the lengths that the records themselves give
        head, _, rest = raw.partition(b"\r\n\r\n")
        n = int(dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        records.append((head + b"\r\n\r\n" + rest[: n + 4]).decode())
        raw = rest[n + 4 :]
    assert sorted(records) == sorted(r["record"] for r in got)


def test_derivatives_of_response_records(spark):
    body = "<title>T</title><p>é"
    http = "HTTP/1.1 404 Not Found\r\nServer: x\r\nSet-Cookie: a=1\r\nSet-Cookie: b: 2\r\n\r\n" + body
    record = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: 2024-05-06T07:08:09Z\r\nWARC-Target-URI: http://a.example/\r\nWARC-Payload-Digest: sha1:GIVEN\r\nContent-Length: {len(http.encode())}\r\n\r\n{http}\r\n\r\n".encode()
    rows = [(record,), (record.replace(b"\r\n", b"\n").replace(b"uuid:1", b"uuid:2"),), (b"",), (b"WARC/1.1\r\n\r\n<p>bare",), (None,)]
    found = warc.responses(spark.createDataFrame(rows, "record binary"))
    out = warc.derivatives(found, **warc.SOURCE).collect()
    assert len(out) == 8
    first = {r["record_type"]: r for r in out if r["refers_to"] == "<urn:uuid:1>"}
    assert first["conversion"]["block"] == "é" and (first["metadata"]["warc_date"], first["metadata"]["source_digest"], first["metadata"]["target_uri"]) == ("2024-05-06T07:08:09Z", "sha1:GIVEN", "http://a.example/")
    envelope = json.loads(first["metadata"]["block"])["Envelope"]
    assert envelope["HTTP-Response"] == {"Status": "404", "Headers": {"Server": "x", "Set-Cookie": ["a=1", "b: 2"]}} and envelope["HTML"]["Title"] == "T"
    assert "bare" in {r["block"] for r in out} and warc.responses(found.limit(0).select(F.lit(b"").alias("record"))).collect() == []


# 9: SentencePiece ----------------------------------------------------------------------------


def plain_path(vocab, text):
    """Best path over the whole text, without words or chunks."""
    return vocab.word(sentencepiece_scan.SPACE + text.replace(" ", sentencepiece_scan.SPACE)) if text else []


def test_search_walks_a_tree_of_pieces():
    """The tree holds what the table does, and the search finds what one over all substrings of the table finds, without the table."""
    vocab = sentencepiece_scan.Vocabulary(PIECES)
    r = random.Random(9)
    texts = ["", "a", "日本語🎉", *("".join(r.choice("etaoin shrdlu▁▁qzß0日🎉") for _ in range(r.randint(1, 60))) for _ in range(60))]
    expected = []
    for text in texts:
        best, back, ids = [0] + [sentencepiece_scan.NEVER] * len(text), [0] * (len(text) + 1), [0] * (len(text) + 1)
        for p in range(len(text)):
            edges = [(e, *vocab.table[text[p:e]]) for e in range(p + 1, min(len(text), p + vocab.longest) + 1) if vocab.table.get(text[p:e], (-1, 0))[0] >= 0]
            if not any(e == p + 1 for e, _, _ in edges):
                edges.append((p + 1, -1 - ord(text[p]), vocab.unknown))
            for e, i, score in edges:
                if best[p] + score > best[e]:
                    best[e], back[e], ids[e] = best[p] + score, e - p, i
        expected.append((best, back, ids))
    held, left = {}, [("", vocab.tree)]
    while left:
        head, level = left.pop()
        for c, (i, score, following) in level.items():
            held[head + c] = (i, score)
            left.append((head + c, following))
    assert held == vocab.table
    vocab.table = {}
    assert [vocab.search(t, len(t), [0]) for t in texts] == expected


def test_scan_equals_whole_path():
    vocab = sentencepiece_scan.Vocabulary(PIECES)
    r = random.Random(1)
    texts = ["", "a", " a", "a  b", "\n", "日本語テスト" * 9, "a" * 90, "internationalization" * 12, "thethetheninging" * 9, "x\U0001f600y " * 7]
    texts += ["".join(r.choice("aeinthrs ") for _ in range(r.randint(1, 250))) for _ in range(60)]
    for t in texts:
        whole = plain_path(vocab, t)
        assert vocab.encode(t).tolist() == whole and vocab.decode(vocab.encode(t)) == t
        for chunk, block in ((1, 1), (17, 3), (40, 64), (100, 2)):
            assert sentencepiece_scan.encode_scan(vocab, t, chunk, block).tolist() == whole


def test_long_words():
    """Unspaced texts of several scripts: no recursion, time in proportion, memory bounded."""
    import pyarrow as pa

    vocab = sentencepiece_scan.Vocabulary(PIECES)
    r = random.Random(4)
    scripts = ["".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(50_000)), "".join(chr(r.randrange(0xE01, 0xE3A)) for _ in range(50_000)), "".join(chr(r.randrange(0x3041, 0x3094)) for _ in range(50_000)), "!" * 50_000, "ab" * 25_000, "\U0001f600" * 50_000]
    for t in scripts:
        assert vocab.encode(t).tolist() == plain_path(vocab, t)
        assert vocab.encode_all(pa.array([t, "x"]))[0].as_py() == plain_path(vocab, t)
        assert vocab.decode(vocab.encode(t)) == t
    assert max(map(len, vocab.memory)) <= vocab.memory.LONGEST and vocab.memory.held < vocab.memory.FULL
    vocab.memory.FULL = 50_000
    words = ["".join(r.choice("abcdefgh,.!") for _ in range(r.randint(1, 70))) for _ in range(2000)]
    assert all(vocab.encode(w).tolist() == plain_path(vocab, w) for w in words) and vocab.memory.held < 50_000


def test_words_have_the_best_score():
    vocab = sentencepiece_scan.Vocabulary(PIECES)

    def score(parts):
        return sum(vocab.table[p][1] if vocab.table.get(p, (-1, 0))[0] >= 0 else vocab.unknown for p in parts)

    def segmentations(text):
        if not text:
            yield []
        for n in range(1, len(text) + 1):
            if n == 1 or vocab.table.get(text[:n], (-1, 0))[0] >= 0:
                for rest in segmentations(text[n:]):
                    yield [text[:n], *rest]

    for word in ("hello", "theirs", "Straße", "running", "xyzzy", "co-op", "42", "日本"):
        text = sentencepiece_scan.SPACE + word
        best = max(map(score, segmentations(text)))
        own = [vocab.names[i] for i in vocab.encode(word)]
        assert "".join(own) == text and score(own) == best


def test_encode_and_decode(spark, docs, no_docs):
    vocab = sentencepiece_scan.Vocabulary(PIECES)
    for options in ({}, {"giant": 60, "chunk": 20}, {"giant": 60, "chunk": 20, "block": 3}):
        out = sentencepiece_scan.encode(docs, PIECES, **options)
        rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: key((r[0], r[1] or "")))
        expected = sorted(((i, vocab.encode(t).tolist() if t else []) for i, t in rows), key=str)
        assert sorted(((r["doc_id"], r["ids"]) for r in out.collect()), key=str) == expected
        back = sentencepiece_scan.decode(out, PIECES).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
        both = sentencepiece_scan.encode_with_text(docs, PIECES, **options).collect()
        assert all(r["n_pieces"] == len(r["ids"]) for r in both) and len(both) == len(rows)
        digests = [(i, len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()), len(t or ""), zlib.crc32((t or "").encode())) for i, t in rows for ids in [plain_path(vocab, t)]]
        assert sorted(map(tuple, sentencepiece_scan.encode_digest(docs, PIECES, **options).collect()), key=str) == sorted(digests, key=str)
        assert sentencepiece_scan.encode(no_docs, PIECES, **options).collect() == []


# 10: language -----------------------------------------------------------------------------------


def test_language(spark, docs, no_docs):
    r = random.Random(6)
    words = {"en": "the of and to in that was with for this from have are which".split(), "de": "der die und das ist nicht mit sich auf für eine auch über".split(), "fr": "le la les des est que pour dans une avec être était ça".split()}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(r.randint(3, 30))), lang) for i, lang in enumerate(sorted(words) * 80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {x["doc_id"]: x for x in language.identify_language(frame).collect()}
    held = [(out[i]["lang_pred"], lang) for i, _, lang in rows if out[i]["held_out"]]
    assert len(held) > 50 and np.mean([p == lang for p, lang in held]) > 0.97
    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, x in out.items())
    edge = {x["doc_id"]: x for x in language.identify_language(docs).collect()}
    assert all(edge[i]["lang_pred"] == "und" and edge[i]["score"] == 0 for i in (5, 6, 7, 12))
    assert len(language.identify_language(docs).collect()) == docs.count() and language.identify_language(no_docs).collect() == []
    nothing = language.predict(docs, None).collect()
    assert {x["lang_pred"] for x in nothing} == {"und"}
    kept = language.keep_identified(docs, None)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()}.isdisjoint({5, 6, 7, 12})


def test_number_signs_are_no_letters(spark):
    rows = [(i, t) for i, t in enumerate(["½", "²", "Ⅷ", "①", "१२३", "_", "a", "é", "日", "ª", "42 m", ""])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = language.fit(["ab cd", "xy z"] * 30, ["u", "v"] * 30)
    out = {x["doc_id"]: x["lang_pred"] for x in language.predict(frame, model).collect()}
    assert [i for i in out if out[i] != "und"] == [6, 7, 8, 9, 10]
    assert {x["doc_id"] for x in language.keep_identified(frame, model, 0.0).collect()} == {6, 7, 8, 9, 10}


def test_language_counts_all_rows_and_samples_all_ids(spark, monkeypatch):
    r = random.Random(15)
    rows = [(i, " ".join(r.choice(["der", "und", "the", "straße", "日本", f"w{i}"]) for _ in range(r.randint(0, 9))), "a" if i % 3 else "b") for i in range(900)] + [(None, "x y", "a"), (900, None, "a"), (901, "no language", None)]
    got = {}
    monkeypatch.setattr(language, "fit", lambda texts, languages, **more: got.update(texts=texts, languages=languages, **more))
    language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.expr("doc_id is null or doc_id % 10 <> 0"), per_language=100)
    eligible = [(i, t) for i, t, lang in rows if t is not None and lang is not None and (i is None or i % 10)]
    expected = np.zeros(language.BUCKETS)
    for ids, _ in language._features([t for _, t in eligible]):
        expected[ids] += 1
    frequency, documents = got["corpus"]
    assert documents == len(eligible) and (frequency == expected).all()
    assert got["languages"].count("a") == 100
    places = {}
    for i, t in eligible:
        places.setdefault(t, i)
    last = [t for t, lang in zip(got["texts"], got["languages"], strict=True) if lang == "a" and (places[t] or 0) >= 750]
    assert len(last) >= 5


def test_calibration_is_a_probability():
    r = random.Random(7)
    texts = ["".join(r.choice("ab" if i % 2 else "bc") for _ in range(12)) for i in range(300)]
    model = language.fit(texts, ["x" if i % 2 else "y" for i in range(300)])
    p = model.probabilities(texts)
    assert np.allclose(p.sum(axis=1), 1) and model.temperature > 0
