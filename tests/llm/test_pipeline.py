"""The corpus pipeline, held against a plain version on a small corpus with planted cases."""

import random

import pytest

pytest.importorskip("versotext.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .test_operators import PIECES, brute_components, shingles  # noqa: E402


def test_pipeline(spark, tmp_path):
    from versotext.llm import language, sentencepiece_scan, toxicity

    r = random.Random(11)
    words = ["".join(r.choice("aeinrstlo") for _ in range(r.randint(2, 7))) for _ in range(700)]
    sentence = lambda n: " ".join(r.choice(words) for _ in range(n)) + "."
    items = [(i, sentence(20)) for i in range(6)]
    rows = [(i, sentence(60), "en", "s", 1) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " end", "en", "s", 1) for i in range(20)]  # near copies
    rows += [(300 + i, sentence(20) + " " + items[i][1] + " " + sentence(20), "en", "s", 1) for i in range(6)]  # leaks
    rows += [(400 + i, sentence(30) + " idiot scum " + sentence(8), "en", "s", 1) for i in range(60)]  # toxic
    rows += [(500, None, None, None, None), (501, "", "en", "s", 0), (502, "123 456", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, 1, int(400 <= i < 460)) for i in [*range(120), *range(400, 460)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    out = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    texts = {i: t for i, t, *_ in rows}
    left = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    model = toxicity.train(docs.where(docs.doc_id.isin(list(left))), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = {i: t for i, t in left.items() if model.score(set(toxicity.plain_words(t.encode()))) < 0.5}
    assert not any(400 <= i < 460 for i in left) and sum(i < 120 for i in left) == 120
    parts = brute_components(sorted(left.items()))
    left = {i: t for i, t in left.items() if parts[i] == i}
    left = {i: t for i, t in left.items() if not any(100 * len(shingles(t) & shingles(u)) >= 80 * len(shingles(u)) for _, u in items)}
    assert set(out) == set(left) == set(range(120))
    vocab = sentencepiece_scan.Vocabulary(PIECES)
    assert all(x["text"] == left[i] and x["ids"] == vocab.encode(left[i]).tolist() for i, x in out.items())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "jaccard_join", "decontamination", "sentencepiece"]
    assert language.keep_identified(docs, None).columns == docs.columns


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    items = [(1, "nine gentle birds watch from the old garden wall"), (2, None), (None, "the quick brown fox jumps over the lazy dog")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, i % 2) for i in range(1, 15)] + [(None, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, docs, no_docs, tables, name):
    """Nulls in any column, empty and long texts, repeated rows and ids, an extra column that clashes, and empty tables."""
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, tables)
    rows, kept = docs.collect(), out.collect()
    assert stage(spark, no_docs, tables).collect() == []
    ids = lambda found: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found)
    if name == "sentencepiece":
        assert ids(kept) == ids(rows) and sorted(r["text"] for r in kept) == sorted(r["text"] or "" for r in rows)
        return
    assert out.columns == docs.columns
    assert {tuple(r) for r in kept} <= {tuple(r) for r in rows}
    if name == "language_id":  # only texts that have letters may stay
        assert not {5, 6, 7, 12} & {r["doc_id"] for r in kept}
    if name == "toxicity":
        assert {5, 6} <= {r["doc_id"] for r in kept}
        none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
        from versotext.llm import toxicity

        assert ids(toxicity.keep_civil(docs, toxicity.train(docs, none)).collect()) == ids(rows)
    if name == "jaccard_join":
        assert ids(kept) == sorted([(True, 0)] + [(False, i) for i in (1, 4, 5, 6, 7, 8, 10, 11, 12, 13)])  # 14 repeats an id; one of its texts is near 1
    if name == "decontamination":  # "nine gentle birds ..." stands in 1, 2, 3 and in a row of 14
        assert ids(kept) == ids(r for r in rows if r["doc_id"] not in (1, 2, 3, 14))


def test_folders_of_stages_are_removed(spark, docs, tables, tmp_path):
    import os
    import shutil

    folder = f"{tmp_path}/sf"
    shutil.copytree(tables, folder)
    docs.write.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder)
    files = out.inputFiles()
    root = os.path.dirname(os.path.dirname(files[0].removeprefix("file:"))) if files else None
    assert out.count() >= 0 and (root is None or os.listdir(root) == ["sentencepiece"])
