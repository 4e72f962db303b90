"""Language identification.

Sparse multinomial logistic regression on TF-IDF weights of character n-grams
(1 to 3 characters, hashed), trained with follow-the-regularised-leader and
elastic-net penalties; a temperature fitted on held-back rows calibrates the
probabilities.

The classifier is fitted on a bounded sample of labelled rows (``per_language`` rows
of each language); its inverse document frequencies are counted over all of them.
Prediction runs over all rows and whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versotext.llm.text import bounded_sample, has_letter, id_and_text, pieces, raw_texts, remainder

BITS = 15
BUCKETS = 3 << BITS
#: Counts of all buckets are added up in parts of so many buckets.
PART = 1024
#: TF-IDF vectors are divided by their sum; this factor brings weights to a usual range.
SCALE = 40.0


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts one after another, and where each text begins and ends."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum([len(t) for t in lowered])
    return codes, np.concatenate(([0], ends[:-1])).astype(np.int64), ends.astype(np.int64)


def _grams(codes: np.ndarray) -> list[np.ndarray]:
    """For each length 1, 2, 3 the bucket of the n-gram that begins at each place."""
    c = codes.astype(np.uint64)
    out = [(c * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int32)]
    mixed = c
    for n in (2, 3):
        mixed = mixed[:-1] * np.uint64(0x100000001B3) + c[n - 1 :]
        out.append(((mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int32)) + np.int32((n - 1) << BITS))
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # for each bucket: idf times each language's weight, and idf itself
    bias: np.ndarray
    temperature: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """A row of calibrated probabilities for each text; texts without n-grams get the bias alone."""
        codes, begins, ends = _codes(texts)
        total = np.zeros((len(texts), len(self.languages) + 1))
        for n, grams in enumerate(_grams(codes), 1):
            if not len(grams):
                continue
            # running sums over blocks keep memory flat; n-grams across two texts are left out by their ends
            stops = np.maximum(ends - (n - 1), begins)
            for i, (b, e) in enumerate(zip(begins, stops, strict=True)):
                if e > b:
                    total[i] += self.table[grams[b:e]].sum(axis=0, dtype=np.float64)
        z = SCALE * total[:, :-1] / np.maximum(total[:, -1:], 1e-12) + self.bias
        return _softmax(z / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    codes, begins, ends = _codes(texts)
    grams = _grams(codes)
    out = []
    for b, e in zip(begins, ends, strict=True):
        own = np.concatenate([g[b : max(b, e - n)] for n, g in enumerate(grams)]) if e > b else np.zeros(0, np.int32)
        ids, tf = np.unique(own, return_counts=True)
        out.append((ids, tf.astype(np.float32)))
    return out


def fit(texts: list[str], languages: list[str], epochs: int = 2, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 7, corpus: tuple[np.ndarray, int] | None = None) -> Model | None:
    """FTRL-proximal on the rows; every fifth row is held back for the temperature. None without rows.

    ``corpus`` has the document frequency of each bucket and the number of documents counted; without it the rows are counted.
    """
    names = sorted(set(languages))
    if not names:
        return None
    rows = [f for i in range(0, len(texts), 200) for f in _features(texts[i : i + 200])]
    document_frequency, documents = corpus or (np.zeros(BUCKETS), len(texts))
    if corpus is None:
        for ids, _ in rows:
            document_frequency[ids] += 1
    idf = np.log((1 + documents) / (1 + document_frequency)) + 1
    x = []
    for ids, tf in rows:
        w = tf * idf[ids]
        x.append((ids, (SCALE * w / w.sum() if len(ids) else w).astype(np.float32)))
    del rows
    y = np.array([names.index(v) for v in languages])
    order = np.random.default_rng(seed).permutation(len(x))
    held, used = (order[::5], np.delete(order, np.s_[::5])) if len(x) >= 50 else (order, order)
    k = len(names)
    zs, ns = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Closed form of the leader: elastic net, so small sums give zero."""
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    def bias_of() -> np.ndarray:
        return -zb / ((beta + np.sqrt(nb)) / alpha + l2)

    for _ in range(epochs):
        for i in used:
            ids, v = x[i]
            z, n = zs[ids], ns[ids]
            w, wb = weights(z, n), bias_of()
            p = _softmax((v @ w + wb)[None])[0]
            p[y[i]] -= 1
            g = v[:, None] * p[None]
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / alpha
            zs[ids] = z + g - sigma * w
            ns[ids] = n + g * g
            sb = (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha
            zb += p - sb * wb
            nb += p * p
    w, bias = weights(zs, ns), bias_of()
    z = np.array([v @ w[ids] + bias for ids, v in (x[i] for i in held)])
    best = min((0.25 * 1.12**t for t in range(40)), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean())
    return Model(names, np.hstack([w * idf[:, None], idf[:, None]]).astype(np.float32), bias, best)


def _document_frequency(rows: DataFrame) -> np.ndarray:
    """In how many of the rows the n-grams of each bucket stand; each task counts its own rows, in vectors of fixed length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, own = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, bool)
        for batch in pieces(batches, "text", 2_000_000):
            codes, begins, ends = _codes([raw.decode("utf-8", "replace") if raw else "" for raw in raw_texts(batch)])
            grams = _grams(codes)
            for b, e in zip(begins, ends, strict=True):
                for n, g in enumerate(grams):
                    own[g[b : max(b, e - n)]] = True
                ids = np.flatnonzero(own)
                seen[ids] += 1
                own[ids] = False
        parts = [(i, part.tobytes()) for i, part in enumerate(seen.reshape(-1, PART)) if part.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["part", "n"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(n, np.int64) for n in group.column("n").to_pylist())
        return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "n": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((BUCKETS // PART, PART))
    for r in rows.select("text").mapInArrow(count, "part int, n binary").groupBy("part").applyInArrow(add, "part int, n binary").collect():
        out[r["part"]] = np.frombuffer(r["n"], np.int64)
    return out.reshape(-1)


def train(docs: DataFrame, eligible: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1000) -> Model | None:
    """Fit on at most ``per_language`` rows of each language among the rows where ``eligible`` holds.

    The rows are chosen by a hash of id and text, equal rows counted once; the bound holds in the plan.
    Document frequencies are counted over all rows where ``eligible`` holds.
    """
    rows = docs.where(eligible).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("text is not null and lang is not null")
    chosen, counts = bounded_sample(rows, "lang", per_language)
    pairs = sorted((r["lang"], r["place"], r["text"]) for r in chosen.select("lang", "place", "text").collect())
    return fit([t for _, _, t in pairs], [lang for lang, _, _ in pairs], corpus=(_document_frequency(rows), sum(counts.values()))) if pairs else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``lang_pred`` and the calibrated probability ``score`` of every row's whole text.

    A text that is null or has no letters gets ``und`` and score 0, as does every row
    when nothing could be learned. Equal probabilities go to the first language by
    name. A null id stays null; repeated rows get a row each; other columns are ignored.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(_predictor(model), "doc_id long, lang_pred string, score double")


def _predictor(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2_000_000):
            texts = [raw.decode("utf-8", "replace") if raw else "" for raw in raw_texts(batch)]
            lettered = np.array([has_letter(t) for t in texts])
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            if model is not None and lettered.any():
                p = model.probabilities(texts)
                best = p.argmax(axis=1)
                for i in np.flatnonzero(lettered):
                    names[i], scores[i] = model.languages[best[i]], p[i, best[i]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return run


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, all columns kept, whose text has letters and a language with probability ``least`` or more.

    Without a model every text with letters stays.
    """
    names = docs.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces([batch.rename_columns([str(i) for i in range(len(names))])], str(place), 2_000_000):
                texts = [raw.decode("utf-8", "replace") if raw else "" for raw in raw_texts(part, str(place))]
                kept = np.array([has_letter(t) for t in texts])
                if model is not None and kept.any():
                    kept &= model.probabilities(texts).max(axis=1) >= least
                yield part.filter(pa.array(kept)).rename_columns(names)

    return docs.mapInArrow(run, docs.schema)


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 3, held: int = 1, per_language: int = 1000) -> DataFrame:
    """Train on the rows whose crc32(id) modulo ``modulus`` isn't ``held`` and predict all rows.

    Adds ``held_out`` to the columns of :func:`predict`.
    """
    model = train(docs, remainder(F.col(f"`{id_col}`"), modulus) != held, id_col, text_col, lang_col, per_language)
    return predict(docs, model, id_col, text_col).select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "lang_pred", "score")
