"""Document quality from weak labels.

Several overlapping heuristics vote good, bad or abstain on every document. Their
accuracies are estimated by expectation-maximisation without any true label: a
document's class is hidden, and each heuristic that doesn't abstain has its own chance
of being right in each class. EM needs only how often each pattern of votes occurs, counted over all documents;
there are at most 3^(number of heuristics) patterns, whatever the corpus. The
posterior of each pattern (abstentions tell nothing) is the label on which a hashed linear scorer over byte
trigrams and a few style measures is trained, on a bounded sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versotext.llm.text import first_places, id_and_text, pieces, raw_texts, sample_place, sample_rates

GOOD, NONE, BAD = "+", "0", "-"
LABELLERS = ("symbols", "variety", "lines", "capitals", "word_length", "top_word", "endings", "marked_words", "tables")
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
CAPITALS = bytes(range(65, 91))
PLAIN = LETTERS + bytes(range(48, 58)) + b" \t\r\n.,;:'\"?!()-"
#: Runs of marks that no prose has.
MARKS = re.compile(rb"[#$%&*+/<=>@^_`{|}~]{2,}")
BITS = 16
STYLE = 7
SCALE = 20.0


def measure(raw: bytes) -> tuple[str, tuple[float, ...]]:
    """The heuristics' votes on a text, in the order of LABELLERS, and its style measures (0 to 1)."""
    words = raw.split()
    n = len(words)
    if not n:
        return BAD * len(LABELLERS), (0.0,) * STYLE
    size = len(raw)
    symbols = len(raw.translate(None, PLAIN)) / size
    letters = size - len(raw.translate(None, LETTERS))
    capitals = (size - len(raw.translate(None, CAPITALS))) / max(letters, 1)
    counts = Counter(words)
    variety = len(counts) / n
    top = counts.most_common(1)[0][1] / n
    lines = [x for x in (line.strip() for line in raw.split(b"\n")) if x]
    repeated = 1 - len(set(lines)) / max(len(lines), 1)
    ended = sum(x.endswith((b".", b"!", b"?", b":", b'"')) for x in lines) / max(len(lines), 1)
    mean = sum(map(len, words)) / n
    marked = len(MARKS.findall(raw)) / n
    bars = (raw.count(b"|") + raw.count(b"\t")) / n

    def vote(bad: bool, good: bool) -> str:
        return BAD if bad else GOOD if good else NONE

    expected = 1.0 if n < 30 else (30 / n) ** 0.35  # long texts repeat more words
    votes = (
        vote(symbols > 0.12, symbols < 0.02), vote(variety < 0.45 * expected, variety > 0.6 * expected), vote(repeated > 0.3 and len(lines) > 5, repeated < 0.1 and len(lines) > 2),
        vote(capitals > 0.3, 0.005 < capitals < 0.15), vote(mean < 2.5 or mean > 12, 3.5 < mean < 9), vote(top > 0.2 and n >= 10, top < 0.12 and n >= 30),
        vote(ended < 0.3 and n >= 20, ended > 0.8), vote(marked > 0.2, marked < 0.02 and n >= 10), vote(bars > 0.2, bars < 0.02 and n >= 30),
    )
    return "".join(votes), (min(symbols * 5, 1), variety, repeated, capitals, min(mean / 12, 1), top, min(bars, 1))


def em(patterns: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of good for each pattern, each heuristic's chances (heuristic, class, vote) and the share of good.

    Begins at the share of good among the votes that aren't abstentions, so class 1 stays the good one.
    """
    names = sorted(patterns)
    if not names:
        return {}, np.zeros((0, 2, 3)), 0.5
    v = np.array([["-0+".index(c) for c in name] for name in names])
    n = np.array([patterns[x] for x in names], dtype=np.float64)
    cast = (v != 1).sum(axis=1)
    p = np.clip(((v == 2).sum(axis=1) + 1) / (cast + 2), 0.05, 0.95)
    theta, prior = np.zeros((v.shape[1], 2, 3)), 0.5
    for _ in range(rounds):
        weight = np.stack((n * (1 - p), n * p))
        for j in range(v.shape[1]):
            for c in range(2):
                theta[j, c] = np.bincount(v[:, j], weights=weight[c], minlength=3) + 0.5
        theta[:, :, 1] = 0
        theta /= theta.sum(axis=2, keepdims=True)
        theta[:, :, 1] = 1  # an abstention is as likely in either class
        prior = float(np.clip(weight[1].sum() / n.sum(), 1e-3, 1 - 1e-3))
        odds = np.log(prior / (1 - prior)) + sum(np.log(theta[j, 1, v[:, j]] / theta[j, 0, v[:, j]]) for j in range(v.shape[1]))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - p).max() < 1e-7:
            p = new
            break
        p = new
    return dict(zip(names, p.tolist(), strict=True)), theta, prior


def _grams(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    return ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435769)) >> np.uint32(32 - BITS)


@dataclass
class Model:
    """A weight for each trigram bucket, one for each style measure, and a bias."""

    grams: np.ndarray
    style: np.ndarray
    bias: float

    def score(self, raw: bytes, style: tuple[float, ...]) -> float:
        g = _grams(raw)
        z = self.bias + float(self.style @ np.array(style)) + (SCALE * float(self.grams[g].mean()) if len(g) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[bytes], posterior: list[float], steps: int = 120, l2: float = 1e-4) -> Model:
    """Logistic regression on soft labels by full-batch Adam; both classes weigh the same."""
    if not texts:
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(STYLE), 0.0)
    y = np.array(posterior)
    style = np.array([measure(t)[1] for t in texts])
    cols, values, counts = [], [], []
    for t in texts:
        ids, tf = np.unique(_grams(t), return_counts=True)
        cols.append(ids.astype(np.int32))
        values.append((SCALE * tf / max(tf.sum(), 1)).astype(np.float32))
        counts.append(len(ids))
    col, val = np.concatenate(cols), np.concatenate(values)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    balance = y * (0.5 / max(y.mean(), 1e-3)) + (1 - y) * (0.5 / max(1 - y.mean(), 1e-3))
    balance /= balance.sum()
    w = np.zeros((1 << BITS) + STYLE + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=val * w[col], minlength=len(y)) + style @ w[1 << BITS : -1] + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        g = np.concatenate((np.bincount(col, weights=val * error[row], minlength=1 << BITS), style.T @ error, [error.sum()])) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(w[: 1 << BITS].astype(np.float32), w[1 << BITS : -1], float(w[-1]))


def classify_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1, higher is better), ``keep`` (score >= threshold), ``posterior`` and ``votes`` of every row.

    The scorer is fitted on at most ``sample`` rows of each likelier class, chosen by a hash of id and
    text, equal rows counted once; vote patterns are counted over all rows. Null and empty texts get the votes all bad and are scored like
    any other. A null id stays null; repeated rows get a row each; other columns are ignored.
    """
    own = id_and_text(docs, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in pieces(batches, "text"):
            seen.update(measure(raw or b"")[0] for raw in raw_texts(batch))
        yield pa.RecordBatch.from_pydict({"votes": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    counted = own.select("text").mapInArrow(count, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    patterns = {r["votes"]: r["n"] for r in counted}
    posterior, _, _ = em(patterns)
    classes = Counter()
    for votes, n in patterns.items():
        classes[posterior[votes] >= 0.5] += n

    # a class's rows are taken up to a place that its size sets, so few texts leave their tasks; the bound holds in the plan
    stops = sample_rates(classes, sample)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            p = [posterior[measure(raw or b"")[0]] for raw in raw_texts(batch)]
            taken = [place < stops[x >= 0.5] for x, place in zip(p, batch.column("place").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("text"), pa.array(p, pa.float64()), pa.array([x >= 0.5 for x in p], pa.bool_())], ["place", "text", "p", "good"]).filter(pa.array(taken, pa.bool_()))

    placed = own.where("text is not null").withColumn("place", sample_place()).where(F.col("place") < F.lit(max(stops.values(), default=0)))
    chosen = first_places(placed.mapInArrow(label, "place long, text string, p double, good boolean"), "good", sample)
    rows = sorted((r["good"], r["place"], r["text"].encode("utf-8", "replace"), r["p"]) for r in chosen.collect())
    model = fit([t for _, _, t, _ in rows], [p for *_, p in rows])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            scores, votes, chances = [], [], []
            for raw in raw_texts(batch):
                v, style = measure(raw or b"")
                scores.append(model.score(raw or b"", style))
                votes.append(v)
                chances.append(posterior.get(v, 0.5))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(chances, pa.float64()), pa.array(votes, pa.string())], ["doc_id", "score", "posterior", "votes"])

    scored = own.mapInArrow(score, "doc_id long, score double, posterior double, votes string")
    return scored.select("doc_id", "score", (F.col("score") >= threshold).alias("keep"), "posterior", "votes")
