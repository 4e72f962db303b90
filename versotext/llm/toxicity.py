"""Toxicity scores from a counterfactually regularised classifier.

Logistic regression on the words that stand in a text and on how they begin
(4 to 7 bytes), which catches inflected forms. Of each labelled text that names a
group, copies are made in which each group term is swapped for another one of the
same kind, number and language, and one in which the terms are taken out. The squared
change of the linear score from the text to its copies is a penalty of the fit, so what
a text says about a group weighs, not which group it is or that one is named: neutral
mentions stay neutral even if group terms stand more often in toxic rows.

The classifier is fitted on a bounded sample of labelled rows (``per_label`` of
each label); scoring runs over all rows and whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versotext.llm.text import bounded_sample, first_places, id_and_text, pieces, plain_words, raw_texts, remainder, sample_place

#: Group terms that may be swapped for one another; a line for each language, kind and number.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "females", "males", "lesbians", "gays", "queers", "transgenders"),
    ("woman", "man", "girl", "boy", "female", "male", "lesbian", "gay", "queer", "transgender", "nonbinary", "bisexual", "heterosexual", "homosexual"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs", "mormons"),
    ("christian", "muslim", "jew", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh", "mormon"),
    ("blacks", "whites", "asians", "latinos", "africans", "arabs", "europeans", "natives", "immigrants", "refugees"),
    ("black", "white", "asian", "latino", "african", "arab", "european", "indigenous", "roma", "immigrant", "refugee"),
    ("americans", "mexicans", "germans", "russians", "indians", "turks", "poles", "italians", "canadians", "israelis"),
    ("american", "mexican", "chinese", "german", "french", "spanish", "russian", "indian", "turkish", "polish", "italian", "japanese"),
    ("deaf", "blind", "disabled", "autistic"),
    ("elderly", "teenagers", "seniors", "pensioners"),
    ("frauen", "männer", "mädchen", "jungen", "lesben", "schwule"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "araber", "europäer", "einwanderer", "flüchtlinge"),
    ("amerikaner", "mexikaner", "chinesen", "deutsche", "franzosen", "spanier", "russen", "türken", "polen"),
    ("femmes", "hommes", "filles", "garçons", "lesbiennes", "homosexuels"),
    ("femme", "homme", "fille", "garçon", "lesbienne", "homosexuel"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("noirs", "blancs", "asiatiques", "africains", "arabes", "européens", "immigrés", "réfugiés"),
    ("américains", "mexicains", "chinois", "allemands", "français", "espagnols", "russes", "turcs", "polonais"),
    ("mujeres", "hombres", "niñas", "niños", "lesbianas", "homosexuales"),
    ("mujer", "hombre", "niña", "niño", "lesbiana", "homosexual"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("negros", "blancos", "asiáticos", "africanos", "árabes", "europeos", "inmigrantes", "refugiados"),
    ("americanos", "mexicanos", "chinos", "alemanes", "franceses", "españoles", "rusos", "turcos", "polacos"),
)

#: Where each term stands: the first line that holds it.
LINE = {t.encode(): line for line, terms in reversed(list(enumerate(IDENTITY_TERMS))) for t in terms}
TERMS = frozenset(LINE)

#: How many first bytes of a longer word are a feature besides the word.
BEGINNINGS = (4, 5, 6, 7)


def features(words: set[bytes]) -> set[bytes]:
    """The words, and the beginnings of longer words but group terms, marked by a star."""
    plain = words - TERMS
    return words.union(*({w[:n] + b"*" for w in plain if len(w) > n} for n in BEGINNINGS))


class Model:
    """A weight for each word and, by length, for each beginning of a word."""

    def __init__(self, weights: dict[bytes, float], bias: float, blank: bool = False):
        self.bias, self.blank = bias, blank
        self.words = {w: v for w, v in weights.items() if not w.endswith(b"*")}
        self.begin = [(n, own) for n in BEGINNINGS if (own := {w[:-1]: v for w, v in weights.items() if w.endswith(b"*") and len(w) == n + 1})]

    def score(self, words: set[bytes]) -> float:
        z = self.bias + sum(self.words[w] for w in self.words.keys() & words)
        plain = words - TERMS
        for n, own in self.begin:
            z += sum(own[w] for w in own.keys() & {w[:n] for w in plain if len(w) > n})
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def swapped_copies(words: set[bytes], copies: int) -> list[set[bytes]]:
    """The text's words with each group term swapped for the next, next but one, ... of its line, and with all of them taken out.

    A swap for every other term of the longest line, ``copies`` at most.
    """
    named = sorted(words & TERMS)
    if not named:
        return []
    rest = words - TERMS
    out = [rest]
    lines = [[t.encode() for t in IDENTITY_TERMS[LINE[w]]] for w in named]
    for step in range(1, min(copies + 1, max(map(len, lines)))):
        other = {own[(own.index(w) + step) % len(own)] for w, own in zip(named, lines, strict=True)}
        if other != set(named):
            out.append(rest | other)
    return out


def fit(texts: list[bytes], labels: list[int], max_features: int = 1 << 17, steps: int = 300, l1: float = 6e-4, l2: float = 1e-4, swap: float = 1.0, copies: int = 12) -> Model:
    """Proximal full-batch Adam on logistic loss, elastic net and the swap penalty.

    The penalty is ``swap`` times the mean squared change of the linear score from the texts that
    name a group to their copies. Without rows of both labels the score is the share of label 1 (0.5 without rows).
    """
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Model({}, float(np.log(p / (1 - p))), blank=not len(y))
    # every feature is kept once; a text is the numbers of its features
    number: dict[bytes, int] = {}
    rows, changes = [], []
    for t in texts:
        words = set(plain_words(t))
        own = features(words)
        rows.append(np.fromiter((number.setdefault(f, len(number)) for f in own), dtype=np.int32))
        for copy in swapped_copies(words, copies):
            other = features(copy)
            changes.append([(number.setdefault(f, len(number)), 1.0) for f in other - own] + [(number.setdefault(f, len(number)), -1.0) for f in own - other])
    lengths = np.array([len(r) for r in rows])
    col = np.concatenate(rows)
    frequency = np.bincount(col, minlength=len(number))
    least = 2 if len(rows) < 2000 else 4
    keep = frequency >= least
    keep[[number[t] for t in TERMS if t in number and frequency[number[t]]]] = True
    names = np.array(list(number), dtype=object)
    chosen = np.flatnonzero(keep)
    chosen = chosen[np.lexsort((names[chosen], -frequency[chosen]))][:max_features]
    vocabulary = names[chosen].tolist()
    del number, names
    new = np.full(len(keep), -1, dtype=np.int32)
    new[chosen] = np.arange(len(chosen))
    row = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
    col = new[col]
    row, col = row[col >= 0], col[col >= 0]
    # by copy: which features come (1) and go (-1); those that no text holds weigh nothing
    copy_of = np.repeat(np.arange(len(changes)), [len(c) for c in changes]).astype(np.int64)
    copy_col = new[np.array([i for c in changes for i, _ in c], dtype=np.int64)]
    sign = np.array([v for c in changes for _, v in c])
    copy_of, copy_col, sign = copy_of[copy_col >= 0], copy_col[copy_col >= 0], sign[copy_col >= 0]

    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) ** 0.5
    balance /= balance.sum()
    w, bias = np.zeros(len(vocabulary)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        z = bias + np.bincount(row, weights=w[col], minlength=len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        g = np.bincount(col, weights=error[row], minlength=len(w)) + l2 * w
        if len(copy_col):
            change = np.bincount(copy_of, weights=sign * w[copy_col], minlength=len(changes))
            g += np.bincount(copy_col, weights=sign * change[copy_of], minlength=len(w)) * (2 * swap / len(changes))
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 * min(1.0, 3 * (1 - step / (steps + 1)))
        scale = np.sqrt(v / (1 - 0.999**step)) + 1e-8
        w = w - rate * (m / (1 - 0.9**step)) / scale
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1 / scale, 0.0)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return Model({vocabulary[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-4)}, float(bias))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 5, held: int = 0, per_label: int = 2500) -> Model:
    """Fit on at most ``per_label`` rows of each label, chosen by a hash of the id, none of those whose crc32(id) modulo ``modulus`` is ``held``.

    Null labels and ids are left out; a document with several labels counts as 1 if one is 1.
    """
    rows = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    rows = rows.where("doc_id is not null and y in (0, 1)").where(remainder(F.col("doc_id"), modulus) != held).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen, _ = bounded_sample(rows.withColumn("text", F.lit("")), "y", per_label)
    # at most per_label rows of each label, of two integers: small whatever the size of the corpus
    own = id_and_text(docs, id_col, text_col).where("text is not null").join(F.broadcast(chosen.select("doc_id", "y")), "doc_id")
    # an id may stand in many rows of documents: the bound holds again for its texts
    sample = first_places(own.select("y", "text", sample_place().alias("place")), "y", per_label)
    kept = sorted((r["y"], r["place"], r["text"].encode("utf-8", "replace")) for r in sample.collect())
    return fit([t for *_, t in kept], [y for y, *_ in kept])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` (0 to 1) of every row's whole text; null and empty texts get the bias alone.

    A null id stays null; repeated rows get a row each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            scores = [model.score(set(plain_words(raw)) if raw else set()) for raw in raw_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_civil(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, all columns kept, whose text scores below ``threshold``; null and empty texts stay.

    A model that learned from no label says nothing of any text: all rows stay.
    """
    if model.blank:
        return docs
    names = docs.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces([batch.rename_columns([str(i) for i in range(len(names))])], str(place)):
                kept = [not raw or model.score(set(plain_words(raw))) < threshold for raw in raw_texts(part, str(place))]
                yield part.filter(pa.array(kept, pa.bool_())).rename_columns(names)

    return docs.mapInArrow(run, docs.schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 5, held: int = 0, per_label: int = 2500, threshold: float = 0.5) -> DataFrame:
    """Train on the labelled rows that aren't held out, then score all rows: doc_id, held_out, score, predicted."""
    model = train(docs, labels, id_col, text_col, label_col, modulus, held, per_label)
    return score(docs, model, id_col, text_col).select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
