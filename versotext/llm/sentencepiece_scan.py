"""SentencePiece encoding and decoding by a max-plus parallel scan.

The best segmentation of a text into pieces is the best path through its
characters: an edge for each piece of the vocabulary, worth the piece's score, and
for a character that is no piece by itself an edge worth less than any piece,
written as byte pieces. A document longer than ``giant`` characters is cut into
chunks. A chunk gives a transfer matrix in max-plus algebra: entry i, j is the best
score from a boundary i characters after its begin to a boundary j characters
after its end, i and j below the length of the longest piece. Blocks of matrices
are combined associatively, each in a task of its own; a scan over the blocks'
products gives the scores at each block's begin, one inside each block those at each
chunk's begin. Each chunk then tells which entry leads to each exit, these maps are
composed from the right, and every chunk is traced back by itself.

Scores are whole numbers (fixed point), so chunked and unchunked paths agree
exactly. Where two paths are worth the same, the longer last piece wins. Pieces
never reach over a space, so ordinary documents are encoded word by word with
the same path search and a memory for words.

The model file gives pieces and scores; they are read as a unigram model's.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versotext.llm.text import gather, id_and_text, pieces, raw_texts, shared_checkpoint

SPACE = "▁"
NEVER = -(1 << 62)
FIXED = 1 << 16


class Vocabulary:
    """Pieces with whole-number scores; every beginning of a piece is a key, with id -1 if it's no piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = {}
        self.table: dict[str, tuple[int, int]] = {}
        scores = []
        for i, name in enumerate(self.names):
            if model.is_byte(i):
                self.bytes[int(name[3:5], 16)] = i
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                score = max(round(model.get_score(i) * FIXED), -(1 << 42))
                self.table[name] = (i, score)
                scores.append(score)
        self.unknown_id = model.unk_id()
        self.unknown = min((s for s in scores if s > -(1 << 42)), default=0) - 10 * FIXED
        self.longest = max(map(len, self.table), default=1)
        for name in list(self.table):
            for n in range(1, len(name)):
                self.table.setdefault(name[:n], (-1, 0))
        # the same beginnings as a tree: id, score and what goes on, by the next character
        self.tree: dict[str, tuple[int, int, dict]] = {}
        for name in sorted(self.table):
            level = self.tree
            for c in name[:-1]:
                level = level[c][2]
            level[name[-1]] = (*self.table[name], {})
        # two characters that no piece holds side by side are always parted
        self.joined = {n[k : k + 2] for n, (i, _) in self.table.items() if i >= 0 for k in range(len(n) - 1)}
        # a word may be encoded apart if no piece goes on after a space
        self.by_word = not any(SPACE in n.lstrip(SPACE) for n, (i, _) in self.table.items() if i >= 0)
        self.byte_of = np.full(len(self.names), -1, dtype=np.int16)
        for b, i in self.bytes.items():
            self.byte_of[i] = b
        self.surface = [SPACE + "⁇" + SPACE if i == self.unknown_id else "" if model.is_control(i) else n for i, n in enumerate(self.names)]
        self.memory = Words(self)
        self.singles: dict[str, bytes] = {}

    def search(self, text: str, n: int, entry: list[int]) -> tuple[list[int], list[int], list[int]]:
        """Best scores at the places of ``text``, and each place's last piece: its length (0: entry) and id.

        Pieces begin at the first ``n`` places only. Id -1 - c stands for the unknown character c.
        """
        size = len(text)
        best = entry[: size + 1] + [NEVER] * (size + 1 - len(entry))
        back, ids = [0] * (size + 1), [0] * (size + 1)
        first, unknown = self.tree.get, self.unknown
        for p in range(n):
            here = best[p]
            if here == NEVER:
                continue
            e = p + 1
            found = first(text[p])
            if found is None or found[0] < 0:
                # no piece by itself
                if here + unknown > best[e]:
                    best[e], back[e], ids[e] = here + unknown, 1, -1 - ord(text[p])
            while found is not None:
                i, score, following = found
                if i >= 0 and here + score > best[e]:
                    best[e], back[e], ids[e] = here + score, e - p, i
                if e == size:
                    break
                found = following.get(text[e])
                e += 1
        return best, back, ids

    def trace(self, back, ids, end: int) -> tuple[list[int], int]:
        """The ids of the path that ends at ``end``, and the entry where it began."""
        out = []
        while back[end]:
            i = int(ids[end])
            if i >= 0:
                out.append(i)
            else:
                raw = chr(-1 - i).encode("utf-8", "surrogatepass")
                out += [self.bytes.get(b, self.unknown_id) for b in reversed(raw)] if self.bytes else [self.unknown_id]
            end -= int(back[end])
        out.reverse()
        return out, end

    def word(self, text: str) -> list[int]:
        _, back, ids = self.search(text, len(text), [0])
        return self.trace(back, ids, len(text))[0]

    def lone(self, char: str) -> bytes:
        """Ids of a character by itself, as bytes."""
        if char not in self.singles:
            self.singles[char] = np.array(self.word(char), dtype=np.int32).tobytes()
        return self.singles[char]

    def matrix(self, text: str, n: int) -> np.ndarray:
        """The transfer matrix of a chunk with ``n`` places where pieces begin; ``text`` reaches beyond it."""
        k = self.longest
        size = len(text)
        # up to the first place that no piece reaches over, a score for each entry; after it, one score for all
        best = np.full((min(n, size) + k + 1, k), NEVER, dtype=np.int64)
        best[np.arange(k), np.arange(k)] = 0
        reach, p = 0, 0
        while p < n and not (p >= k - 1 and reach <= p):
            here = best[p]
            alive = here > NEVER // 2
            single = False
            for e in range(p + 1, min(p + k, size) + 1):
                found = self.table.get(text[p:e])
                if found is None:
                    break
                i, score = found
                if i >= 0:
                    single = single or e == p + 1
                    np.maximum(best[e], np.where(alive, here + score, NEVER), out=best[e])
                    reach = max(reach, e)
            if not single:
                np.maximum(best[p + 1], np.where(alive, here + self.unknown, NEVER), out=best[p + 1])
                reach = max(reach, p + 1)
            p += 1
        out = np.full((k, k), NEVER, dtype=np.int64)
        if p == n:
            stops = best[n : n + k]
            out[:, : len(stops)] = stops.T
            return out
        rest, _, _ = self.search(text[p:], n - p, [0])
        stops = np.array(rest[n - p : n - p + k], dtype=np.int64)
        both = best[p][:, None] + stops[None]
        out[:, : len(stops)] = np.where((best[p][:, None] > NEVER // 2) & (stops[None] > NEVER // 2), both, NEVER)
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, unchunked."""
        if not text:
            return np.zeros(0, np.int32)
        if not self.by_word:
            return np.array(self.word(SPACE + text.replace(" ", SPACE)), dtype=np.int32)
        text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " ":
            units = re.findall(" +[^ ]*", " " + text)
        else:
            units = [" " + w for w in text.split(" ")]
        return np.frombuffer(b"".join(map(self.memory.__getitem__, units)), dtype=np.int32)

    def encode_all(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text of a batch; the distinct words are looked up once."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.or_(pc.match_substring(texts, SPACE), pc.equal(texts, "")))
        if not self.by_word or pc.any(odd).as_py():
            return _lists([self.encode(t) for t in texts.to_pylist()])
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        known = [self.memory[" " + w] for w in coded.dictionary.to_pylist()]
        starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, known), np.int64, len(known)) // 4)))
        at = np.asarray(coded.indices).astype(np.int64)
        offsets = np.asarray(split.offsets).astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(starts[at + 1] - starts[at])))[offsets - offsets[0]]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(gather(np.frombuffer(b"".join(known), np.int32), starts, at)))

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        known = self.byte_of[ids]
        out, names = [], self.surface
        if (known < 0).all():
            out = [names[i] for i in ids]
        else:
            edges = np.flatnonzero(np.diff((known >= 0).astype(np.int8))) + 1
            for b, e in zip((0, *edges), (*edges, len(ids)), strict=True):
                out.append(known[b:e].astype(np.uint8).tobytes().decode("utf-8", "replace") if known[b] >= 0 else "".join([names[i] for i in ids[b:e]]))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


class Words(dict):
    """Ids of words as bytes; forgets all when it holds about ``FULL`` bytes, and keeps no word longer than ``LONGEST``."""

    FULL = 96 << 20
    LONGEST = 64

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.held = 0

    def __missing__(self, word: str) -> bytes:
        v = self.vocabulary
        text = word.replace(" ", SPACE)
        # no piece goes over the place between two characters that none holds side by side: the marks
        # at the end that no piece joins with what is before them are words by themselves
        end = len(text)
        while end > 2 and text[end - 2 : end] not in v.joined:
            end -= 1
        if end < len(text):
            head = self[word[:end]] if end <= self.LONGEST else self.ids(text[:end])
            found = head + b"".join(map(v.lone, text[end:]))
        else:
            found = self.ids(text)
        if len(word) <= self.LONGEST:
            self.held += 4 * len(word) + len(found) + 200
            if self.held > self.FULL:
                self.clear()
                self.held = 0
            self[word] = found
        return found

    def ids(self, text: str) -> bytes:
        return array("i", self.vocabulary.word(text)).tobytes()


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The worker's vocabulary, kept with its memory from task to task."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of a vector or matrix with a matrix."""
    out = (a[..., :, None] + b).max(axis=-2)
    return np.where(out > NEVER // 2, out, NEVER)


def shifted(m: np.ndarray) -> np.ndarray:
    """Scores with the best as 0, which changes no comparison and keeps numbers small."""
    top = m.max()
    return np.where(m > NEVER // 2, m - top, NEVER) if top > NEVER // 2 else m


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The matrix of several chunks in a row, combined in a tree."""
    while len(matrices) > 1:
        matrices = [shifted(plus(matrices[i], matrices[i + 1])) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def start_of(longest: int) -> np.ndarray:
    """Best scores at the begin of a text."""
    first = np.full(longest, NEVER, dtype=np.int64)
    first[0] = 0
    return first


def entries(matrices: list[np.ndarray], first: np.ndarray) -> list[np.ndarray]:
    """Best scores at the begin of each chunk, those at the begin of the first given."""
    out = [first]
    for m in matrices[:-1]:
        out.append(shifted(plus(out[-1], m)))
    return out


def _chunked(text: str, size: int, longest: int) -> list[tuple[str, int]]:
    """(chunk and what pieces may reach beyond it, number of its own places)."""
    normal = SPACE + text.replace(" ", SPACE)
    size = max(size, longest)
    n = max(1, len(normal) // size)
    starts = [i * size for i in range(n)] + [len(normal)]
    return [(normal[b : e + longest - 1], e - b) for b, e in zip(starts, starts[1:], strict=False)]


def encode_scan(vocab: Vocabulary, text: str, chunk: int, block: int = 64) -> np.ndarray:
    """Ids of one text by the chunked scan, in one process: what the distributed plan does step by step."""
    if not text:
        return np.zeros(0, np.int32)
    parts = _chunked(text, chunk, vocab.longest)
    matrices = [vocab.matrix(t, n) for t, n in parts]
    blocks = [matrices[b : b + block] for b in range(0, len(matrices), block)]
    begins = entries([product(own) for own in blocks], start_of(vocab.longest))
    at = [v for own, first in zip(blocks, begins, strict=True) for v in entries(own, first)]
    found = [vocab.search(t, n, at[c].tolist()) for c, (t, n) in enumerate(parts)]
    end, out = 0, []
    for (_, n), (_, back, ids) in zip(reversed(parts), reversed(found), strict=True):
        own, end = vocab.trace(back, ids, n + end)
        out.append(own)
    return np.array([i for own in reversed(out) for i in own], dtype=np.int32)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], pa.int32()))


ENCODED = "doc_id long, ids array<int>"


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", giant: int = 100_000, chunk: int = 16_384, block: int = 64, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = ENCODED) -> DataFrame:
    """``doc_id`` and ``ids`` (array<int>) of every row's whole text.

    ``model`` is the model file's path on every machine. Null and empty texts have no
    ids; a null id stays null; repeated rows get a row each; other columns are ignored.
    ``finish`` turns batches of these columns into batches of ``schema`` where they are made.
    """
    own = id_and_text(docs, id_col, text_col)

    def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in pieces(batches, "text", 4_000_000):
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), vocab.encode_all(batch.column("text"))], ["doc_id", "ids"])
            yield out if finish is None else finish(out)

    small = own.where(f"text is null or length(text) <= {int(giant)}").mapInArrow(ordinary, schema)
    large = _encode_giant(own.where(f"length(text) > {int(giant)}"), model, chunk, block)
    return small.unionByName(large if finish is None else large.mapInArrow(lambda batches: map(finish, batches), schema))


def _encode_giant(docs: DataFrame, model: str, chunk: int, block: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = vocabulary(model).longest
        for batch in batches:
            for uid, doc_id, raw in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id")), raw_texts(batch), strict=True):
                parts = _chunked(raw.decode("utf-8", "replace"), chunk, longest)
                yield pa.RecordBatch.from_pydict({"uid": pa.array([uid] * len(parts), pa.int64()), "doc_id": pa.array([doc_id] * len(parts), pa.int64()), "c": pa.array(range(len(parts)), pa.int32()), "part": pa.array([t for t, _ in parts]), "n": pa.array([n for _, n in parts], pa.int32())})

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            found = [vocab.matrix(t, n).tobytes() for t, n in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("c"), pa.array(found, pa.binary())], ["uid", "c", "matrix"])

    def opened(group: pa.Table) -> list[np.ndarray]:
        k = vocabulary(model).longest
        return [np.frombuffer(m, np.int64).reshape(k, k) for m in group["matrix"].to_pylist()]

    def combine(group: pa.Table) -> pa.Table:
        group = group.sort_by("c")
        return pa.table({"uid": group["uid"][:1], "block": group["block"][:1], "matrix": pa.array([product(opened(group)).tobytes()], pa.binary())})

    def scan(group: pa.Table) -> pa.Table:
        """Of one document's blocks: the scores at the begin of each."""
        group = group.sort_by("block")
        at = entries(opened(group), start_of(vocabulary(model).longest))
        return pa.table({"uid": group["uid"], "block": group["block"], "first": pa.array([v.tobytes() for v in at], pa.binary())})

    def within(group: pa.Table) -> pa.Table:
        group = group.sort_by("c")
        at = entries(opened(group), np.frombuffer(group["first"][0].as_py(), np.int64))
        return pa.table({"uid": group["uid"], "c": group["c"], "entry": pa.array([v.tobytes() for v in at], pa.binary())})

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            backs, idss, leads = [], [], []
            for text, n, entry in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "entry")), strict=True):
                best, back, ids = vocab.search(text, n, np.frombuffer(entry, np.int64).tolist())
                leads.append([vocab.trace(back, ids, n + j)[1] if n + j < len(best) and best[n + j] > NEVER // 2 else -1 for j in range(vocab.longest)])
                backs.append(np.array(back, dtype=np.int32).tobytes())
                idss.append(np.array(ids, dtype=np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "doc_id", "c", "n")), pa.array(leads, pa.list_(pa.int32())), pa.array(backs, pa.binary()), pa.array(idss, pa.binary())], ["uid", "doc_id", "c", "n", "leads", "back", "ids"])

    def exits(group: pa.Table) -> pa.Table:
        group = group.sort_by([("c", "descending")])
        end, out = 0, []
        for lead in group["leads"].to_pylist():
            out.append(end)
            end = lead[end]
        return pa.table({"uid": group["uid"], "c": group["c"], "exit": pa.array(out, pa.int32())})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            ids = [np.array(vocab.trace(np.frombuffer(b, np.int32), np.frombuffer(i, np.int32), n + e)[0], dtype=np.int32) for b, i, n, e in zip(*(batch.column(c).to_pylist() for c in ("back", "ids", "n", "exit")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), batch.column("c"), _lists(ids)], ["uid", "doc_id", "c", "ids"])

    chunks = docs.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(cut, "uid long, doc_id long, c int, part string, n int")
    # one document's chunks go to many tasks
    chunks = shared_checkpoint(chunks.repartition(F.xxhash64("uid", "c")))
    made = chunks.select("uid", "c", "part", "n").mapInArrow(matrices, "uid long, c int, matrix binary").withColumn("block", F.floor(F.col("c") / block).cast("int"))
    made = shared_checkpoint(made)
    # blocks of matrices are combined in tasks of their own; only a product for each block meets in a document's task
    begins = made.groupBy("uid", "block").applyInArrow(combine, "uid long, block int, matrix binary").groupBy("uid").applyInArrow(scan, "uid long, block int, first binary")
    at = made.join(begins, ["uid", "block"]).groupBy("uid", "block").applyInArrow(within, "uid long, c int, entry binary")
    found = shared_checkpoint(chunks.join(at, ["uid", "c"]).mapInArrow(forward, "uid long, doc_id long, c int, n int, leads array<int>, back binary, ids binary"))
    ends = found.select("uid", "c", "leads").groupBy("uid").applyInArrow(exits, "uid long, c int, exit int")
    traced = found.drop("leads").join(ends, ["uid", "c"]).mapInArrow(trace, "uid long, doc_id long, c int, ids array<int>")
    whole = traced.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("c", "ids"))).alias("parts"))
    return whole.select("doc_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``text`` of every row's ids; null ids give an empty text. Byte pieces that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            ids = batch.column("ids")
            ends, flat = np.asarray(ids.offsets), np.asarray(ids.values)
            texts = [vocab.decode(flat[b:e]) for b, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    own = encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>")).alias("ids"))
    return own.mapInArrow(run, "doc_id long, text string")


def encode_with_text(docs: DataFrame, model: str, **options) -> DataFrame:
    """``doc_id``, ``ids``, ``n_pieces`` and the ``text`` decoded from the ids."""

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocab, ids = vocabulary(model), batch.column("ids")
        ends, flat = np.asarray(ids.offsets), np.asarray(ids.values)
        texts = [vocab.decode(flat[b:e]) for b, e in zip(ends[:-1], ends[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(np.diff(ends), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "ids", "n_pieces", "text"])

    return encode(docs, model, finish=finish, schema="doc_id long, ids array<int>, n_pieces long, text string", **options)


def encode_digest(docs: DataFrame, model: str, **options) -> DataFrame:
    """Of each row: n_pieces, ids_crc32 (ids as little-endian 32-bit integers), and the decoded text's n_chars and text_crc32."""

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocab, ids = vocabulary(model), batch.column("ids")
        ends, flat = np.asarray(ids.offsets), np.asarray(ids.values).astype("<i4", copy=False)
        rows = []
        for b, e in zip(ends[:-1], ends[1:], strict=True):
            text = vocab.decode(flat[b:e])
            rows.append((int(e - b), zlib.crc32(flat[b:e].tobytes()), len(text), zlib.crc32(text.encode("utf-8", "replace"))))
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_pieces", "ids_crc32", "n_chars", "text_crc32"])

    return encode(docs, model, finish=finish, schema="doc_id long, n_pieces long, ids_crc32 long, n_chars long, text_crc32 long", **options)
