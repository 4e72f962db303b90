"""Token-id store: documents as ids in compressed shards, read back by document.

A shard holds the ids of consecutive documents, compressed with Re-Pair: frequent
neighbouring pairs are replaced by new symbols (nonterminals) until no pair is
frequent enough. The shard keeps the rules (a pair for each nonterminal) and how
many ids each nonterminal stands for, so that any range of ids can be decoded
without expanding what comes before it.

The container is a Parquet dataset of one row for each shard, written and
committed by Spark, so a lost executor costs a task and never a shard.

Shard blob, little-endian: magic ``RPG1``; uint32 size of the alphabet; uint64
number of ids; uint32 number of rules; uint32 number of symbols; uint8 width of
a symbol (2 or 4 bytes); the rules' left and right symbols; the rules' lengths
(uint32); the symbols.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versotext.llm.text import gather, id_and_text, pieces

MAGIC = b"RPG1"
HEAD = struct.Struct("<4sIQIIB")
#: Pairs are counted in 2 ** SLOT_BITS slots at most.
SLOT_BITS = 20
#: Ids that are read from a shard at a time.
RANGE = 1 << 17
ODD = (-7046029254386353131, -4417276706812531889, 1609587929392839161, -8796714831421723037)


# --- Re-Pair -----------------------------------------------------------------

def compress(ids: np.ndarray, alphabet: int, least: int = 24, per_round: int = 4096) -> bytes:
    """The shard blob of ``ids``.

    A round counts neighbouring pairs and gives a nonterminal to each of the
    ``per_round`` most frequent that occur ``least`` times or more; where two of them
    share an id, the left one of a run wins. Pairs are counted in slots, without sorting. Rounds go on until no pair occurs so often;
    each makes the sequence shorter. A pair only becomes rarer after the round that made its newer symbol, so
    places whose pair was too rare once are not counted again.
    """
    s = np.array(ids, dtype=np.int32 if alphabet + len(ids) < 1 << 31 else np.int64)  # a copy: it is changed in place
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    following = alphabet
    turn = 0
    live = np.ones(len(s), dtype=bool)  # places whose pair with the next one may be frequent
    live[-1:] = False
    while True:
        at = np.flatnonzero(live)
        if len(at) < least:
            break
        keys = (s[:-1].astype(np.int64) << 32) | s[1:] if not turn else (s[at].astype(np.int64) << 32) | s[at + 1]
        # a pair as frequent as asked for falls in a slot at least as frequent: count the slots first
        bits = min(SLOT_BITS, max(10, len(at).bit_length()))
        slots = ((keys * np.int64(ODD[turn % len(ODD)])) >> np.int64(64 - bits)) & np.int64((1 << bits) - 1)
        turn += 1
        often = np.bincount(slots, minlength=1 << bits) >= least
        # of the pairs that share a slot one is counted in this round; the rounds' slots differ
        one = np.empty(1 << bits, dtype=np.int64)
        one[slots] = keys
        counted = one[slots] == keys
        counts = np.bincount(np.where(counted, slots, 1 << bits), minlength=1 << bits)[: 1 << bits]
        live[at] = often[slots] & ~(counted & (counts < least)[slots])
        good = np.flatnonzero(counts >= least)
        if not len(good):  # none was counted, but one may share its slot: now all are
            at, keys = at[often[slots]], keys[often[slots]]
            one, slots, counts = np.unique(keys, return_inverse=True, return_counts=True)
            counted = np.ones(len(keys), dtype=bool)
            good = np.flatnonzero(counts >= least)
            if not len(good):
                break
        if len(good) > per_round:
            good = np.sort(good[np.argsort(-counts[good], kind="stable")[:per_round]])
        symbol = np.full(len(one), -1, dtype=s.dtype)
        symbol[good] = following + np.arange(len(good))
        new = symbol[slots]
        hit = np.flatnonzero(counted & (new >= 0))
        at, new = at[hit], new[hit]
        # neighbouring hits overlap: of each run of hits keep the first, third, ...
        places = np.arange(len(at))
        begin = np.where(np.diff(at, prepend=-2) == 1, 0, places)
        keep = np.flatnonzero((places - np.maximum.accumulate(begin)) & 1 == 0)
        at, new = at[keep], new[keep]
        s[at] = new
        alive = np.ones(len(s), dtype=bool)
        alive[at + 1] = False
        alive = np.flatnonzero(alive)
        s, live = s[alive], live[alive]
        # the new symbols' pairs, with what is before and after them
        at -= places[: len(at)]
        live[at] = True
        live[np.maximum(at - 1, 0)] = True
        live[-1] = False
        left.append(one[good] >> 32)
        right.append(one[good] & 0xFFFFFFFF)
        following += len(good)
    a = np.concatenate(left) if left else np.zeros(0, np.int64)
    b = np.concatenate(right) if right else np.zeros(0, np.int64)
    lengths = _lengths(a, b, alphabet)
    kind = "<u2" if following <= 1 << 16 else "<u4"
    return b"".join((
        HEAD.pack(MAGIC, alphabet, len(ids), len(a), len(s), 2 if kind == "<u2" else 4),
        a.astype(kind).tobytes(), b.astype(kind).tobytes(), lengths.astype("<u4").tobytes(), s.astype(kind).tobytes(),
    ))


def _levels(a: np.ndarray, b: np.ndarray, alphabet: int) -> Iterator[slice]:
    """Runs of rules that refer to earlier runs only."""
    begin = 0
    while begin < len(a):
        inner = (np.maximum(a[begin:], b[begin:]) >= alphabet + begin).argmax() if (np.maximum(a[begin:], b[begin:]) >= alphabet + begin).any() else len(a) - begin
        yield slice(begin, begin + int(inner))
        begin += int(inner)


def _lengths(a: np.ndarray, b: np.ndarray, alphabet: int) -> np.ndarray:
    out = np.ones(alphabet + len(a), dtype=np.int64)
    for part in _levels(a, b, alphabet):
        out[alphabet + part.start : alphabet + part.stop] = out[a[part]] + out[b[part]]
    return out[alphabet:]


class Shard:
    """A compressed shard opened for reading."""

    def __init__(self, blob: bytes):
        magic, self.alphabet, self.n, rules, symbols, width = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        kind, at = ("<u2" if width == 2 else "<u4"), HEAD.size
        self.a = np.frombuffer(blob, kind, rules, at).astype(np.int64)
        self.b = np.frombuffer(blob, kind, rules, at + width * rules).astype(np.int64)
        at += 2 * width * rules
        self.lengths = np.frombuffer(blob, "<u4", rules, at).astype(np.int64)
        self.symbols = np.frombuffer(blob, kind, symbols, at + 4 * rules).astype(np.int64)
        self._ends: np.ndarray | None = None
        self._runs: tuple[np.ndarray, np.ndarray] | None = None

    def _expand(self, s: np.ndarray) -> np.ndarray:
        """The ids that the symbols stand for: of few symbols only their rules are expanded, else all rules once."""
        if self._runs is None and len(s) <= len(self.a):
            while len(s) and (big := s >= self.alphabet).any():
                out = np.repeat(s, 1 + big)
                at = (np.cumsum(1 + big) - (1 + big))[big]
                rule = s[big] - self.alphabet
                out[at], out[at + 1] = self.a[rule], self.b[rule]
                s = out
            return s
        if not len(self.a):
            return s
        if self._runs is None:
            # the ids of each symbol one after another: a round's rules hold a twelfth of the shard's ids at most, by the default ``least``
            flat, starts = np.arange(self.alphabet), np.arange(self.alphabet + 1)
            for part in _levels(self.a, self.b, self.alphabet):
                pairs = np.stack((self.a[part], self.b[part]), axis=1).reshape(-1)
                flat = np.concatenate((flat, gather(flat, starts, pairs)))
                starts = np.concatenate((starts, starts[-1] + np.cumsum(self.lengths[part])))
            self._runs = flat, starts
        return gather(*self._runs, s)

    def all(self) -> np.ndarray:
        return self._expand(self.symbols)

    def read(self, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` to ``end`` (not included), expanding only the symbols that cover them."""
        begin, end = max(begin, 0), min(end, self.n)
        if begin >= end:
            return np.zeros(0, np.int64)
        if self._ends is None:
            sizes = np.where(self.symbols >= self.alphabet, np.append(self.lengths, 1)[np.maximum(self.symbols - self.alphabet, -1)], 1)
            self._ends = np.cumsum(sizes)
        first, last = np.searchsorted(self._ends, [begin, end - 1], side="right")
        before = self._ends[first - 1] if first else 0
        return self._expand(self.symbols[first : last + 1])[begin - before : end - before]


# --- encoding ------------------------------------------------------------------

class Encoder:
    """Ids of whole texts, as ``tokenizers`` gives them, from an encoding of the distinct words.

    The byte-level pre-tokenizer always ends a token before a single space between two
    other characters, around a single line feed, and between a letter and a comma or full
    stop. What stands between such places can be encoded apart and remembered. A
    text with longer runs of white space is encoded whole.
    """

    #: Two white-space characters side by side, or the mark that stands for a line feed, in RE2's terms.
    ODD = r"[\t-\r\x1c-\x20\x{85}\p{Z}]{2}|\x01"
    REMEMBER = 900_000

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.alphabet = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # these or an added token, in one pass
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join((self.ODD, *("".join(f"\\x{{{ord(c):x}}}" for c in t) for t in added)))
        self.kind = np.uint16 if self.alphabet <= 1 << 16 else np.uint32
        # tokens that begin with a space, or are a line feed: in a row of words parted by one of them these part the words
        self.begins = np.zeros(self.alphabet, dtype=bool)
        self.feeds = np.zeros(self.alphabet, dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.begins[i] = token.startswith("\u0120")
            self.feeds[i] = token == "\u010a"
        self._forget()

    def _forget(self) -> None:
        self.spaced: dict[str, int] = {}
        self.bare: dict[str, int] = {}
        fixed = [np.zeros(0, self.kind), self._ids("\n"), self._ids(","), self._ids("."), self._ids(" ")]
        self.ids, self.starts = np.concatenate(fixed), np.concatenate(([0], np.cumsum(list(map(len, fixed)))))
        self.spaced[""], self.bare[""] = 4, 0

    def _ids(self, text: str) -> np.ndarray:
        return self._all_ids([text])

    def _all_ids(self, texts: list[str]) -> np.ndarray:
        # the fast form gives the same ids without places in the text
        return np.concatenate([np.array(e.ids, dtype=self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _keep(self, known: dict[str, int], words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        begin = len(self.starts) - 1
        known.update(zip(words, range(begin, begin + len(words)), strict=True))
        self.ids = np.concatenate((self.ids, ids))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))

    def _learn(self, known: dict[str, int], new: list[str], spaced: bool) -> None:
        lead = " " if spaced else ""
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            # the library takes longer for a word the longer the text is
            rows = [part[i : i + 200] for i in range(0, len(part), 200)]
            if spaced:
                ids = self._all_ids([" " + " ".join(row) for row in rows])
                edges = np.flatnonzero(self.begins[ids])
                sizes = np.diff(np.append(edges, len(ids)))
            else:
                ids = self._all_ids(["\n".join(row) + "\n" for row in rows])
                edges = np.flatnonzero(self.feeds[ids])
                sizes = np.diff(np.concatenate(([-1], edges))) - 1
                ids = ids[~self.feeds[ids]]
            if len(sizes) != len(part) or not sizes.all():  # a tokenizer of another kind: one call for each word
                each = [self._ids(lead + w) for w in part]
                ids, sizes = np.concatenate(each), np.array(list(map(len, each)))
            self._keep(known, part, ids, sizes)

    def _places(self, known: dict[str, int], words: list[str], spaced: bool) -> np.ndarray:
        """Where the ids of the words, which are distinct, begin in ``starts``."""
        places = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            begin = len(self.starts) - 1
            odd = np.zeros(len(new), dtype=bool)
            if not spaced:
                odd[:] = [w[0].isspace() or w[-1].isspace() for w in new]
            for i in np.flatnonzero(odd).tolist():
                one = self._ids(new[i])
                self._keep(known, [new[i]], one, np.array([len(one)]))
            self._learn(known, [new[i] for i in np.flatnonzero(~odd).tolist()] if odd.any() else new, spaced)
            # places are given in the order of learning
            places[np.concatenate((missing[odd], missing[~odd]))] = begin + np.arange(len(new))
        return places

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, an end id after each text, and the number for each text."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._plain(texts, end_id)
        ids, counts = self._plain(texts.filter(pa.array(~odd)), end_id)
        plain = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [])
        out = [np.append(self._ids(t), self.kind(end_id)) if o else next(plain) for t, o in zip(texts.to_pylist(), odd, strict=True)]
        return np.concatenate(out), np.array(list(map(len, out)), dtype=np.int64)

    def _plain(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return self.ids[:0], np.zeros(0, np.int64)
        if len(self.spaced) + len(self.bare) > self.REMEMBER:
            self._forget()
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \x01 "), " ")
        offsets = np.asarray(split.offsets).astype(np.int64)
        offsets -= offsets[0]
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary
        # codes of words after a space are places in ``names``; those of other words, and of a text's end, follow
        codes = np.array(coded.indices)
        feed = pc.index(names, "\x01").as_py()
        # the first word of a text and of a line has no space before it
        bare = np.concatenate((offsets[:-1], np.flatnonzero(codes == feed) + 1))
        bare_names, bare_codes = np.unique(codes[bare], return_inverse=True)
        codes[bare] = len(names) + bare_codes
        used = np.bincount(codes, minlength=len(names))[: len(names)] > 0
        if feed >= 0:
            used[feed] = False
        # a word's ending mark is a piece by itself
        marked = pc.match_substring_regex(names, r"\p{L}[,.]$")
        cores = pc.if_else(marked, pc.utf8_slice_codeunits(names, 0, -1), names).dictionary_encode()
        core_codes, cores = np.asarray(cores.indices), cores.dictionary
        mark = np.where(marked.to_numpy(zero_copy_only=False), np.where(pc.ends_with(names, ",").to_numpy(zero_copy_only=False), 2, 3), 0)
        end = len(names) + len(bare_names)
        # two pieces for each code, the second one empty without a mark
        pieces_at = np.zeros((end + 1, 2), dtype=np.int64)
        for known, own, rows, spaced in ((self.bare, bare_names, slice(len(names), end), False), (self.spaced, np.flatnonzero(used), np.flatnonzero(used), True)):
            wanted = np.zeros(len(cores), dtype=bool)
            wanted[core_codes[own]] = True
            place_of = np.zeros(len(cores), dtype=np.int64)
            place_of[wanted] = self._places(known, cores.filter(pa.array(wanted)).to_numpy(zero_copy_only=False).tolist(), spaced)
            pieces_at[rows, 0] = place_of[core_codes[own]]
            pieces_at[rows, 1] = mark[own]
        if feed >= 0:
            pieces_at[feed, 0] = 1
        pieces_at[end, 0] = len(self.starts) - 1
        # the ids of each code as a binary value: taking these by the codes sets all ids one after another
        starts = np.append(self.starts, self.starts[-1] + 1)
        flat = gather(np.append(self.ids, self.kind(end_id)), starts, pieces_at.reshape(-1))
        sizes = (starts[pieces_at + 1] - starts[pieces_at]).sum(axis=1)
        ends = np.concatenate(([0], np.cumsum(sizes))) * flat.itemsize
        values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end + 1, [None, pa.py_buffer(ends), pa.py_buffer(flat)])
        last = offsets[1:] + np.arange(len(texts))
        every = np.full(len(codes) + len(texts), end, dtype=codes.dtype)
        inner = np.ones(len(every), dtype=bool)
        inner[last] = False
        every[inner] = codes
        taken = values.take(pa.array(every))
        stops = np.frombuffer(taken.buffers()[1], np.int64, len(every) + 1)[last + 1] // flat.itemsize
        return np.frombuffer(taken.buffers()[2], self.kind, int(stops[-1])), np.diff(stops, prepend=0)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The worker's encoder, kept with its memory from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


SHARDS = "part int, first_in_part long, n_docs long, n_tokens long, doc_ids binary, sizes binary, ids binary"


def write_token_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 20, files: int | None = None) -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write shards in ascending id order.

    Rows are dealt to ``files`` ranges of ids (the session's shuffle partitions if
    None); a shard ends after the document that brings it to ``shard_tokens`` ids. Rows
    with a null id come first; rows with equal ids follow each other in the order of a hash of their
    text, and may be dealt to several ranges, so that very many of them are no single task's. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        own = _encoder(tokenizer)
        written, ids, doc_ids, sizes, held = 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal written, ids, doc_ids, sizes, held
            joined = np.concatenate(ids)
            row = {"part": pa.array([part], pa.int32()), "first_in_part": pa.array([written], pa.int64()), "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_tokens": pa.array([len(joined)], pa.int64())}
            present = np.array([x is not None for x in doc_ids], dtype=np.uint8)
            numbers = np.array([x or 0 for x in doc_ids], dtype="<i8")
            row |= {"doc_ids": pa.array([present.tobytes() + numbers.tobytes()], pa.binary()), "sizes": pa.array([np.array(sizes, dtype="<u8").tobytes()], pa.binary())}
            row |= {"ids": pa.array([compress(joined, own.alphabet)], pa.binary())}
            written, ids, doc_ids, sizes, held = written + len(joined), [], [], [], 0
            return pa.RecordBatch.from_pydict(row)

        for batch in pieces(batches, "text", 6_000_000):
            got, counts = own.encode(batch.column("text"), end_id)
            keys, begin, at = batch.column("doc_id").to_pylist(), 0, 0
            stops = np.cumsum(counts)
            while begin < len(keys):
                # as many documents as fill the shard, one at least
                last = int(np.searchsorted(stops, at + shard_tokens - held))
                last = min(last, len(keys) - 1)
                ids.append(got[at : stops[last]])
                doc_ids += keys[begin : last + 1]
                sizes += counts[begin : last + 1].tolist()
                held += int(stops[last] - at)
                at, begin = int(stops[last]), last + 1
                if held >= shard_tokens:
                    yield close()
        if doc_ids:
            yield close()

    ordered = id_and_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    ordered.mapInArrow(run, SHARDS).write.mode("overwrite").parquet(path)


def _ranges(stops: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of documents that hold about ``size`` ids, one document at least."""
    begin = 0
    while begin < len(stops):
        end = int(np.searchsorted(stops, (stops[begin - 1] if begin else 0) + size, side="right"))
        end = max(end, begin + 1)
        yield begin, end
        begin = end


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``first``, the number of ids before each."""
    shards = spark.read.parquet(path)
    # a part knows where its shards begin; only the parts' totals, one row for each file, are summed up here
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    return shards.join(F.broadcast(before), "part").withColumn("first", F.col("part_start") + F.col("first_in_part"))


def read_ids(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """``at`` and ``id`` of the ids ``begin`` to ``end`` (not included) of the whole store: other shards aren't opened, other ids not expanded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, blob in zip(batch.column("first").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                shard = Shard(blob)
                b, e = max(begin - first, 0), min(end - first, shard.n)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + b, first + e)), pa.array(shard.read(b, e))], ["at", "id"])

    near = _placed(spark, path).where((F.col("first") < end) & (F.col("first") + F.col("n_tokens") > begin))
    return near.select("first", "ids").mapInArrow(run, "at long, id long")


def read_token_store(spark: SparkSession, path: str, want_ids: bool = False) -> DataFrame:
    """Documents of a store: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, the ids themselves."""
    rows = _placed(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, first = batch.column("n_docs")[i].as_py(), batch.column("first")[i].as_py()
                raw = batch.column("doc_ids")[i].as_py()
                present, numbers = np.frombuffer(raw, np.uint8, n).astype(bool), np.frombuffer(raw, "<i8", n, n)
                sizes = np.frombuffer(batch.column("sizes")[i].as_py(), "<u8").astype(np.int64)
                shard, stops = Shard(batch.column("ids")[i].as_py()), np.cumsum(sizes)
                # as many documents at a time as hold about RANGE ids
                for b, e in _ranges(stops, RANGE):
                    base = int(stops[b - 1]) if b else 0
                    ids = shard.read(base, int(stops[e - 1])).astype("<u4")
                    ends = stops[b:e] - base
                    view = memoryview(ids.tobytes())
                    crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(ends - sizes[b:e], ends, strict=True)]
                    columns = [pa.array(numbers[b:e], pa.int64(), mask=~present[b:e]), pa.array(first + stops[b:e] - sizes[b:e], pa.int64()), pa.array(sizes[b:e], pa.int64()), pa.array(crc, pa.int64())]
                    if want_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32), pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if want_ids else "")
    return rows.select("n_docs", "first", "doc_ids", "sizes", "ids").mapInArrow(run, schema)
