"""N-gram Jaccard self-join: which documents have nearly the same set of word n-grams.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of
distinct ``n``-word shingles. The search is a T-occurrence search: a document of s
shingles links only with documents that stand in at least T = ceil(percent * s /
100) of its shingles' inverted lists.

1. A first pass drops documents that can't have a partner. In any fixed order of
   shingles (here: their hash) the first l shared ones lie in the first
   s - T + l of each of the two documents; a document with too few of its first
   shingles in any other document has no partner. Tasks count shingles among their
   own documents first, so a frequent shingle costs a task one entry.
2. Equal sets become one class, kept by its smallest id.
3. Inverted lists of the classes: a shingle's list length is its number of classes. A class with fewer
   than T shingles in lists of two or more is dropped. Of the others, the s - T + 1
   shortest lists (of those with two or more) connect it with possible partners.
4. Possible partners are gathered in groups (connected through those short lists)
   and each group is searched with DivideSkip: short lists are merged with a heap, and
   whoever occurs T - L times there is probed for by binary search in the L long
   lists. Groups above ``block`` classes are searched block against block.

Only edges that span the links are kept, not all pairs.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versotext.llm.components import connected_components
from versotext.llm.text import id_and_text, pieces, raw_texts, release, shared_checkpoint

#: A-Z to lower case; the white space of the word pattern to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
#: Bytes of text for each bucket of the first pass.
BUCKET_BYTES = 128 << 20
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(raws: list[bytes | None], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """All documents' sorted distinct 64-bit shingle hashes one after another, and the size of each set.

    A text with fewer than ``n`` words has its whole sequence of words as its shingle; without words it has none.
    """
    import xxhash

    words = [raw.translate(FOLD).split() if raw else [] for raw in raws]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = pa.array([w for own in words for w in own], pa.binary())
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(raws), np.int64)
    coded = pc.dictionary_encode(flat)
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = known[np.asarray(coded.indices)]
    row = np.repeat(np.arange(len(raws)), counts)
    ends = np.cumsum(counts)
    place = np.arange(len(h)) - (ends - counts)[row]
    lengths = np.minimum(counts, n)
    begins = place <= (counts - lengths)[row]
    at = np.flatnonzero(begins)
    size = lengths[row[at]]
    padded = np.concatenate((h, np.zeros(n, np.uint64)))
    s = size.astype(np.uint64) * np.uint64(ODD[7])
    for k in range(n):
        s = _mix(s + np.where(k < size, padded[at + k], np.uint64(0)) * np.uint64(ODD[k % 7]) + np.uint64(k))
    order = np.lexsort((s, row[at]))
    s, r = s[order], row[at][order]
    fresh = np.ones(len(s), dtype=bool)
    fresh[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    return s[fresh], np.bincount(r[fresh], minlength=len(raws))


def threshold(sizes: np.ndarray, percent: int) -> np.ndarray:
    """T: the least number of common shingles of a set of each size with any partner."""
    return -(-sizes * percent // 100)


def _spare(sizes: np.ndarray) -> np.ndarray:
    """How many shared shingles the first pass asks for: more of larger sets, 1 at least."""
    return np.maximum(1, sizes // 10)


# --- first pass: who has a possible partner ------------------------------------

def _possible(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """``uid`` of the rows that share enough of their first shingles with others.

    With a row's own spare l and its smallest possible partner's, the smaller is what must be shared.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 24_000_000):
            hashes, docs_of = [], []
            uids = batch.column("uid").to_numpy()
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                h, sizes = shingle_sets(raw_texts(part), n)
                ends = np.cumsum(sizes)
                take = np.minimum(sizes, sizes - threshold(sizes, percent) + _spare(sizes))
                row = np.repeat(np.arange(len(sizes)), take)
                at = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take) + (ends - sizes)[row]
                hashes.append(h[at])
                docs_of.append(uids[begin + row])
                some = np.flatnonzero(sizes)
                asked = uids[begin + some]
                yield _blobs("doc", _bucket(asked, buckets), asked, -_spare(threshold(sizes[some], percent)))
            h, d = np.concatenate(hashes), np.concatenate(docs_of)
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            count = np.diff(np.append(begin, len(h)))
            # a shingle that stands in several documents here is shared wherever else it stands; of it
            # others need to hear only once, and its documents are known to share it
            several = np.repeat(count > 1, count)
            shared, n_shared = np.unique(d[several], return_counts=True)
            yield _blobs("doc", _bucket(shared, buckets), shared, n_shared)
            one = h[begin]
            who = np.where(count > 1, np.int64(-1), d[begin])
            # 32 bits of the hash beside the bucket: two shingles taken for one only keep a document too many
            yield _blobs("shingle", (one >> np.uint64(33)).astype(np.int64) % buckets, one.astype(np.uint32), who)

    def meet(group: pa.Table) -> pa.Table:
        """Of one bucket of shingles: the documents whose entry isn't the only one of its shingle."""
        if group["kind"][0].as_py() == "doc":
            return group
        h = np.concatenate([np.frombuffer(x, np.uint32) for x in group["keys"].to_pylist()])
        who = np.concatenate([np.frombuffer(x, np.int64) for x in group["data"].to_pylist()])
        order = np.argsort(h, kind="stable")
        h, who = h[order], who[order]
        begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        count = np.diff(np.append(begin, len(h)))
        found = who[np.repeat(count > 1, count)]
        shared, n_shared = np.unique(found[found >= 0], return_counts=True)
        return pa.Table.from_batches([_blobs("doc", _bucket(shared, buckets), shared, n_shared)])

    def total(group: pa.Table) -> pa.Table:
        d = np.concatenate([np.frombuffer(x, np.int64) for x in group["keys"].to_pylist()])
        c = np.concatenate([np.frombuffer(x, np.int64) for x in group["data"].to_pylist()])
        keys, at = np.unique(d, return_inverse=True)
        # what is asked for is negative; of rows that share an id the least demanding counts
        shared = np.bincount(at, weights=np.maximum(c, 0), minlength=len(keys))
        asked = np.full(len(keys), np.iinfo(np.int64).min)
        np.maximum.at(asked, at[c < 0], c[c < 0])
        return pa.table({"uid": pa.array(keys[shared >= -asked.astype(np.float64)], pa.int64())})

    blob = "kind string, bucket int, keys binary, data binary"
    sent = docs.select("uid", "text").mapInArrow(first, blob).groupBy("kind", "bucket").applyInArrow(meet, blob)
    return sent.groupBy("bucket").applyInArrow(total, "uid long")


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(ids.astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % buckets


def _blobs(kind: str, bucket: np.ndarray, keys: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    """Keys and data packed into a row for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, keys, data = bucket[order], keys[order], data[order].astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(bucket))[: len(begin)]
    return pa.RecordBatch.from_pydict({
        "kind": pa.array([kind] * len(begin), pa.string()), "bucket": pa.array(bucket[begin], pa.int32()),
        "keys": pa.array([keys[b:e].tobytes() for b, e in zip(begin, end, strict=True)], pa.binary()),
        "data": pa.array([data[b:e].tobytes() for b, e in zip(begin, end, strict=True)], pa.binary()),
    })


# --- DivideSkip -------------------------------------------------------------------

class Union:
    """Union-find over 0 to n - 1, the smallest member as representative."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def divide_skip(query: np.ndarray, lists: dict[int, list[int]], least: int, mu: float = 0.01) -> list[tuple[int, int]]:
    """(member, occurrences) of those that occur in ``least`` or more of the query's lists.

    The L longest lists are set aside; the others are merged with a heap, skipping
    members that come up fewer than ``least`` - L times; the rest is looked for in
    the long lists by binary search.
    """
    own = sorted((x for x in map(lists.get, query.tolist()) if x is not None), key=len)
    if len(own) < least:
        return []
    aside = min(least - 1, int(least / (mu * math.log2(len(own[-1]) + 1) + 1)))
    short, long = own[: len(own) - aside], own[len(own) - aside :]
    need = least - aside
    heads = [(x[0], i, 0) for i, x in enumerate(short)]
    heapq.heapify(heads)
    found = []
    while len(heads) >= need:
        member, popped = heads[0][0], []
        while heads and heads[0][0] == member:
            popped.append(heapq.heappop(heads))
        following = member + 1
        if len(popped) >= need:
            n = len(popped)
            for k, x in enumerate(long):
                if n + len(long) - k < least:
                    break
                at = bisect_left(x, member)
                n += at < len(x) and x[at] == member
            if n >= least:
                found.append((member, n))
        else:
            # who comes up before the need-th head can't be found any more: pop up to it and skip ahead
            while heads and len(popped) < need - 1:
                popped.append(heapq.heappop(heads))
            if heads:
                following = heads[0][0]
        for _, i, at in popped:
            at = bisect_left(short[i], following, at)
            if at < len(short[i]):
                heapq.heappush(heads, (short[i][at], i, at))
    return found


def linked(a: int, b: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def search_blocks(index: list[np.ndarray], probes: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Edges that span all links of ``probes`` with ``index`` (of ``index`` with itself if None).

    Sets that a pivot explains are cleared first: who links with a group's first set
    belongs to its group. Only the rest is searched in the inverted lists, and a set is
    a candidate only if it isn't in the query's group yet.
    """
    sets = index if probes is None else index + probes
    edges: list[tuple[int, int]] = []
    groups = Union(len(sets))
    first = 0 if probes is None else len(index)
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    _pivots(sets, order, percent, groups, edges)
    biggest, n = Counter(groups.find(i) for i in range(len(sets))).most_common(1)[0]
    if n == len(sets):
        return edges
    lists = _inverted(index)
    # pairs inside the biggest group are connected already; any other pair has a side outside it
    for i in range(first, len(sets)):
        if groups.find(i) != groups.find(biggest):
            for j, n in divide_skip(sets[i], lists, _least(sets[i], percent)):
                if j != i and linked(len(sets[i]), len(sets[j]), n, percent) and groups.join(i, j):
                    edges.append((i, j))
    if probes is not None:
        inside = [i for i in range(first, len(sets)) if groups.find(i) == groups.find(biggest)]
        outside = [j for j in range(first) if groups.find(j) != groups.find(biggest)]
        if inside and outside:
            lists = _inverted([sets[i] for i in inside])
            for j in outside:
                for i, n in divide_skip(sets[j], lists, _least(sets[j], percent)):
                    if linked(len(sets[j]), len(sets[inside[i]]), n, percent) and groups.join(inside[i], j):
                        edges.append((inside[i], j))
    return edges


def _least(own: np.ndarray, percent: int) -> int:
    return -(-len(own) * percent // 100)


def _inverted(sets: list[np.ndarray]) -> dict[int, list[int]]:
    """For each shingle the sorted places of the sets that hold it."""
    flat = np.concatenate(sets)
    member = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    by = np.argsort(flat, kind="stable")
    flat, member = flat[by], member[by].tolist()
    begin = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))).tolist()
    return {h: member[b:e] for h, b, e in zip(flat[begin].tolist(), begin, [*begin[1:], len(member)], strict=True)}


def _pivots(sets: list[np.ndarray], order: list[int], percent: int, groups: Union, edges: list[tuple[int, int]], rounds: int = 3) -> None:
    """Link what links with a few pivots: in each round the middle of what is left, by size."""
    left = order
    for _ in range(rounds):
        if len(left) < 8:
            return
        pivot = left[len(left) // 2]
        own = sets[pivot]
        rest = [i for i in left if i != pivot]
        flat = np.concatenate([sets[i] for i in rest])
        row = np.repeat(np.arange(len(rest)), [len(sets[i]) for i in rest])
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        common = np.bincount(row[own[at] == flat], minlength=len(rest))
        left = []
        for i, n in zip(rest, common.tolist(), strict=True):
            if linked(len(sets[i]), len(own), n, percent):
                if groups.join(pivot, i):
                    edges.append((pivot, i))
            else:
                left.append(i)


def _sets(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """Shingle hashes, set sizes, each set as bytes, and a 128-bit print of each."""
    import xxhash

    h, n_of = shingle_sets(raw_texts(batch), n)
    ends = np.cumsum(n_of)
    blobs = [h[e - k : e].tobytes() for k, e in zip(n_of, ends, strict=True)]
    return h, n_of, blobs, [xxhash.xxh3_128_digest(b) for b in blobs]


# --- the join ---------------------------------------------------------------------

def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, block: int = 512) -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_id (smallest id with the same set) and component_id.

    ``component_id`` is the smallest id reachable by links, the row's own included.
    Null and empty texts have no shingles and link with nothing. Rows with a null
    id get null class and component and take no part. Rows that share an id count as
    one node with several texts. Other columns are ignored.
    """
    spark = docs.sparkSession
    own = id_and_text(docs, id_col, text_col)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2_000_000):
            _, n_of, _, prints = _sets(batch, n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_of, pa.int64()), pa.array(prints, pa.binary())], ["doc_id", "n_shingles", "print"])

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2_000_000):
            _, n_of, blobs, prints = _sets(batch, n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_of, pa.int64()), pa.array(prints, pa.binary()), pa.array(blobs, pa.binary())], ["doc_id", "n", "print", "shingles"])

    nodes = own.where("doc_id is not null and text is not null").withColumnRenamed("doc_id", "uid")
    # about half a byte is shuffled for each byte of text; a bucket is read by one task
    size = nodes.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    # the first shingles are done with before the texts of possible partners are moved
    partners = shared_checkpoint(_possible(nodes, n, percent, buckets))
    release(spark)
    possible = nodes.join(partners, "uid").select(F.col("uid").alias("doc_id"), "text")
    sets = possible.mapInArrow(arrays, "doc_id long, n long, print binary, shingles binary")
    ones = shared_checkpoint(sets.groupBy("print").agg(F.min("doc_id").alias("c"), F.first("n").alias("n"), F.first("shingles").alias("shingles")))
    # candidate texts are done with
    del sets, possible, partners
    release(spark)
    links = shared_checkpoint(_class_links(ones, percent, block))
    release(spark)
    counted = shared_checkpoint(own.mapInArrow(sizes, "doc_id long, n_shingles long, print binary"))
    members = counted.where("doc_id is not null and n_shingles > 0").join(ones.select("print", F.col("c").alias("class_id")), "print").select("doc_id", "class_id")
    parts = connected_components(members.select(F.col("doc_id").alias("a"), F.col("class_id").alias("b")).unionByName(links))
    by_class = members.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    out = counted.join(by_class, "doc_id", "left").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows, all columns kept, without those that a document with a smaller id stands for.

    Of rows that share an id one stays, the one with the smallest text. Rows with a null id stay.
    """
    links = shared_checkpoint(jaccard_links(docs, id_col, text_col, n, percent))
    gone = links.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(gone, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
    twice = links.where("doc_id is not null").groupBy(F.col("doc_id").alias("__twice")).count().where("count > 1").select("__twice")
    if twice.isEmpty():
        return kept
    same = F.col(f"`{id_col}`") == F.col("__twice")
    place = F.row_number().over(Window.partitionBy(f"`{id_col}`").orderBy(f"`{text_col}`"))
    one = kept.join(twice, same, "left_semi").withColumn("__place", place).where("__place = 1").drop("__place")
    return kept.join(twice, same, "left_anti").unionByName(one)


def _class_links(ones: DataFrame, percent: int, block: int) -> DataFrame:
    """Edges (a, b) that span the links of the classes (c, n, shingles)."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "shingles", 1_000_000):
            h = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
            counts = [len(x) for x in h]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("c").to_numpy(), counts)), pa.array(np.concatenate(h))], ["c", "h"])

    lists = ones.select("c", "shingles").mapInArrow(spread, "c long, h long")
    lengths = lists.groupBy("h").agg(F.count("*").alias("length")).where("length > 1")
    least = F.ceil(F.col("n") * percent / 100).cast("long")
    shared = lists.join(lengths, "h").groupBy("c").agg(F.count("*").alias("shared"), F.array_sort(F.collect_list(F.struct("length", "h"))).alias("by_length"))
    shared = shared.join(ones.select("c", "n"), "c").where(F.col("shared") >= least)
    # shingles of no other class come first in the order by length; of the first n - T + 1 the rest are keys
    n_keys = (F.col("shared") - least + 1).cast("int")
    keys = shared_checkpoint(shared.select("c", F.explode(F.slice("by_length", F.lit(1), n_keys)).alias("key")).select("c", F.col("key.h").alias("h")))
    del lists, lengths, shared
    release(ones.sparkSession)
    heads = keys.groupBy("h").agg(F.min("c").alias("head"))
    groups = connected_components(keys.join(heads, "h").select(F.col("c").alias("a"), F.col("head").alias("b")).where("a <> b"))
    groups = groups.select(F.col("node").alias("c"), F.col("component").alias("g"))
    groups = groups.join(groups.groupBy("g").agg(F.count("*").alias("members")), "g")
    # the sets are joined once; what follows moves only those of the groups it is about
    groups = shared_checkpoint(groups.join(ones.select("c", "shingles"), "c").select("c", "g", "members", "shingles"))
    # a task takes many small groups at once, about a block of sets in all
    tasks = max(1, -(-2 * groups.where(F.col("members") <= block).count() // block))
    small = groups.where(F.col("members") <= block).withColumn("task", F.pmod(F.xxhash64("g"), F.lit(tasks)).cast("int"))

    def inside(bundle: pa.Table) -> pa.Table:
        bundle = bundle.sort_by("g")
        g, ids = bundle["g"].to_numpy(), bundle["c"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in bundle["shingles"].to_pylist()]
        begin = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))).tolist()
        found = [(b + i, b + j) for b, e in zip(begin, [*begin[1:], len(g)], strict=True) if e - b > 1 for i, j in search_blocks(sets[b:e], None, percent)]
        return _edges(ids, found)

    edge = "a long, b long"
    links = small.select("task", "g", "c", "shingles").groupBy("task").applyInArrow(inside, edge)
    large = groups.where(F.col("members") > block)
    return links if large.isEmpty() else links.unionByName(_large_links(keys, heads, large, percent, block))


def _large_links(keys: DataFrame, heads: DataFrame, large: DataFrame, percent: int, block: int) -> DataFrame:
    """Edges that span the links inside the groups of ``large`` (c, g, members, shingles); ``keys`` are the short lists (c, h), ``heads`` each one's smallest class."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b in zip(batch.column("own").to_pylist(), batch.column("other").to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                found.append(linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), percent))
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("head")], ["c", "head"]).filter(pa.array(found, pa.bool_()))

    def against(group: pa.Table) -> pa.Table:
        sides = [group.filter(pc.equal(group["side"], s)) for s in (0, 1)]
        sets = [[np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()] for t in sides]
        ids = np.concatenate([t["c"].to_numpy() for t in sides])
        if not sets[0]:
            return _edges(ids, [])
        return _edges(ids, search_blocks(sets[0], sets[1] or None, percent))

    own = keys.join(large.select("c", "g", "members"), "c")
    # of each class the head that most of its short lists have
    near = own.join(heads, "h").groupBy("c", "g", "members", "head").agg(F.count("*").alias("k"))
    near = near.groupBy("c", "g", "members").agg(F.max(F.struct("k", (-F.col("head")).alias("head"))).alias("best"))
    near = near.select("c", "g", "members", (-F.col("best.head")).alias("head"))
    both = near.where("c <> head").select("c", "head").join(large.select("c", F.col("shingles").alias("own")), "c")
    both = both.join(large.select(F.col("c").alias("head"), F.col("shingles").alias("other")), "head").select("c", "head", "own", "other")
    stars = shared_checkpoint(both.mapInArrow(compare, "c long, head long"))
    known = stars.select("c", F.lit(True).alias("is_linked"))
    near = near.join(known, "c", "left").withColumn("is_linked", F.coalesce("is_linked", F.col("c") == F.col("head")))
    counts = near.groupBy("head", "is_linked").agg(F.count("*").alias("n"))
    # blocks of classes that link with one head, if they are many; of all others by their heads
    crowd = F.col("is_linked") & (F.col("n") >= block // 4)
    parts, dealt = F.pmod(F.xxhash64("c"), F.ceil(F.col("n") / block)), F.pmod(F.xxhash64("head"), F.ceil(F.col("members") / block))
    place = F.when(crowd, F.xxhash64(F.lit("linked"), "head", parts)).when(F.col("n") > block, F.xxhash64(F.lit("head"), "head", parts)).otherwise(F.xxhash64("g", dealt))
    seats = shared_checkpoint(near.join(counts, ["head", "is_linked"]).select("c", place.alias("place"), F.when(crowd, F.col("head")).alias("root")))
    held = keys.join(seats, "c")
    reach = held.select("h", F.col("place").alias("other"), F.col("root").alias("root_of")).distinct()
    # two blocks of one head have nothing left to find
    pairs = held.join(reach, "h").where("root is null or root_of is null or root <> root_of").select("c", "place", "other").distinct()
    pairs = pairs.select("c", F.least("place", "other").alias("i"), F.greatest("place", "other").alias("j"), (F.col("place") > F.col("other")).cast("int").alias("side"))
    found = pairs.join(large.select("c", "shingles"), "c").groupBy("i", "j").applyInArrow(against, "a long, b long")
    return stars.select(F.col("c").alias("a"), F.col("head").alias("b")).unionByName(found)


def _edges(ids: np.ndarray, found: list[tuple[int, int]]) -> pa.Table:
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(ids[pairs[:, 0]] if len(pairs) else [], pa.int64()), "b": pa.array(ids[pairs[:, 1]] if len(pairs) else [], pa.int64())})
