"""Near-duplicate removal: SimHash links, checked and completed by the exact Jaccard index.

Texts, A-Z lower-cased, are cut into words; each run of ``shingle`` words is hashed. A text has
a SimHash fingerprint of them, as in ``simhash``, and the set of its hashes. Two texts link
if their sets' Jaccard index is ``similarity`` or more. Every such pair is found or already
connected, and no other pair links.

Texts that can link: under any one order of all shingles, two sets of n and m shingles with that
index share k of the first n - ceil(similarity * n) + k and m - ceil(similarity * m) + k. So a text
is out if, of a prefix with k = n / 10, fewer shingles are in another text's prefix than a
partner's k. The order puts shingles that are common in a sample of rows last; the sample decides
how many texts and pairs are tried, not which are found.

First links: fingerprints with at most ``budget`` differing bits, by the binary-trie self-join,
each checked on the sets. That unites copies with a few changed words. At a similarity of
0.8 fingerprints differ in ten bits of 64 on average, out of reach of any budget that keeps
a trie narrow, so the rest is completed without fingerprints: pairs that share a shingle of their
prefixes for k = 1. At first each row is paired with the four holders of its shingles that come first in
four orders, so a group of n copies gives about 4 n pairs, and no key is a task's burden. Then all
candidates are paired that are not united already; but in a task, of rows that may be near one
component each is paired with the nearest member only. A last pass pairs each row for which that failed
with all it may be near in another component: only there can the number of pairs grow with the square
of a group.
Before a pair counts, a sketch of 1024 parities (but for the first pairs), then one of parities as many as twice the set's size
must allow it, as differing parities never exceed the number of differing shingles; then it is
verified on the whole sets.

Scale: the first pass over the texts writes the prefix shingles (three tenths of all, 8 bytes each)
and the sketches (a quarter of a byte a shingle), not the sets; those are made again from the texts
of verified pairs. The prefix shingles cross the network twice, packed: sorted by hash range, to find
the shared ones, and by text. What follows concerns texts that can link only. Hot shingles are dealt
in pairs of chunks, and there are as many tasks as a bounded number of rows in each needs.
Sets are equal if 128 bits of hash are; shingles are compared by 64-bit hash, so that a set
of n may be off by one in about n**2 / 2**65 cases.

Defined results: texts without words are equal to each other and to nothing else; with fewer
words than a shingle the whole sequence is the only one. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import buffers, by_size, fresh, release, small_enough, tasks_for, work_table
from .components import stars
from .simhash import _labelled, dealt, links, majority, row_key, shingle_hashes

SHINGLE = 5
SIMILARITY = (4, 5)
BUDGET = 3  # differing bits of fingerprints that link at first
SAMPLE = 16  # one row in so many is counted for the order of shingles
COMMON = 200_000  # shingles that the order knows
SKETCH = 16  # words of 64 parities
TASK_ROWS = 1 << 17  # of some 170 bytes
TASK_SHINGLES = 1 << 22  # of 8 bytes
SPARE = 10
LEADERS = 4
_SMALL = 32
_PAIRS = 1 << 20


def in_order(hashes: np.ndarray, counts: np.ndarray, common: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of all texts, each text's in the order of ``level`` and hash, and their numbers."""
    hashes = hashes.astype(np.uint64)
    text = np.repeat(np.arange(len(counts)), counts)
    rank = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, level[at], 0)
    order = np.lexsort((hashes, rank, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.bincount(text[new], minlength=len(counts))


def sketches(items: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each set the parity of its items in each of 64 * SKETCH bins (sets x SKETCH)."""
    bins = 64 * SKETCH
    text = np.repeat(np.arange(len(sizes)), sizes)
    odd = np.bincount(text * bins + (items % np.uint64(bins)).astype(np.int64), minlength=len(sizes) * bins) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, bins), axis=1).view(np.uint64)


def parities(items: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each set the parities of its items in bins, a power of two of at least twice its size."""
    out, at = [], 0
    for n in sizes.tolist():
        bins = max(64, 1 << (2 * n - 1).bit_length()) if n else 64
        out.append(np.packbits((np.bincount((items[at : at + n] & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1).astype(np.uint8)).tobytes())
        at += n
    return out


def differing(a: bytes, b: bytes) -> int:
    """Differing parities of two sets, at the bins of the smaller: never more than their differing items."""
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    while len(x) != len(y):  # the bins of a folded sketch hold the sum of two
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def prefix_lengths(sizes: np.ndarray, similarity: tuple[int, int], spare: int = 0) -> np.ndarray:
    """How many first shingles of two linked sets have one in common at least; with ``spare``, one and
    a ``spare``-th of the set more."""
    num, den = similarity
    return np.where(sizes > 0, sizes - -(-num * sizes // den) + 1 + (sizes // spare if spare else 0), 0)


def least_shared(sizes: np.ndarray, similarity: tuple[int, int], spare: int) -> np.ndarray:
    """Of the longer prefix, how many shingles a set shares with that of any set it links to."""
    num, den = similarity
    return -(-num * sizes // den) // spare + 1


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for b in by_size(batches, "_text", 1 << 20):
        data, o = buffers(b.column("_text"))
        raw = data.tobytes()
        yield b, [raw[s:e] for s, e in zip(o[:-1], o[1:], strict=True)]


def _order(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of a sample, sorted, and the level of each."""
    none = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches):
            h, n = np.unique(in_order(*shingle_hashes(texts, shingle), none, none)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    counts = rows.where(F.pmod("_key", F.lit(SAMPLE)) == 0).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = counts.where("n > 1").orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    return h[order], np.ceil(np.log2(n[order])).astype(np.int64) if len(h) else np.zeros(0, np.int64)


def _digests(items: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """128 bits of hash of each set, as two arrays of longs."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    raw = b"".join(xxhash.xxh3_128_digest(items[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True))
    return list(np.ascontiguousarray(np.frombuffer(raw, np.int64).reshape(-1, 2).T))


def _lists(items: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(items.view(np.int64)))


_WIDE = [f"p{k}" for k in range(SKETCH)]
_ROW = ["id", "doc_id", "key", "h1", "h2", "fp", "size", *_WIDE]


def _sets(shingle: int, similarity: tuple[int, int], held):
    """Of each row a number, the set's hash, fingerprint, size, sketch and prefix shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b, texts in _texts(batches):
            hashes, counts = shingle_hashes(texts, shingle)
            fp = majority(hashes, counts)
            items, sizes = in_order(hashes, counts, *held.value)
            length, start = prefix_lengths(sizes, similarity, SPARE), np.cumsum(sizes) - sizes
            place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start, length)
            numbers = [np.arange(row, row + len(texts)), b.column("_id"), b.column("_key"), *_digests(items, sizes), fp.view(np.int64), sizes, *sketches(items, sizes).view(np.int64).T]
            row += len(texts)
            yield pa.RecordBatch.from_arrays([*(x if isinstance(x, pa.Array) else pa.array(np.ascontiguousarray(x), pa.int64()) for x in numbers), pa.array(parities(items, sizes), pa.binary()), _lists(items[place], length)], [*_ROW, "parities", "prefix"])

    return run


_SHINGLES, _CONTENT, _SHARED = 0, 1, 2
_PARTS = "route long, chunk long, kind int, body binary"


def _part(route: int, chunk: int, kind: int, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([route], pa.int64()), pa.array([chunk], pa.int64()), pa.array([kind], pa.int32()), pa.array([body], pa.binary())], ["route", "chunk", "kind", "body"])


def _packed(ranges: int):
    """Of each chunk of rows (id, size, prefix): its different shingles, sorted, by hash range and byte plane
    by byte plane (the high planes compress well); and, to its own route, what it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            chunk, lists = task << 32 | k, b.column("prefix")
            items, length = lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy()).astype(np.int64)
            h, times = np.unique(items, return_counts=True)
            cuts = np.searchsorted(h >> np.uint64(32), (np.arange(ranges + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges))
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                yield _part(r, chunk, _SHINGLES, np.ascontiguousarray(h[cuts[r] : cuts[r + 1]].view(np.uint8).reshape(-1, 8).T).tobytes())
            head = np.concatenate([[b.num_rows], b.column("id").to_numpy(), b.column("size").to_numpy(), length]).astype("<i8")
            yield _part(chunk, chunk, _CONTENT, head.tobytes() + items.tobytes())
            yield _part(chunk, chunk, _SHARED, h[times > 1].tobytes())
        release()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each chunk the shingles that another chunk has too; what has a chunk's route passes."""
    ranges: dict[int, list[tuple[int, np.ndarray]]] = {}
    for b in batches:
        for route, chunk, kind, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if kind == _SHINGLES:
                ranges.setdefault(route, []).append((chunk, np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)))
            else:
                yield _part(route, chunk, kind, body)
    for route in list(ranges):
        chunks, parts = zip(*ranges.pop(route), strict=True)
        h, source = np.concatenate(parts), np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in parts])
        del parts
        order = np.argsort(h, kind="stable")
        h, source = h[order], source[order]
        same = h[1:] == h[:-1]
        again = np.zeros(len(h), bool)
        again[1:] = same
        again[:-1] |= same
        h, source = h[again], source[again]
        by = np.argsort(source, kind="stable")
        cuts = np.searchsorted(source[by], np.arange(len(chunks) + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            yield _part(chunks[k], chunks[k], _SHARED, h[by[cuts[k] : cuts[k + 1]]].tobytes())
    release()


def _able(similarity: tuple[int, int]):
    """``id`` of the rows that can link, and the ``prefix`` shingles (for k = 1) that others have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[bytes], list[bytes]]] = {}
        for b in batches:
            for chunk, kind, body in zip(*(b.column(c).to_pylist() for c in ("chunk", "kind", "body")), strict=True):
                held.setdefault(chunk, ([], []))[kind == _SHARED].append(body)
        for chunk in list(held):
            (content,), answers = held.pop(chunk)
            n = int(np.frombuffer(content, "<i8", 1)[0])
            ids, size, length = np.frombuffer(content, "<i8", 3 * n, 8).reshape(3, n)
            items = np.frombuffer(content, np.uint64, -1, 8 + 24 * n)
            shared = np.unique(np.frombuffer(b"".join(answers), np.uint64))
            found = np.zeros(len(items), bool)
            if len(shared):
                found = shared[np.minimum(np.searchsorted(shared, items), len(shared) - 1)] == items
            row = np.repeat(np.arange(n), length)
            place = np.arange(len(items)) - np.repeat(np.cumsum(length) - length, length)
            enough = np.bincount(row[found], minlength=n) >= least_shared(size, similarity, SPARE)
            first = found & (place < prefix_lengths(size, similarity)[row]) & enough[row]
            count = np.bincount(row[first], minlength=n)
            able = count > 0
            if able.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ids[able])), _lists(items[first], count[able])], ["able", "prefix"])
        release()

    return run


def _whole(shingle: int, held):
    """The whole set of each text, with its hash, in the order that :func:`_sets` used for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches):
            items, sizes = in_order(*shingle_hashes(texts, shingle), *held.value)
            yield pa.RecordBatch.from_arrays([*map(pa.array, _digests(items, sizes)), _lists(items, sizes)], ["a1", "a2", "items"])

    return run


def least_apart(size: np.ndarray, sketch: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """How many parities of the sets i and j differ; -1 where they cannot have that similarity."""
    num, den = similarity
    a, b = size[i], size[j]
    out = np.full(len(a), -1)
    some = np.flatnonzero(np.minimum(a, b) * den >= num * np.maximum(a, b))
    for at in range(0, len(some), 1 << 16):  # 128 bytes a pair
        part = some[at : at + (1 << 16)]
        apart = np.bitwise_count(sketch[i[part]] ^ sketch[j[part]]).sum(axis=-1, dtype=np.int64)
        out[part] = np.where(apart * (num + den) <= (a[part] + b[part]) * (den - num), apart, -1)
    return out


class Ties:
    """Pairs of one task, each once; and of two nodes that are both paired with one component, no pair.

    A node is tied to its own component ``home`` and to one more, ``leader``: it was paired with a
    member of that. If the pair links, both are one component; if not, the node, which followed, is
    open. Who followed goes with a pair: 1 for the larger node, 2 for the smaller, 3 for both."""

    def __init__(self, node: np.ndarray, root: np.ndarray):
        self.names, first, self.at = np.unique(node, return_index=True, return_inverse=True)
        self.home = np.unique(root[first], return_inverse=True)[1]
        self.members = np.bincount(self.home)
        self.leader = np.full(len(self.names), -1)
        self.held: list[np.ndarray] = []
        self.size = 0

    def untied(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.at[i], self.at[j]
        ha, hb, la, lb = self.home[a], self.home[b], self.leader[a], self.leader[b]
        return ~((ha == hb) | (la == hb) | (lb == ha) | ((la >= 0) & (la == lb)))

    def with_home_of(self, lead: int, rows: np.ndarray) -> np.ndarray:
        """Which rows are of the component of the row ``lead``, or follow it."""
        home, at = self.home[self.at[lead]], self.at[rows]
        return (self.home[at] == home) | (self.leader[at] == home)

    def put(self, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> None:
        """Add the pairs of rows (i, j), but for each node, which follows, only the least apart one with
        a member of a component that has as many members here as its own, or more."""
        order = np.argsort(apart, kind="stable")
        a, b = self.at[i[order]], self.at[j[order]]
        turn = self.members[self.home[a]] < self.members[self.home[b]]
        a, b = np.where(turn, b, a), np.where(turn, a, b)
        one = np.unique(self.home[a] * len(self.names) + b, return_index=True)[1]
        a, b = a[one], b[one]
        self._hold(a, b, np.where(a < b, 1, 2))
        free = self.leader[b] < 0
        self.leader[b[free]] = self.home[a[free]]

    def hold(self, i: np.ndarray, j: np.ndarray) -> None:
        """Add all pairs of rows (i, j); none follows."""
        self._hold(self.at[i], self.at[j], np.zeros(len(i), np.int64))

    def _hold(self, a: np.ndarray, b: np.ndarray, follows: np.ndarray) -> None:
        self.held.append((np.minimum(a, b) * len(self.names) + np.maximum(a, b)) * 4 + follows)
        self.size += len(a)

    def pairs(self) -> pa.RecordBatch:
        """What was added since the last call."""
        every = np.unique(np.concatenate(self.held)) if self.held else np.zeros(0, np.int64)
        self.held, self.size = [], 0
        both, first = np.unique(every // 4, return_index=True)
        follows = np.bitwise_or.reduceat(every % 4, first) if len(first) else every
        n = max(len(self.names), 1)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (self.names[both // n], self.names[both % n], follows)], ["u", "v", "follows"])


def led_pairs(ties: Ties, near, cut: np.ndarray) -> Iterator[None]:
    """Put the pairs of rows of each group (from one ``cut`` to the next) for which ``near`` is not negative, but
    none of two rows that are tied to one component. Stops now and then, for pairs to be taken."""
    width = np.diff(cut)
    of = np.repeat(width, width)
    first, row = np.repeat(cut[:-1], width), np.arange(len(of))
    few = of <= _SMALL

    def put(i: np.ndarray, j: np.ndarray) -> None:
        some = ties.untied(i, j)
        i, j = i[some], j[some]
        apart = near(i, j)
        ok = apart >= 0
        ties.put(i[ok], j[ok], apart[ok])

    star = few & (row > first)
    put(first[star], row[star])
    for d in range(1, _SMALL):
        i = np.flatnonzero(few[:-d] & (first[:-d] == first[d:])) if d < len(first) else first[:0]
        if not len(i):
            break
        put(i, i + d)
        yield
    for lo, hi in zip(cut[:-1][width > _SMALL], cut[1:][width > _SMALL], strict=True):
        rest = np.arange(lo, hi)
        while len(rest) > 1:
            lead, others = rest[0], rest[1:]
            put(np.full(len(others), lead), others)
            hits = ties.with_home_of(lead, others)  # pairs among these are tied
            hits, rest = others[hits], others[~hits]
            step = max(1, _PAIRS // max(len(rest), 1))
            for k in range(0, len(hits) if len(rest) else 0, step):
                part = hits[k : k + step]
                put(np.repeat(part, len(rest)), np.tile(rest, len(part)))
                yield
            yield


def _pairs(similarity: tuple[int, int], second: bool):
    """Candidate pairs of nodes of two components among the rows (shingle, node, component, size,
    sketch) that reach a task; in the ``second`` pass, where rows have an open flag after the
    component, all pairs of which one node at least is open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], axis=1) for b in batches if b.num_rows]
        if not held:
            return
        rows = np.concatenate(held)
        held.clear()
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        rows = rows[new]
        key, node, more = rows[:, 0], rows[:, 1], rows[:, 2:]
        root, is_open = more[:, 0], more[:, 1] > 0 if second else np.ones(len(rows), bool)
        size, sketch = more[:, -1 - SKETCH], np.ascontiguousarray(more[:, -SKETCH:]).view(np.uint64)
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        ties = Ties(node, root)

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out, other = np.full(len(i), -1), np.flatnonzero(root[i] != root[j])
            out[other] = least_apart(size, sketch, i[other], j[other], similarity)
            return out

        def opened() -> Iterator[None]:
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                ours, every = lo + np.flatnonzero(is_open[lo:hi]), np.arange(lo, hi)
                step = max(1, _PAIRS // (hi - lo))
                for k in range(0, len(ours), step):
                    part = ours[k : k + step]
                    i, j = np.repeat(part, hi - lo), np.tile(every, len(part))
                    ok = near(i, j) >= 0
                    ties.hold(i[ok], j[ok])
                    yield

        for _ in opened() if second else led_pairs(ties, near, cut):
            if ties.size > _PAIRS:
                yield ties.pairs()
        if ties.held:
            yield ties.pairs()
        del rows, more, ties
        release()

    return run


def _rooted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``root``: the smallest node of the component that the edges give."""
    roots = stars(edges).select(F.col("u").alias("k"), "root")
    return nodes.join(small_enough(roots, F.lit(16)), nodes["node"] == F.col("k"), "left").withColumn("root", F.coalesce("root", "node")).drop("k")


def components(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, budget: int = BUDGET, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, key, node, root, component_id`` of every row; rows link at a Jaccard index of ``similarity`` (a fraction)."""
    spark = docs.sparkSession
    num, den = similarity
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"), row_key(doc_id, text).alias("_key"))
    held = spark.sparkContext.broadcast(_order(rows, shingle))
    table = work_table(rows.mapInArrow(_sets(shingle, similarity, held), ", ".join([*(f"{n} long" for n in _ROW), "parities binary, prefix array<long>"])), "sets")
    again = table.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("least")).where("c > 1").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "least")
    again = small_enough(work_table(again, "repeated"), F.lit(24))
    known = table.join(again, (table["h1"] == again["g1"]) & (table["h2"] == again["g2"]), "left").withColumn("node", F.coalesce("least", "id"))
    total = table.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0)), F.countDistinct("key"), F.count(F.lit(1))).first()
    repeats = total[1] < total[2]  # of doc_id and text
    n = tasks_for(spark, total[0], TASK_SHINGLES)
    parts = table.select("id", "size", "prefix").mapInArrow(_packed(n), _PARTS)
    parts = parts.repartitionById(n, F.pmod("route", F.lit(n)).cast("int")).mapInArrow(_shared, _PARTS)
    able = work_table(parts.repartition(n, "chunk").mapInArrow(_able(similarity), "able long, prefix array<long>"), "able")
    plain = known.where("node = id").select("node", "key", "h1", "h2", "fp", "size", *_WIDE, "parities")
    nodes = work_table(plain.join(small_enough(able, F.size("prefix") * 8 + 8), F.col("node") == F.col("able")).drop("able"), "nodes")

    def sieved(pairs: DataFrame) -> DataFrame:
        """``pairs`` without those that the parities rule out."""
        slim = nodes.select("node", "size", "parities")
        left, right = (slim.select(F.col("node").alias(f"n{x}"), F.col("size").alias(f"s{x}"), F.col("parities").alias(f"p{x}")) for x in "uv")
        both = pairs.join(left, fresh("u") == fresh("nu")).join(right, fresh("v") == fresh("nv"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                apart = np.array([differing(x, y) for x, y in zip(b.column("pu").to_pylist(), b.column("pv").to_pylist(), strict=True)], np.int64)
                sizes = b.column("su").to_numpy() + b.column("sv").to_numpy()
                yield b.select(["u", "v"]).filter(pa.array(apart * (num + den) <= sizes * (den - num)))

        return work_table(both.select("u", "v", "su", "sv", "pu", "pv").mapInArrow(run, "u long, v long"), "sieved")

    def verified(pairs: DataFrame) -> DataFrame:
        """``pairs`` (a work table) with ``near``: whether the sets have that similarity."""
        ends = pairs.select(F.explode(F.array("u", "v")).alias("n")).distinct()
        named = small_enough(work_table(nodes.select("node", "key", "h1", "h2").join(ends, F.col("node") == F.col("n"), "left_semi"), "named"), F.lit(32))
        whole = rows.join(named.select(F.col("key").alias("t")), rows["_key"] == F.col("t"), "left_semi").mapInArrow(_whole(shingle, held), "a1 long, a2 long, items array<long>")
        ours = whole.join(named, (F.col("a1") == named["h1"]) & (F.col("a2") == named["h2"])).select("node", "items")
        ours = work_table(ours.dropDuplicates(["node"]) if repeats else ours, "pairsets")
        left, right = (ours.select(F.col("node").alias(f"n{x}"), F.col("items").alias(f"items{x}")) for x in "uv")
        both = pairs.join(left, fresh("u") == fresh("nu")).join(right, fresh("v") == fresh("nv"))
        near = F.size(F.array_intersect("itemsu", "itemsv")) * (num + den) >= (F.size("itemsu") + F.size("itemsv")) * num
        return work_table(both.select("u", "v", near.alias("near")), "verified")

    # the trie's links, from one node of each fingerprint
    least = work_table(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("c")), "fingerprints")
    found = links(least.select("fp"), least.count(), budget)
    left, right = (least.select(F.col("fp").alias(f"{x}fp"), F.col("first").alias(x)) for x in "uv")
    apart = found.withColumnsRenamed({"u": "a", "v": "b"}).join(left, fresh("a") == fresh("ufp")).join(right, fresh("b") == fresh("vfp")).select("u", "v")
    same = nodes.select("node", F.col("fp").alias("f")).join(least.where("c > 1"), F.col("f") == F.col("fp")).where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))

    # what fingerprints cannot see: at first, pairs with a few nodes of each shared shingle
    counts = work_table(nodes.select(F.explode("prefix").alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")

    def rows_of(rooted: DataFrame, more: list[str]) -> DataFrame:
        return rooted.select(F.explode("prefix").alias("fp"), "node", *more)

    met = rows_of(nodes, ["size"])
    lead = met.groupBy(F.col("fp").alias("lfp")).agg(*[F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("order"), "node", "size")).alias(f"l{k}") for k in range(LEADERS)])
    led = met.join(lead, fresh("fp") == fresh("lfp")).select("node", "size", F.explode(F.array(*(f"l{k}" for k in range(LEADERS)))).alias("l"))
    led = led.where((F.col("node") != F.col("l.node")) & (F.least("size", "l.size") * den >= F.greatest("size", "l.size") * num))
    led = led.select(F.col("node").alias("u"), F.col("l.node").alias("v"))

    begun = apart.unionByName(same).unionByName(led).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    begun = work_table(begun, "pairs")
    edges = verified(sieved(begun)).where("near").select("u", "v")

    def candidates(rooted: DataFrame, shared: DataFrame, second: bool) -> DataFrame:
        total = shared.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        n = tasks_for(spark, total, TASK_ROWS)
        share = max(total / n, 400)
        chunks = {(0, r.fp % 2**64): int(np.ceil(r.c / (1.25 * share))) for r in shared.where(F.col("c") > 2.5 * share).collect()}  # at most 0.4 n
        met = rows_of(rooted, [*(["root", "open"] if second else ["root"]), "size", *_WIDE])
        if second:  # only shingles of open rows
            only = small_enough(shared.select(F.col("fp").alias("h")), F.lit(8))
            met = met.join(only, met["fp"] == only["h"], "left_semi")
        return dealt(met, 0, chunks, n).mapInArrow(_pairs(similarity, second), "u long, v long, follows long").groupBy("u", "v").agg(F.bit_or("follows").alias("follows"))

    led_to = work_table(candidates(_rooted(edges, nodes), counts, False), "pairs")
    more = work_table(led_to.join(begun, ["u", "v"], "left_anti").select("u", "v"), "pairs")
    edges = edges.unionByName(verified(sieved(more)).where("near").select("u", "v"))
    failed = work_table(led_to.join(edges, ["u", "v"], "left_anti"), "failed")
    if not failed.isEmpty():
        rooted = _rooted(edges, nodes)
        of = rooted.select("node", "root")
        ru, rv = (of.select(F.col("node").alias(f"k{x}"), F.col("root").alias(f"r{x}")) for x in "uv")
        between = failed.join(ru, fresh("u") == fresh("ku")).join(rv, fresh("v") == fresh("kv")).where("ru <> rv")
        who = F.array_compact(F.array(F.when(F.col("follows").bitwiseAND(2) > 0, F.col("u")), F.when(F.col("follows").bitwiseAND(1) > 0, F.col("v"))))
        opened = small_enough(work_table(between.select(F.explode(who).alias("o")).distinct(), "open"), F.lit(8))
        mine = nodes.join(opened, nodes["node"] == opened["o"], "left_semi").select(F.explode("prefix").alias("fp")).distinct()
        shared = work_table(counts.join(mine, "fp", "left_semi"), "shared")
        rooted = rooted.join(opened, rooted["node"] == opened["o"], "left").withColumn("open", F.col("o").isNotNull().cast("long"))
        more = candidates(rooted, shared, True).select("u", "v").join(begun.unionByName(more), ["u", "v"], "left_anti")
        edges = edges.unionByName(verified(sieved(more)).where("near").select("u", "v"))
    return _labelled(known.select("doc_id", "key", "node"), edges)


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component of :func:`components`: the one with
    the smallest doc_id (rows without come last, ties by hash). Rows that repeat doc_id and
    text are one document."""
    rows = work_table(components(docs, shingle, similarity, doc_id=doc_id, text=text).select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key").alias("row")), "members")
    first = rows.groupBy(F.col("root").alias("r")).agg(F.min("row").alias("first"))
    gone = rows.join(first, fresh(rows["root"]) == fresh(first["r"])).where("row <> first").select(F.col("row.doc_id").alias("__id"), F.col("row.key").alias("__gone")).distinct()
    gone = small_enough(work_table(gone, "gone"), F.lit(16))
    return docs.join(gone, (row_key(doc_id, text) == gone["__gone"]) & docs[f"`{doc_id}`"].cast("long").eqNullSafe(gone["__id"]), "left_anti")
