"""SimHash fingerprints and their near-duplicate components by a binary-trie self-join.

Fingerprint: the text, A-Z lower-cased, is cut into words; each run of ``shingle`` words,
repeats included, is hashed by XXH64 (seed 42); a bit of the fingerprint is set if more than
half of the hashes have it. Two fingerprints link if at most ``budget`` bits differ.

Join: the 64 bits form ``budget + 1`` blocks; two linked fingerprints agree on one of them
at least. Rotating each block to the front gives tries whose first levels must agree. A task
walks its tries in pairs of nodes, starting with each subtree against itself: it carries
the bits in which the two nodes differ, drops a pair once they exceed the budget or once
both subtrees are known to be one component, and yields a spanning forest, never all pairs.

Scale: only distinct fingerprints are joined (copies collapse before that), each in
``budget + 1`` rows of 17 bytes. A block value with more rows than a few tasks' share is cut
into chunks by hash and each pair of chunks is a task of its own, so no task gets more than
a bounded number of rows and no link is lost. The list of such values is bounded by the
number of partitions. Components are found by distributed star contraction.

Removal of near copies (``near_dedup``) starts from the same join on fingerprints of five-word
shingles; ``jaccard`` checks its links by the exact index and adds those it cannot see.

Defined results: a text without words (null, empty, blanks) has fingerprint zero and links
like any other; with fewer words than a shingle the whole sequence is the only shingle. A
row with a null doc_id takes part; the smallest doc_id ignores nulls. Repeated rows share
the result. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import buffers, by_size, fresh, tasks_for, work_table
from ._words import mix
from .components import stars

SEED = 42
BITS = 64
TASK_ROWS = 1 << 20  # of 17 bytes


def shingle_hashes(texts: list[bytes], shingle: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, one after the other, and how many each text has."""
    digests, counts = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.lower().split()  # of bytes: A-Z only, and exactly space and 0x09-0x0D
        if not words:
            continue
        runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        digests.append(b"".join(map(xxhash.xxh64_digest, runs, repeat(seed))))
        counts[k] = len(digests[-1]) // 8
    return np.frombuffer(b"".join(digests), ">u8"), counts


def majority(hashes: np.ndarray, counts: np.ndarray, at_once: int = 1 << 18) -> np.ndarray:
    """The fingerprint of each text from its shingles' hashes, ``at_once`` of which are expanded to bits at a time."""
    text = np.repeat(np.arange(len(counts)), counts)
    sums = np.zeros((len(counts), BITS), np.int64)
    for a in range(0, len(hashes), at_once):
        bits = np.unpackbits(np.ascontiguousarray(hashes[a : a + at_once], ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        own, first = np.unique(text[a : a + at_once], return_index=True)
        sums[own] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * sums > np.asarray(counts)[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)


def fingerprints(texts: list[bytes], shingle: int, seeds: tuple[int, ...] = (SEED,)) -> np.ndarray:
    """A 64-bit fingerprint of each text for each seed (texts x seeds)."""
    return np.stack([majority(*shingle_hashes(texts, shingle, seed)) for seed in seeds], axis=1)


def fingerprint(docs: DataFrame, shingle: int, seeds: tuple[int, ...] = (SEED,), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``key`` (hash of doc_id and text) and for each seed ``fp0, fp1, ...`` (the bits as a long)."""
    names = [f"fp{k}" for k in range(len(seeds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "_text", 1 << 20):
            data, o = buffers(b.column("_text"))
            raw = data.tobytes()
            fp = fingerprints([raw[s:e] for s, e in zip(o[:-1], o[1:], strict=True)], shingle, seeds)
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_key"), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in fp.T)], ["doc_id", "key", *names])

    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"), row_key(doc_id, text).alias("_key"))
    return rows.mapInArrow(run, ", ".join(["doc_id long", "key long", *(f"{n} long" for n in names)]))


def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


class Forest:
    """Labels of keys by the smallest linked key, with the test whether a range is one component."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self._changes()

    def _changes(self) -> None:
        self.changes = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        moved = False
        while True:
            a, b = self.label[i], self.label[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up
            moved = True
        if moved:
            self._changes()

    def joined(self, lo1, hi1, lo2, hi2) -> np.ndarray:
        c = self.changes
        return (c[lo1] == c[hi1 - 1]) & (c[lo2] == c[hi2 - 1]) & (self.label[lo1] == self.label[lo2])


def trie_links(keys: np.ndarray, agree: int, budget: int, at_once: int = 1 << 16) -> np.ndarray:
    """Labels (index of the smallest key of the component) of sorted, distinct 64-bit keys that
    link if their first ``agree`` bits are equal and at most ``budget`` of the others differ."""
    n = len(keys)
    forest = Forest(n)
    if n < 2:
        return forest.label
    top = keys >> np.uint64(BITS - agree)
    cut = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1], [True]]))
    lo, hi = cut[:-1], cut[1:]
    big = hi - lo > 1
    lo, hi = lo[big], hi[big]
    stack = [(agree, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        depth, lo1, hi1, lo2, hi2, err = stack.pop()
        if len(lo1) > at_once:
            stack.append((depth, *(x[at_once:] for x in (lo1, hi1, lo2, hi2, err))))
            lo1, hi1, lo2, hi2, err = (x[:at_once] for x in (lo1, hi1, lo2, hi2, err))
        live = ~forest.joined(lo1, hi1, lo2, hi2)
        lo1, hi1, lo2, hi2, err = (x[live] for x in (lo1, hi1, lo2, hi2, err))
        single = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)  # two leaves: the bits below differ or not
        if single.any():
            i, j = lo1[single], lo2[single]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            forest.link(i[near], j[near])
            lo1, hi1, lo2, hi2, err = (x[~single] for x in (lo1, hi1, lo2, hi2, err))
        if not len(lo1):
            continue
        bit = np.uint64(BITS - 1 - depth)

        def middle(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            """Where the keys with the next bit set begin."""
            return np.clip(np.searchsorted(keys, ((keys[lo] >> bit) | np.uint64(1)) << bit), lo, hi)

        m1, m2 = middle(lo1, hi1), middle(lo2, hi2)
        same, more = lo1 == lo2, err + 1
        pairs = [(lo1, m1, lo2, m2, err, None), (m1, hi1, m2, hi2, err, None), (lo1, m1, m2, hi2, more, None), (m1, hi1, lo2, m2, more, ~same)]
        parts = []
        for a, b, c, d, e, only in pairs:
            ok = (b > a) & (d > c) & (e <= budget) & ~((a == c) & (b - a == 1))
            if only is not None:
                ok &= only
            parts.append([x[ok] for x in (a, b, c, d, e)])
        # pairs without a new difference come last and are taken first: what they unite prunes the rest
        for part in ([np.concatenate(x) for x in zip(*parts[2:], strict=True)], [np.concatenate(x) for x in zip(*parts[:2], strict=True)]):
            if len(part[0]):
                stack.append((depth + 1, *part))
    return forest.label


def _rotate(fp: np.ndarray, by: int) -> np.ndarray:
    by %= BITS
    return fp if by == 0 else (fp << np.uint64(by)) | (fp >> np.uint64(BITS - by))


def _blocks(budget: int) -> list[tuple[int, int]]:
    """Where each of the budget + 1 blocks begins, and its width."""
    cuts = [BITS * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _routes(budget: int, hot: dict[tuple[int, int], int]):
    """Each row (a fingerprint, then what goes with it) under each block of the fingerprint;
    rows of a hot block value go to every pair of chunks they are in."""
    blocks = _blocks(budget)
    by_block = [{v: k for (b, v), k in hot.items() if b == n} for n in range(len(blocks))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, *rest = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)
            names = ["route", "block", "key", *batch.schema.names[1:]]
            place = mix(rest[0]) if rest else fp  # rows that carry a node are in the same chunk under each value
            for n, (at, width) in enumerate(blocks):
                key = _rotate(fp, at)
                value = key >> np.uint64(BITS - width)
                route = mix(value * np.uint64(len(blocks)) + np.uint64(n))
                many = np.array(sorted(by_block[n]), np.uint64)
                in_hot = np.isin(value, many) if len(many) else np.zeros(len(value), bool)
                parts = [(route[~in_hot], np.flatnonzero(~in_hot))]
                for v, k in by_block[n].items():
                    own = np.flatnonzero(value == np.uint64(v))
                    if len(own):
                        chunk = (place[own] if rest else mix(_rotate(place[own], at))) % np.uint64(k)
                        first = mix(np.array([v * len(blocks) + n], np.uint64))[0]
                        for j in range(k):
                            a, b = np.minimum(chunk, np.uint64(j)), np.maximum(chunk, np.uint64(j))
                            parts.append((mix(first + a * np.uint64(k) + b + np.uint64(1)), own))
                r, row = (np.concatenate(x) for x in zip(*parts, strict=True))
                columns = [pa.array(x[row].view(np.int64)) for x in (key, *rest)]
                yield pa.RecordBatch.from_arrays([pa.array(r.view(np.int64)), pa.array(np.full(len(r), n, np.int8)), *columns], names)

    return run


def _join(budget: int):
    """Edges between the fingerprints that reach a task."""
    blocks = _blocks(budget)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in blocks]
        for batch in batches:
            block, key = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for n in range(len(blocks)):
                held[n].append(key[block == n])
        for n, (at, width) in enumerate(blocks):
            if not held[n]:
                continue
            keys = np.unique(np.concatenate(held[n]))
            held[n] = []
            names = _rotate(keys, BITS - at)
            label = trie_links(keys, width, budget)
            moved = np.flatnonzero(label != np.arange(len(label)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(names[x].view(np.int64)) for x in (moved, label[moved])], ["u", "v"])

    return run


def links(distinct: DataFrame, count: int, budget: int) -> DataFrame:
    """Edges (u, v) that connect the fingerprints ``fp`` of ``distinct`` as all links together do.

    A task gets about ``TASK_ROWS`` rows at most, at any number of rows: there are as many
    tasks as that needs, and a hot block value is dealt in pairs of chunks."""
    blocks = _blocks(budget)
    n = tasks_for(distinct.sparkSession, count * len(blocks), TASK_ROWS)
    share = max(count * len(blocks) / n, 400)
    values = [F.struct(F.lit(k).alias("b"), F.shiftrightunsigned(F.when(F.lit(at) == 0, F.col("fp")).otherwise(F.shiftleft("fp", at)), BITS - width).alias("v")) for k, (at, width) in enumerate(blocks)]
    hot = distinct.select(F.explode(F.array(*values)).alias("x")).groupBy("x.b", "x.v").count().where(F.col("count") > 2.5 * share)
    chunks = {(r.b, r.v): int(np.ceil(r["count"] / (1.25 * share))) for r in hot.collect()}  # at most 0.4 n values
    return dealt(distinct.select("fp"), budget, chunks, n).mapInArrow(_join(budget), "u long, v long")


def dealt(rows: DataFrame, budget: int, chunks: dict[tuple[int, int], int], n: int) -> DataFrame:
    """To ``n`` tasks ``block, key`` and what follows ``fp``: rows that agree on a block meet in one task, and those
    of a value in ``chunks`` (block and value to a number of chunks) by pairs of chunks."""
    rest = rows.columns[1:]
    routed = rows.mapInArrow(_routes(budget, chunks), ", ".join(["route long, block tinyint, key long", *(f"{c} long" for c in rest)]))
    return routed.repartition(n, "route").select("block", "key", *rest)


def _edges(table: DataFrame, name: str, budget: int) -> DataFrame:
    """Edges between nodes ``fp0`` that the fingerprints ``name`` imply: equal ones and linked ones."""
    if name == "fp0":
        nodes = work_table(table.select(F.col("fp0").alias("fp")).distinct(), "distinct")
        return links(nodes, nodes.count(), budget)
    pairs = work_table(table.select("fp0", name).distinct(), "pairs")
    least = work_table(pairs.groupBy(F.col(name).alias("fp")).agg(F.min("fp0").alias("node")), "distinct")
    equal = pairs.join(least, fresh(pairs[name]) == fresh(least["fp"])).select(F.col("fp0").alias("u"), F.col("node").alias("v"))
    found = links(least.select("fp"), least.count(), budget)
    left, right = (least.select(F.col("fp").alias(f"{x}fp"), F.col("node").alias(f"{x}node")) for x in "uv")
    linked = found.join(left, found["u"] == left["ufp"]).join(right, found["v"] == right["vfp"]).select(F.col("unode").alias("u"), F.col("vnode").alias("v"))
    return equal.where("u <> v").unionByName(linked)


def components(docs: DataFrame, shingle: int = 5, budget: int = 3, seeds: tuple[int, ...] = (SEED,), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, key, fp, root, component_id`` of every row: the first seed's fingerprint, the
    component's smallest one, and its smallest doc_id. Rows link if the fingerprints of any
    seed do; each seed more finds links that another's rounding misses."""
    table = work_table(fingerprint(docs, shingle, seeds, doc_id, text), "fingerprints")
    edges = [_edges(table, f"fp{k}", budget) for k in range(len(seeds))]
    every = edges[0]
    for more in edges[1:]:
        every = every.unionByName(more)
    return _labelled(table.withColumnRenamed("fp0", "node"), every).withColumnRenamed("node", "fp")


def _labelled(table: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc_id, key, node, root, component_id`` of the rows of ``table`` (doc_id, key, node)."""
    roots = stars(edges)
    least = table.groupBy("node").agg(F.min("doc_id").alias("least"))
    root = F.coalesce("root", "node").alias("root")
    info = work_table(least.join(roots, fresh(least["node"]) == fresh(roots["u"]), "left").select("node", root, "least"), "nodes")
    member = roots.select(F.col("root").alias("r")).distinct()
    lowest = info.join(member, fresh(info["root"]) == fresh(member["r"]), "left_semi").groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component"))
    named = info.join(lowest, fresh(info["root"]) == fresh(lowest["r"]), "left").select(F.col("node").alias("k"), "root", F.when(F.col("r").isNull(), F.col("least")).otherwise(F.col("component")).alias("component_id"))
    return table.join(named, fresh(table["node"]) == fresh(named["k"])).select("doc_id", "key", "node", "root", "component_id")


def near_dedup(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = (4, 5), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near copies: the trie's links, checked and completed by the exact Jaccard
    index of the shingle sets (:func:`cloakframe.llm.jaccard.near_dedup`)."""
    from . import jaccard

    return jaccard.near_dedup(docs, shingle, similarity, doc_id, text)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return components(docs, shingle=3, budget=3).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
