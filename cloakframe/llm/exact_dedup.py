"""Exact duplicates by counting quotient filters.

Each partition puts the 64-bit fingerprints of its texts into a counting quotient filter
and sends it on in segments of the quotient range; the filters of a segment merge by their
sorted remainders without loss. Fingerprints whose merged count is above one route their
rows to byte verification, a grouping on the text itself. Rows of other fingerprints are
unique and never leave their partition.

Scale: a row costs about nine bytes of shuffle for the filter. Texts move only if their
fingerprint repeats, and copies collapse before the shuffle (partial aggregation), so one
group with a third of all rows sends one row per task. The repeated fingerprints and the
verified groups are broadcast while their counted rows and bytes are within a bound, and
joined by shuffle (adaptive execution splits a hot key) beyond.

Defined results: a null text counts as empty; texts are equal when identical. Of equal
texts the row with the largest doc_id stays; a null doc_id is smaller than any. Rows that
repeat both doc_id and text are all flagged as kept in :func:`flag`, and :func:`dedup`
leaves one of them. An empty table gives an empty result. Other columns pass through,
whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import partitions, small_enough, work_table



class CountingQuotientFilter:
    """Sorted 64-bit fingerprints split into quotient and remainder, with counts.

    ``occupied`` has a bit for each quotient with a run, ``runend`` a bit for the last slot
    of each run; a slot holds a remainder or, where ``counter`` is set, a digit in base
    2**16 of the count minus one of the remainder before it. Nothing is lost: the
    fingerprints and counts come back exactly.
    """

    def __init__(self, qbits: int, occupied: np.ndarray, runend: np.ndarray, counter: np.ndarray, slots: np.ndarray):
        self.qbits, self.occupied, self.runend, self.counter, self.slots = qbits, occupied, runend, counter, slots

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        if counts is None:
            fp, n = np.unique(fingerprints.astype(np.uint64, copy=False), return_counts=True)
        else:
            order = np.argsort(fingerprints, kind="stable")  # merges runs that are sorted, in linear time
            fp, n = fingerprints[order].astype(np.uint64, copy=False), counts[order]
            if len(fp):
                new = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
                fp, n = fp[new], np.add.reduceat(n, new)
        qbits = max(1, int(len(fp)).bit_length())
        quotient = (fp >> np.uint64(64 - qbits)).astype(np.int64)
        remainder = fp & np.uint64((1 << (64 - qbits)) - 1)
        occupied = np.zeros(1 << qbits, bool)
        occupied[quotient] = True
        extra = n.astype(np.int64) - 1
        digits = np.zeros(len(fp), np.int64)
        rest = extra.copy()
        while rest.any():
            digits += rest > 0
            rest >>= 16
        at = np.cumsum(1 + digits) - (1 + digits)
        total = int((1 + digits).sum())
        slots, counter, runend = np.zeros(total, np.uint64), np.ones(total, bool), np.zeros(total, bool)
        slots[at], counter[at] = remainder, False
        for k in range(int(digits.max()) if len(digits) else 0):
            has = digits > k
            slots[at[has] + 1 + k] = (extra[has] >> (16 * k)) & 0xFFFF
        if len(fp):
            last = np.concatenate([quotient[1:] != quotient[:-1], [True]])
            runend[(at + digits)[last]] = True
        return cls(qbits, occupied, runend, counter, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their counts."""
        head = np.flatnonzero(~self.counter)
        if not len(head):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        run = np.cumsum(self.runend) - self.runend
        quotient = np.flatnonzero(self.occupied)[run[head]].astype(np.uint64)
        fp = (quotient << np.uint64(64 - self.qbits)) | self.slots[head]
        owner = np.cumsum(~self.counter) - 1
        place = np.arange(len(self.slots)) - head[owner]
        digit = np.where(self.counter, self.slots, 0).astype(np.int64) << (16 * np.maximum(place - 1, 0))
        return fp, 1 + np.add.reduceat(digit, head)

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """One filter with the summed counts: the filters' sorted fingerprints are merged, none is hashed again."""
        both = [f.items() for f in filters]
        return cls.build(np.concatenate([f for f, _ in both]) if both else np.zeros(0, np.uint64), np.concatenate([n for _, n in both]) if both else np.zeros(0, np.int64))

    def to_bytes(self) -> bytes:
        width = (64 - self.qbits + 7) // 8
        width = max(width, 2)
        head = np.array([self.qbits, len(self.slots), width], np.int64).tobytes()
        slots = np.ascontiguousarray(self.slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
        return head + np.packbits(self.occupied).tobytes() + np.packbits(self.runend).tobytes() + np.packbits(self.counter).tobytes() + slots.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        qbits, n, width = (int(x) for x in np.frombuffer(raw, np.int64, 3))
        at, bits = 24, []
        for size in (1 << qbits, n, n):
            step = (size + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(raw, np.uint8, step, at), count=size).astype(bool))
            at += step
        slots = np.zeros((n, 8), np.uint8)
        slots[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
        return cls(qbits, *bits, slots.view("<u8").reshape(-1).astype(np.uint64))


_SEGMENTS = pa.schema([("segment", pa.int32()), ("filter", pa.binary())])
_FINGERPRINTS = pa.schema([("fingerprint", pa.int64())])


def _segment_of(fp: np.ndarray, n: int) -> np.ndarray:
    return ((fp >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _build(segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches if b.num_rows]
        if not seen:
            return
        fp, n = np.unique(np.concatenate(seen), return_counts=True)
        segment = _segment_of(fp, segments)
        cuts = np.searchsorted(segment, np.arange(segments + 1, dtype=np.uint64))
        for s in range(segments):
            if cuts[s] < cuts[s + 1]:
                part = CountingQuotientFilter.build(fp[cuts[s] : cuts[s + 1]], n[cuts[s] : cuts[s + 1]])
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part.to_bytes()], pa.binary())], schema=_SEGMENTS)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    filters: dict[int, list[CountingQuotientFilter]] = defaultdict(list)
    for b in batches:
        for s, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            filters[s].append(CountingQuotientFilter.from_bytes(raw))
    for s in list(filters):
        fp, n = CountingQuotientFilter.merge(filters.pop(s)).items()
        yield pa.RecordBatch.from_arrays([pa.array(fp[n > 1].view(np.int64))], schema=_FINGERPRINTS)


def repeated_fingerprints(texts: DataFrame, text: str = "text") -> DataFrame:
    """The fingerprints that more than one row of ``texts`` has."""
    segments = partitions(texts.sparkSession)
    fp = texts.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("fingerprint"))
    parts = fp.mapInArrow(_build(segments), "segment int, filter binary")
    return parts.repartition(segments, "segment").mapInArrow(_repeated, "fingerprint long")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Verified groups of two and more equal texts: ``_fp, _sha, keep_id, group_size``."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_fp", F.xxhash64("_text"))
    repeated = small_enough(work_table(repeated_fingerprints(docs, text), "repeated"), F.lit(8))
    routed = rows.join(repeated, rows["_fp"] == repeated["fingerprint"], "left_semi")
    return (
        routed.groupBy("_text").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.xxhash64("_text").alias("_fp"), F.sha2("_text", 256).alias("_sha"), "keep_id", "group_size")
    )


def flag(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``_row`` (a struct of its columns) with ``text_sha256,
    keep_id, group_size, kept``."""
    found = small_enough(work_table(groups(docs, doc_id, text), "groups"), F.lit(112))
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.xxhash64(plain).alias("_key"), F.sha2(plain, 256).alias("text_sha256"), F.col(doc_id).alias("_id"))
    joined = rows.join(found, (rows["_key"] == found["_fp"]) & (rows["text_sha256"] == found["_sha"]), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return joined.select("_row", "_id", "text_sha256", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")).withColumn("kept", F.col("_id").eqNullSafe(F.col("keep_id")))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts."""
    flagged = flag(docs, doc_id, text).where("kept")
    single = flagged.where("group_size = 1").select("_row.*")
    chosen = flagged.where("group_size > 1").dropDuplicates(["text_sha256", "_id"]).select("_row.*")
    return single.unionByName(chosen)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return flag(docs).select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM (
  SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
)
"""
