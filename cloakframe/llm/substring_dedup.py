"""Repeated passages: every window of ``width`` words, hashed and counted over the corpus.

A word is a run of characters other than space and 0x09-0x0D. Two passes do the same with
different hashes. The first looks for candidates by Rabin-Karp hashes (48 of 64 bits) of all windows,
made in numpy. The second verifies: of all windows inside the candidates' intervals it takes
a 128-bit BLAKE2b digest of the words themselves, so no hash of the first pass decides.

A pass handles texts in chunks of a few MB. A chunk sorts its hashes and sends each distinct one
once, in packed form, to the task that owns its hash range; that task finds the hashes of
more than one place and answers with the places, by chunk. Overlapping repeated windows
merge into maximal intervals, which are removed from the text.

Scale: ten bytes a window cross the network before compression (windows that a chunk has
twice: once a chunk, without a place) and twenty a candidate; answers take four bytes a repeated
window, intervals a few bytes a text. There are as many hash ranges as keep the texts of one at
``RANGE_BYTES``, so a task's share does not grow with the corpus. A passage in a third of all
documents is one entry a chunk. Texts are not shuffled while the intervals, counted first,
are small enough to broadcast; beyond that the join on the text's digest shuffles them and
adaptive execution splits hot digests. Chunk ids are partition and ordinal of a scan, so a
retried task repeats them. One text is never split: a task holds some forty bytes a word of it.

Defined results: a null text has no words and its kept text is empty; kept words are joined
by one space. Windows are judged on the input. Repeated rows are copies of each other, so
their windows count as repeated. Texts shorter than a window lose nothing. An empty table
gives an empty result. Other columns pass through; columns named as results (in any case) are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import _words
from ._common import buffers, by_size, others, small_enough, tasks_for, work_table

CHUNK = 4 << 20
RANGE_BYTES = 32 << 20  # of text a hash range
_BASE = 0xA24BAED4963EE407
_NO_PLACE = np.uint32(0xFFFFFFFF)
_HASHES, _CHUNK, _PLACES = 0, 1, 2
_DDL = "route long, chunk long, kind int, body binary"


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every run of ``width`` word hashes, by doubling: the hash of two
    neighbouring runs is left * P**len(right) + right, modulo 2**64."""
    out, have, run, length = None, 0, words, 1
    rest = width
    while rest:
        n = len(words) - have - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        if rest & 1:
            out = run if out is None else out[:n] * np.uint64(pow(_BASE, length, 2**64)) + run[have : have + n]
            have += length
        rest >>= 1
        if rest:
            run = run[: len(run) - length] * np.uint64(pow(_BASE, length, 2**64)) + run[length:]
            length *= 2
    return _words.mix(out)


def window_digests(words: list[bytes], starts: np.ndarray, width: int) -> np.ndarray:
    """128 bits of the words of each window (n x 2)."""
    raw = b"".join(hashlib.blake2b(b" ".join(words[i : i + width]), digest_size=16).digest() for i in starts.tolist())
    return np.frombuffer(raw, "<u8").reshape(-1, 2)


def _pack(hashes: np.ndarray, places: np.ndarray) -> bytes:
    """Sorted hashes (n x words) byte plane by byte plane (the high planes compress well), then places.
    Of a single word the two lowest planes, which are zero, are left out."""
    planes = np.ascontiguousarray(hashes.astype("<u8", copy=False).view(np.uint8).reshape(len(hashes), -1).T)
    return planes[2 if hashes.shape[1] == 1 else 0 :].tobytes() + places.astype("<u4", copy=False).tobytes()


def _unpack(body: bytes, words: int) -> tuple[np.ndarray, np.ndarray]:
    wide = 6 if words == 1 else 8 * words
    n = len(body) // (wide + 4)
    planes = np.zeros((8 * words, n), np.uint8)
    planes[8 * words - wide :] = np.frombuffer(body, np.uint8, wide * n).reshape(wide, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(n, words), np.frombuffer(body, "<u4", n, wide * n)


def _sorted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of hashes (n x words), and where an equal one follows."""
    order = np.argsort(h[:, 0], kind="stable") if h.shape[1] == 1 else np.lexsort(h.T[::-1])
    s = h[order]
    return order, (s[1:] == s[:-1]).all(axis=1)


def _row(route: int, chunk: int, kind: int, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([route], pa.int64()), pa.array([chunk], pa.int64()), pa.array([kind], pa.int32()), pa.array([body], pa.binary())], ["route", "chunk", "kind", "body"])


def _inside(edges: list[bytes | None], first: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Places of the windows that lie in the intervals of their text."""
    out = [np.zeros(0, np.int64)]
    for found, a in zip(edges, first.tolist(), strict=True):
        e = np.frombuffer(found or b"", "<u4").astype(np.int64).reshape(-1, 2)
        out += [a + np.arange(x, y - width + 1) for x, y in e.tolist()]
    return np.concatenate(out)


def _hash_chunks(width: int, ranges: int, size: int, verify: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, batch in enumerate(by_size(batches, "_text", size)):
            chunk = task << 32 | k
            data, starts = buffers(batch.column("_text"))
            raw = data.tobytes()
            if verify:
                texts = [raw[a:b].split() for a, b in zip(starts[:-1], starts[1:], strict=True)]
                first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                total, n = int(first[-1]), np.diff(first)
                place = _inside(batch.column("_candidates").to_pylist(), first[:-1], n, width)
                h = window_digests([w for t in texts for w in t], place, width)
            else:
                w = _words.split(data, starts)
                h, first = window_hashes(w.hash, width), w.first
                total, n = len(w.hash), np.diff(first)
                # a window lies in one text: it begins width words before the text's end at the latest
                valid = np.zeros(total + 1, np.int32)
                long = n >= width
                np.add.at(valid, first[:-1][long], 1)
                np.add.at(valid, first[1:][long] - width + 1, -1)
                place = np.flatnonzero(np.cumsum(valid)[: len(h)] > 0)
                h = (h[place] >> np.uint64(16) << np.uint64(16))[:, None]
            order, same = _sorted(h)
            h, place = h[order], place[order].astype(np.uint32)
            new = np.concatenate([[True], ~same]) if len(h) else np.zeros(0, bool)
            again = np.zeros(len(h), bool)
            again[1:] = ~new[1:]
            again[:-1] |= ~new[1:]
            flagged = np.zeros(total, bool)
            flagged[place[again]] = True
            h, place = h[new], np.where(again, _NO_PLACE, place)[new]
            cuts = np.searchsorted(h[:, 0] >> np.uint64(32), (np.arange(ranges + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges))
            for r in range(ranges):
                if cuts[r] < cuts[r + 1]:
                    yield _row(r, chunk, _HASHES, _pack(h[cuts[r] : cuts[r + 1]], place[cuts[r] : cuts[r + 1]]))
            has = np.flatnonzero(n >= width)
            keys = b"".join(hashlib.sha256(raw[starts[i] : starts[i + 1]]).digest() for i in has)
            head = np.concatenate([[len(has), total], first[:-1][has], n[has]]).astype("<u4").tobytes()
            yield _row(chunk, chunk, _CHUNK, head + keys + zlib.compress(np.packbits(flagged).tobytes(), 1))

    return run


def _find_repeated(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for batch in batches:
            for route, chunk, kind, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == _HASHES:
                    ranges[route].append((chunk, body))
                else:
                    yield _row(route, chunk, kind, body)
        for route in list(ranges):
            chunks, bodies = zip(*ranges.pop(route), strict=True)
            parts = [_unpack(b, words) for b in bodies]
            size = np.array([len(h) for h, _ in parts])
            h, place = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            source = np.repeat(np.arange(len(parts), dtype=np.int32), size)
            del parts, bodies
            order, same = _sorted(h)
            del h
            place, source = place[order], source[order]
            again = np.zeros(len(place), bool)
            again[1:] = same
            again[:-1] |= same
            again &= place != _NO_PLACE
            place, source = place[again], source[again]
            by = np.argsort(source, kind="stable")
            place, source = place[by], source[by]
            cuts = np.searchsorted(source, np.arange(len(chunks) + 1))
            for k, chunk in enumerate(chunks):
                if cuts[k] < cuts[k + 1]:
                    yield _row(chunk, chunk, _PLACES, place[cuts[k] : cuts[k + 1]].astype("<u4").tobytes())

    return run


def _intervals(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for batch in batches:
            for chunk, kind, body in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "body")), strict=True):
                held[chunk].append((kind, body))
        for chunk in list(held):
            rows = held.pop(chunk)
            head = next(body for kind, body in rows if kind == _CHUNK)
            n, words = (int(x) for x in np.frombuffer(head, "<u4", 2))
            first, length = np.frombuffer(head, "<u4", 2 * n, 8).reshape(2, n).astype(np.int64)
            at = 8 + 8 * n
            keys = [head[at + 32 * k : at + 32 * k + 32] for k in range(n)]
            flagged = np.unpackbits(np.frombuffer(zlib.decompress(head[at + 32 * n :]), np.uint8), count=words).astype(bool)
            for kind, body in rows:
                if kind == _PLACES:
                    flagged[np.frombuffer(body, "<u4")] = True
            cover = np.zeros(words + 1, np.int32)
            start = np.flatnonzero(flagged)
            cover[start] += 1
            np.add.at(cover, start + width, -1)
            covered = np.cumsum(cover[:-1]) > 0
            out: dict[bytes, bytes] = {}
            for key, a, m in zip(keys, first, length, strict=True):
                own = covered[a : a + m]
                if own.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).view(np.int8)))
                    out[key] = edge.astype("<u4").tobytes()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], ["key", "intervals"])

    return run


def _pass(rows: DataFrame, width: int, verify: bool) -> DataFrame:
    """``key, intervals`` of the windows of ``_text`` that occur twice; to verify, of those in ``_candidates``."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    n = tasks_for(rows.sparkSession, total, RANGE_BYTES)
    hashed = rows.mapInArrow(_hash_chunks(width, n, CHUNK, verify), _DDL)
    answers = hashed.repartitionById(n, (F.col("route") % n).cast("int")).mapInArrow(_find_repeated(2 if verify else 1), _DDL)
    found = answers.repartition(n, "chunk").mapInArrow(_intervals(width), "key binary, intervals binary")
    return work_table(found.groupBy("key").agg(F.max("intervals").alias("intervals")), "intervals")


def repeated_intervals(docs: DataFrame, width: int = 50, text: str = "text") -> DataFrame:
    """``key`` (SHA-256 of a text) and ``intervals`` (word places: begin, end, begin, end, ... as
    little-endian unsigned 32-bit integers) of every text with repeated windows."""
    rows = docs.select(F.col(text).alias("_text"))
    maybe = small_enough(_pass(rows, width, False), F.length("intervals") + 64)
    both = rows.withColumn("_key", _key("_text")).join(maybe, F.col("_key") == maybe["key"]).select("_text", F.col("intervals").alias("_candidates"))
    return _pass(both, width, True)


def _key(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


_RESULTS = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("removed", ArrayType(StructType([StructField("begin", LongType()), StructField("end", LongType())]))), StructField("kept", StringType())]


def remove_repeated(docs: DataFrame, width: int = 50, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, n_removed, removed`` (intervals of word places) and ``kept`` (the text left)."""
    found = small_enough(repeated_intervals(docs, width, text), F.length("intervals") + 64)
    keep = others(docs, _RESULTS)
    rows = docs.select(*[docs[f"`{c}`"] for c in keep], _key(text).alias("__key"))
    joined = rows.join(found, rows["__key"] == found["key"], "left").select(*[rows[f"`{c}`"] for c in keep], found["intervals"].alias("__intervals"))
    schema = StructType([docs.schema[c] for c in keep] + _RESULTS)
    spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, text):
            data, o = buffers(b.column(text))
            raw = data.tobytes()
            total, gone, removed, kept = [], [], [], []
            for s, e, found in zip(o[:-1], o[1:], b.column("__intervals").to_pylist(), strict=True):
                words = raw[s:e].split()
                edge = np.frombuffer(found, "<u4").tolist() if found else []
                rest, at = [], 0
                for begin, end in zip(edge[::2], edge[1::2], strict=True):
                    rest += words[at:begin]
                    at = end
                rest += words[at:]
                total.append(len(words))
                gone.append(len(words) - len(rest))
                removed.append([{"begin": x, "end": y} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                kept.append(b" ".join(rest))
            results = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, spans), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *results], [*keep, *(f.name for f in _RESULTS)])

    return joined.mapInArrow(run, schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated(docs, width=35).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
