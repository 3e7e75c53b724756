"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are made of the bytes and words of a text by numpy passes (lengths, shares of
letters, digits, capitals, symbols and line kinds, repetition of words, lines and word
triples). Features are cut into at most ``BINS`` quantile bins; each tree level is a
histogram of gradients and curvatures of the logistic loss. The trees become five flat
arrays (feature, threshold, two children, value), walked for all rows at once.

Scale: the statistics are one map over all rows, kept as a table of a few hundred bytes a
row, so texts are read once. Trees are fitted on the driver from at most ``SAMPLE`` labelled
rows, the ones with the smallest hash; that bound is a parameter and holds at any size, and
so does that of the broadcast sample. Scoring is a map again.

Defined results: null and blank texts have zero statistics and get the score of such texts.
Without labelled rows every score is 0.5; with one kind of label it is near that label.
Rows with null labels are not learned from. Repeated rows get equal scores. An empty table
gives an empty result. Columns beside doc_id and text are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._common import buffers, by_size, work_table
from .substring_dedup import window_hashes

SAMPLE = 20_000
BINS = 48
TREES = 80
DEPTH = 4
RATE = 0.12


def _set(*ranges: tuple[int, int] | str) -> np.ndarray:
    out = np.zeros(256, bool)
    for r in ranges:
        out[[ord(c) for c in r] if isinstance(r, str) else range(r[0], r[1] + 1)] = True
    return out


_KINDS = {
    "lower": _set((97, 122)), "upper": _set((65, 90)), "digit": _set((48, 57)), "high": _set((128, 255)), "space": _set(" \t"), "newline": _set("\n"),
    "stop": _set(".!?"), "shout": _set("!"), "comma": _set(",;:"), "bar": _set("|"), "odd": _set("#$%&*+<=>@^_`~\\{}[]"), "slash": _set("/"), "quote": _set("\"'()-"), "control": _set((0, 8), (11, 31), (127, 127)),
}
NAMES = [
    "log_bytes", "log_words", "log_lines", *(f"share_{k}" for k in _KINDS), "word_length", "longest_word", "short_words", "long_words", "distinct_words", "top_word",
    "distinct_triples", "top_triple", "distinct_lines", "words_a_line", "stop_lines", "odd_lines", "capital_words", "shout_words", "symbol_words", "digit_words",
]


def _sums(mask: np.ndarray, o: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (c[o[1:]] - c[o[:-1]]).astype(float)


def _variety(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct keys, and of the most frequent one, among each owner's keys."""
    total = np.bincount(owner, minlength=n).astype(float)
    order = np.argsort((owner.astype(np.uint64) << np.uint64(44)) | (keys >> np.uint64(20)), kind="stable")
    k, own = keys[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (own[1:] != own[:-1])])) if len(k) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([new, [len(k)]]))
    top = np.zeros(n)
    np.maximum.at(top, own[new], length)
    return np.bincount(own[new], minlength=n) / np.maximum(total, 1), top / np.maximum(total, 1)


def statistics(data: np.ndarray, o: np.ndarray) -> np.ndarray:
    """A row of ``NAMES`` for each text."""
    n = len(o) - 1
    size = np.diff(o).astype(float)
    w = _words.split(data, o)
    words = np.diff(w.first).astype(float)
    many = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), np.diff(w.first))
    length = (w.end - w.begin).astype(float)
    per_word = lambda x: np.bincount(owner, x, n)
    capital = _KINDS["upper"][data]
    inside = np.concatenate([[0], np.cumsum(capital, dtype=np.int64)])
    capitals = inside[w.end] - inside[w.begin]
    symbol = np.concatenate([[0], np.cumsum(_KINDS["odd"][data] | _KINDS["bar"][data], dtype=np.int64)])
    digits = np.concatenate([[0], np.cumsum(_KINDS["digit"][data], dtype=np.int64)])
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    triple = window_hashes(w.hash, 3)
    t_owner = owner[: len(triple)]
    whole = t_owner == owner[2:] if len(triple) else np.zeros(0, bool)
    # lines: the words between two line ends, by the sum of their placed hashes
    line_of = np.concatenate([[0], np.cumsum(_KINDS["newline"][data], dtype=np.int64)])[w.begin] + owner
    head = np.flatnonzero(np.concatenate([[True], line_of[1:] != line_of[:-1]])) if len(w.hash) else np.zeros(0, np.int64)
    place = np.arange(len(w.hash)) - np.repeat(head, np.diff(np.concatenate([head, [len(w.hash)]])))
    lines = np.add.reduceat(w.hash * _words.powers(int(place.max()) + 1)[place], head) if len(head) else np.zeros(0, np.uint64)
    l_owner = owner[head]
    n_lines = np.maximum(np.bincount(l_owner, minlength=n), 1).astype(float)
    tail = np.concatenate([head[1:], [len(w.hash)]]) - 1 if len(head) else head
    last = data[w.end[tail] - 1] if len(head) else np.zeros(0, np.uint8)
    first = data[w.begin[head]] if len(head) else np.zeros(0, np.uint8)
    columns = [np.log1p(size), np.log1p(words), np.log1p(n_lines), *(_sums(m[data], o) / np.maximum(size, 1) for m in _KINDS.values())]
    columns += [per_word(length) / many, np.log1p(longest), per_word(length <= 2) / many, per_word(length >= 12) / many]
    columns += [*_variety(w.hash, owner, n), *_variety(_words.mix(triple[whole]), t_owner[whole], n), _variety(_words.mix(lines), l_owner, n)[0], words / n_lines]
    columns += [np.bincount(l_owner, _KINDS["stop"][last], n) / n_lines, np.bincount(l_owner, _KINDS["odd"][first] | _KINDS["bar"][first], n) / n_lines]
    columns += [per_word((capitals == length) & (length > 1)) / many, per_word(data[w.end - 1] == 33) / many, per_word(symbol[w.end] > symbol[w.begin]) / many, per_word(digits[w.end] > digits[w.begin]) / many]
    return np.stack(columns, axis=1)


class Trees:
    """Boosted trees as flat arrays: ``feature`` is -1 in leaves, whose ``value`` counts."""

    def __init__(self, base: float):
        self.base = base
        self.feature, self.threshold, self.left, self.right, self.value, self.roots = ([] for _ in range(6))

    def freeze(self) -> Trees:
        self.feature, self.left, self.right = (np.array(x, np.int32) for x in (self.feature, self.left, self.right))
        self.threshold, self.value = np.array(self.threshold, float), np.array(self.value, float)
        return self

    def add(self, feature: int, threshold: float, value: float) -> int:
        for x, v in ((self.feature, feature), (self.threshold, threshold), (self.left, -1), (self.right, -1), (self.value, value)):
            x.append(v)
        return len(self.feature) - 1

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root, np.int32)
            for _ in range(DEPTH):
                f = self.feature[node]
                low = x[rows, np.maximum(f, 0)] <= self.threshold[node]
                node = np.where(f < 0, node, np.where(low, self.left[node], self.right[node]))
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, least: float = 3.0, ridge: float = 2.0) -> Trees:
    """Boosting by the logistic loss; ``least`` is the smallest curvature of a leaf."""
    n, columns = x.shape
    if n == 0:
        return Trees(0.0).freeze()
    share = (y.sum() + 0.5) / (n + 1)
    out = Trees(float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, BINS + 1)[1:-1])) for c in range(columns)]
    binned = np.stack([np.searchsorted(cuts[c], x[:, c], side="left") for c in range(columns)], axis=1)  # bin b: at most cuts[b]
    offset = np.arange(columns) * (BINS + 1)
    raw = np.full(n, out.base)
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-raw))
        grad, curve = y - p, p * (1 - p)
        leaf = lambda rows: float(RATE * grad[rows].sum() / (curve[rows].sum() + ridge))  # noqa: B023, E731
        root = out.add(-1, 0.0, leaf(np.arange(n)))
        out.roots.append(root)
        open_ = [(root, np.arange(n))]
        for _ in range(DEPTH):
            after = []
            for node, rows in open_:
                flat = (binned[rows] + offset).ravel()
                g = np.bincount(flat, np.repeat(grad[rows], columns), columns * (BINS + 1)).reshape(columns, -1).cumsum(axis=1)[:, :-1]
                h = np.bincount(flat, np.repeat(curve[rows], columns), columns * (BINS + 1)).reshape(columns, -1).cumsum(axis=1)[:, :-1]
                gt, ht = grad[rows].sum(), curve[rows].sum()
                gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
                gain[(h < least) | (ht - h < least)] = 0
                f, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[f, b] <= 1e-6 or b >= len(cuts[f]):
                    continue
                low = binned[rows, f] <= b
                out.feature[node], out.threshold[node] = int(f), float(cuts[f][b])
                for side, part in (("left", rows[low]), ("right", rows[~low])):
                    child = out.add(-1, 0.0, leaf(part))
                    getattr(out, side)[node] = child
                    after.append((child, part))
            open_ = after
        raw += _walk(out, root, x)
    return out.freeze()


def _walk(trees: Trees, root: int, x: np.ndarray) -> np.ndarray:
    """Values of one tree while it is still lists."""
    out, open_ = np.zeros(len(x)), [(root, np.arange(len(x)))]
    while open_:
        node, rows = open_.pop()
        if trees.feature[node] < 0:
            out[rows] = trees.value[node]
        else:
            low = x[rows, trees.feature[node]] <= trees.threshold[node]
            open_ += [(trees.left[node], rows[low]), (trees.right[node], rows[~low])]
    return out


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``stats`` (array of float) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "_text"):
            x = statistics(*buffers(b.column("_text"))).astype(np.float32)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))], ["doc_id", "stats"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, "doc_id long, stats array<float>")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(NAMES))


def fit(measured: DataFrame, labels: DataFrame, train: Column, label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` labelled rows where ``train`` (over doc_id) holds."""
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(train & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    chosen = chosen.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id", "y").limit(sample)
    rows = measured.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id", "y").limit(sample).select("stats", "y").toArrow()
    if rows.num_rows == 0:
        return fit_trees(np.zeros((0, len(NAMES))), np.zeros(0))
    return fit_trees(_matrix(rows["stats"]), rows["y"].to_numpy().astype(float))


def score(measured: DataFrame, trees: Trees) -> DataFrame:
    """``doc_id, score`` of every measured row."""
    held = measured.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(held.value.score(_matrix(b.column("stats"))))], ["doc_id", "score"])

    return measured.mapInArrow(run, "doc_id long, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    measured = work_table(measure(docs), "statistics")
    trees = fit(measured, labels.select("doc_id", "quality"), ~held_out)
    return score(measured, trees).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
