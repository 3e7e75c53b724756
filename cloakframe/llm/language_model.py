"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

Tokens are words (A-Z lower-cased) and one end a text. A token's unit is the word itself if it
is one of the ``HEAD`` most frequent ones, else a class by spelling (hash of the last two bytes); the
end is a unit. ``GROUP`` frequent words of neighbouring rank are a class, any other unit is one.
p(token | context) = p(class | context) * p(unit | class, context) * p(token | unit),
where the context is the two units before (ends before a text).

p(class | context) is a maximum-entropy model over hashed features: the class before alone, the
unit before (bigram), the class and the unit two before (skips), unit with class and unit with unit
(trigrams). p(unit | class, context) is one over features of the word and what is before it (bigram,
skip and trigram with classes), with the words' counts as its background. Every feature is joined
with the class before, so weights of different classes before are apart. p(token | unit) within a
spelling is by log(count + 1), with one more event for words not seen in training.

Training: all training texts are counted, as triples of units. The triples of one class before
are one block; its weights get ``updates`` gradient updates in full precision, over all contexts
of the block, each divided by a bound of the weight's curvature (observed or expected tokens
times the features of a token) and with momentum. Blocks share no weight, so their updates run
side by side and nothing is exchanged between them. Scoring: sparse batches in numpy, in which
only the contexts that occur are computed.

Scale: words are counted by task before their shuffle; triples too, packed, by block and slice, so
that a task sums a bounded share of the corpus, into arrays of a fixed size (20 MB a block); a block is
then the sum of its slices. Distinct words and the triples of a task grow with the corpus.
Counts of frequent words (at most ``FREQUENT``, by a threshold found from a histogram) are
broadcast; a text's other words are joined with their counts by shuffle, a few per cent of
all tokens, none of them hot. Weights are classes * (ROWS * classes + PAIRS) numbers, about 23 MB.
Words are counted by 64-bit hash: of m different words about m**2 / 2**65 pairs collide.

Defined results: a null or blank text is one end token. Without training texts every count
is zero, base scores are zero and classes are equally likely. A null doc_id counts as the
empty string in the split. Repeated rows are scored alike, one result a row. An empty table
gives an empty result. Columns beside doc_id and text are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._common import buffers, by_size, release, work_table

HEAD = 768
GROUP = 32
SPELLED = 24
GROUPS = HEAD // GROUP
UNITS = 1 + HEAD + SPELLED
CLASSES = 1 + GROUPS + SPELLED
ROWS = 1 << 11  # weights rows of classes, for each class before
PAIRS = 1 << 14  # weights of words, for each class before
FREQUENT = 300_000
UPDATES = 30
PRIOR = 4.0  # of a weight's Gaussian prior: the inverse variance
SLICE_TOKENS = 1 << 24  # of a block, a slice
MOST_SLICES = 256
_FEATURES, _WORD_FEATURES = 6, 3
_COMPACT = 1 << 20

#: The class of each unit: the end, groups of words, spellings.
CLASS_OF = np.concatenate([[0], 1 + np.arange(HEAD) // GROUP, 1 + GROUPS + np.arange(SPELLED)])


def _spelling(w: _words.Words) -> np.ndarray:
    """Spelling of each word, from 0: a hash of its last two bytes."""
    last = w.data[w.end - 1].astype(np.int64)
    before = np.where(w.end - w.begin > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.int64)
    return (last * 257 + before) * 40503 % 65521 % SPELLED


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, _words.Words]]:
    for b in by_size(batches, "text"):
        yield b, _words.split(*buffers(b.column("text")), lower=True)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inverse, np.concatenate(counts), len(k)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts, kinds, size = [], [], [], 0

    def flush() -> pa.RecordBatch:
        h, n = _summed(keys, counts)
        every, spelled = np.concatenate(keys), np.concatenate(kinds)
        u, at = np.unique(every, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(spelled[at].astype(np.int32)), pa.array(n)], ["h", "kind", "n"])

    for _, w in _texts(batches):
        h, at, n = np.unique(w.hash, return_index=True, return_counts=True)
        keys.append(h)
        counts.append(n)
        kinds.append(_spelling(w)[at])
        size += len(h)
        if size > _COMPACT:
            yield flush()
            keys, counts, kinds, size = [], [], [], 0
    if keys:
        yield flush()


def units_of(w: _words.Words, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit of every token, ends included; where each text's tokens begin; where words are."""
    n = np.diff(w.first)
    starts = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.zeros(starts[-1], np.int64)
    place = np.arange(len(w.hash)) + np.repeat(np.arange(len(n)), n)
    unit = 1 + HEAD + _spelling(w)
    if len(top):
        order = np.argsort(top)
        at = np.minimum(np.searchsorted(top[order], w.hash), len(top) - 1)
        hit = top[order][at] == w.hash
        unit[hit] = 1 + order[at[hit]]
    out[place] = unit
    return out, starts, place


def contexts(units: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of the context of each token: the unit before * UNITS + that two before, ends before a text."""
    ctx = np.zeros(len(units), np.int64)
    for back, scale in ((1, UNITS), (2, 1)):
        prev = np.zeros(len(units), np.int64)
        prev[back:] = units[:-back] if back < len(units) else 0
        for k in range(back):
            at = starts[:-1] + k
            prev[at[at < starts[1:]]] = 0
        ctx += prev * scale
    return ctx


def _bucket(kind: int, key: np.ndarray, size: int) -> np.ndarray:
    return (_words.mix((key.astype(np.uint64) << np.uint64(3)) + np.uint64(kind)) % np.uint64(size)).astype(np.int64)


def features(ctx: np.ndarray) -> np.ndarray:
    """Rows of a block's class weights that are active in each context (n x features)."""
    one, two = ctx // UNITS, ctx % UNITS
    c2 = CLASS_OF[two]
    keys = [np.zeros_like(ctx), one, c2, two, one * CLASSES + c2, ctx]
    return np.stack([_bucket(n, k, ROWS) for n, k in enumerate(keys)], axis=1)


def word_features(one: np.ndarray, c2: np.ndarray, group: np.ndarray) -> np.ndarray:
    """A block's word weights that are active for each member of a group of words (n x GROUP x features)."""
    word = (1 + group[:, None] * GROUP + np.arange(GROUP)).astype(np.int64)
    keys = [one[:, None] * UNITS + word, c2[:, None] * UNITS + word, (one * CLASSES + c2)[:, None] * UNITS + word]
    return np.stack([_bucket(n, k, PAIRS) for n, k in enumerate(keys)], axis=2)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def class_logs(weights: np.ndarray, rows: np.ndarray, open_classes: np.ndarray) -> np.ndarray:
    """log p(class | context) for the active rows (n x features) of each context."""
    z = np.where(open_classes, 0.0, -np.inf) + weights[rows[:, 0]]
    for f in range(1, rows.shape[1]):
        z += weights[rows[:, f]]
    return _log_softmax(z)


def word_logs(weights: np.ndarray, active: np.ndarray, background: np.ndarray) -> np.ndarray:
    """log p(word | group, context) for the members of each group (n x GROUP)."""
    return _log_softmax(background + weights[active].sum(axis=2))


def _count_triples(top: np.ndarray, slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0
        for _, w in _texts(batches):
            unit, starts, _ = units_of(w, top)
            k, n = np.unique(contexts(unit, starts) * UNITS + unit, return_counts=True)
            keys.append(k)
            counts.append(n)
            size += len(k)
            if size > _COMPACT:
                k, n = _summed(keys, counts)
                keys, counts, size = [k], [n], len(k)
                if size > _COMPACT // 2:
                    yield from _blocks(k, n, slices)
                    keys, counts, size = [], [], 0
        if keys:
            yield from _blocks(*_summed(keys, counts), slices)

    return run


_TRIPLES = "route int, keys binary, counts binary"


def _blocks(keys: np.ndarray, counts: np.ndarray, slices: int) -> Iterator[pa.RecordBatch]:
    """Sorted triples and counts by block (the class before), to the task's slice of it."""
    block = CLASS_OF[keys // UNITS**2]  # in order, as units of a class are neighbours
    cuts = np.searchsorted(block, np.arange(CLASSES + 1))
    for c in np.flatnonzero(np.diff(cuts)).tolist():
        a, b, r = cuts[c], cuts[c + 1], c * slices + TaskContext.get().partitionId() % slices
        planes = np.ascontiguousarray(keys[a:b].astype("<u4").view(np.uint8).reshape(-1, 4).T)  # sorted: the high bytes compress well
        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([planes.tobytes()], pa.binary()), pa.array([counts[a:b].astype("<i8").tobytes()], pa.binary())], ["route", "keys", "counts"])


_FIRST = np.searchsorted(CLASS_OF, np.arange(CLASSES + 1))  # the units of each class


def _sums(batches: Iterator[pa.RecordBatch], slices: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Tokens of each block by context and class (units * UNITS x CLASSES), and by unit before, class
    two before and word (units * CLASSES x HEAD); some 20 MB, whatever is summed."""
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for route, planes, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            block = route // slices
            first, units = _FIRST[block], _FIRST[block + 1] - _FIRST[block]
            by_class, by_word = sums.setdefault(block, (np.zeros(units * UNITS * CLASSES), np.zeros(units * CLASSES * HEAD)))
            keys = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)
            counts = np.frombuffer(counts, "<i8")
            for a in range(0, len(keys), _COMPACT):
                k, n = keys[a : a + _COMPACT].astype(np.int64), counts[a : a + _COMPACT]
                one, two, unit = k // UNITS**2 - first, k // UNITS % UNITS, k % UNITS
                by_class += np.bincount((one * UNITS + two) * CLASSES + CLASS_OF[unit], n, len(by_class))
                head = (unit >= 1) & (unit <= HEAD)
                by_word += np.bincount(((one * CLASSES + CLASS_OF[two]) * HEAD + unit - 1)[head], n[head], len(by_word))
    return sums


_SUMS = "block int, classes binary, words binary"


def _sparse(x: np.ndarray) -> bytes:
    at = np.flatnonzero(x)
    return at.astype("<u4").tobytes() + x[at].astype("<f8").tobytes()


def _add_sparse(x: np.ndarray, raw: bytes) -> None:
    n = len(raw) // 12
    x[np.frombuffer(raw, "<u4", n)] += np.frombuffer(raw, "<f8", n, 4 * n)


def _sum_slices(slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (by_class, by_word) in _sums(batches, slices).items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_sparse(by_class)], pa.binary()), pa.array([_sparse(by_word)], pa.binary())], ["block", "classes", "words"])
        release()

    return run


class _Ascent:
    """Gradient updates of one array of weights, each divided by a bound of its curvature, with momentum
    that restarts when the objective falls."""

    def __init__(self, start: np.ndarray, seen: np.ndarray, together: int, prior: float):
        self.weights = self.before = self.ahead = start
        self.seen, self.together, self.prior, self.best, self.t = seen, together, prior, -np.inf, 1.0

    def step(self, expected: np.ndarray, gain: float) -> None:
        gain -= self.prior / 2 * float((self.ahead**2).sum())
        self.t = self.t + 1 if gain >= self.best else 1.0
        self.best = gain
        bound = self.together * np.maximum(self.seen, expected) + self.prior
        self.before, self.weights = self.weights, self.ahead + (self.seen - expected - self.prior * self.ahead) / bound
        self.ahead = self.weights + (self.t - 1) / (self.t + 2) * (self.weights - self.before)


def _train_classes(block: int, sums: np.ndarray, open_classes: np.ndarray, updates: int, prior: float) -> np.ndarray:
    seen = sums.reshape(-1, CLASSES)
    ctx = np.flatnonzero(seen.any(axis=1))
    seen, ctx = seen[ctx], ctx + _FIRST[block] * UNITS
    rows, total = features(ctx), seen.sum(axis=1, keepdims=True)
    by = []
    for f in range(_FEATURES):
        order = np.argsort(rows[:, f], kind="stable")
        own, first = np.unique(rows[order, f], return_index=True)
        by.append((order, own, first))

    def summed(x: np.ndarray) -> np.ndarray:
        out = np.zeros((ROWS, CLASSES))
        for order, own, first in by:
            out[own] += np.add.reduceat(x[order], first, axis=0)
        return out

    start = np.zeros((ROWS, CLASSES))
    start[rows[0, 0]] = np.where(open_classes, np.log(seen.sum(axis=0) + 0.5), 0.0)
    ascent = _Ascent(start, summed(seen), _FEATURES, prior)
    for _ in range(updates):
        logs = class_logs(ascent.ahead, rows, open_classes)
        ascent.step(summed(total * np.exp(logs)), float(seen[:, open_classes].ravel() @ logs[:, open_classes].ravel()))
    return ascent.weights


def _train_words(block: int, sums: np.ndarray, background: np.ndarray, updates: int, prior: float) -> np.ndarray:
    seen = sums.reshape(-1, GROUP)  # by unit before, class two before and group
    of = np.flatnonzero(seen.any(axis=1))
    if not len(of):
        return np.zeros(PAIRS)
    seen, of = seen[of], of + _FIRST[block] * CLASSES * GROUPS
    total, group = seen.sum(axis=1, keepdims=True), of % GROUPS
    active = word_features(of // GROUPS // CLASSES, of // GROUPS % CLASSES, group)
    every, offset = active.reshape(-1), background[group]
    there = np.isfinite(offset)
    summed = lambda x: np.bincount(every, np.repeat(x.reshape(-1), _WORD_FEATURES), PAIRS)
    ascent = _Ascent(np.zeros(PAIRS), summed(seen), _WORD_FEATURES, prior)
    for _ in range(updates):
        logs = word_logs(ascent.ahead, active, offset)
        ascent.step(summed(total * np.exp(logs)), float((seen[there] * logs[there]).sum()))
    return ascent.weights


def _train(held, updates: int, prior: float):
    """The weights of each block that reaches a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_classes, background = held.value
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for block, classes, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                units = _FIRST[block + 1] - _FIRST[block]
                own = sums.setdefault(block, (np.zeros(units * UNITS * CLASSES), np.zeros(units * CLASSES * HEAD)))
                _add_sparse(own[0], classes)
                _add_sparse(own[1], words)
        for block in list(sums):
            by_class, by_word = sums.pop(block)
            w = _train_classes(block, by_class, open_classes, updates, prior).astype("<f4")
            v = _train_words(block, by_word, background, updates, prior).astype("<f4")
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([w.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["block", "classes", "words"])
        release()

    return run


@dataclass
class Model:
    top: np.ndarray  # hashes of the words that are units, by rank
    open_classes: np.ndarray  # classes that a token can have
    background: np.ndarray  # log share of each word in its group (GROUPS x GROUP)
    classes: np.ndarray  # weights of classes (CLASSES x ROWS x CLASSES)
    words: np.ndarray  # weights of words (CLASSES x PAIRS)
    norm: np.ndarray  # log10 of the softmax denominator within each spelling
    tokens: int  # N
    types: int  # V
    ends: int  # count of the end token
    frequent: np.ndarray  # sorted hashes of frequent words, and their counts
    frequent_n: np.ndarray

    def log10_unit(self, ctx: np.ndarray, unit: np.ndarray, at_once: int = 8192) -> np.ndarray:
        """log10 p(unit | context) of each token; each context that occurs is computed once."""
        out = np.zeros(len(ctx))
        kind = CLASS_OF[unit]
        by_block = CLASS_OF[ctx // UNITS]
        order = np.lexsort((ctx, by_block))
        seen, inverse = np.unique(by_block[order] * UNITS**2 + ctx[order], return_inverse=True)
        cuts = np.searchsorted(inverse, np.arange(0, len(seen) + at_once, at_once))
        block_of, ctx_of = seen // UNITS**2, seen % UNITS**2
        for n, a in enumerate(range(0, len(seen), at_once)):
            part, own = slice(a, a + at_once), order[cuts[n] : cuts[n + 1]]
            z = np.where(self.open_classes, 0.0, -np.inf) + np.zeros((len(ctx_of[part]), CLASSES))
            for f in features(ctx_of[part]).T:
                z += self.classes[block_of[part], f]
            out[own] = _log_softmax(z)[inverse[cuts[n] : cuts[n + 1]] - a, kind[own]]
        head = np.flatnonzero((unit >= 1) & (unit <= HEAD))
        if len(head):
            one, c2, group = ctx[head] // UNITS, CLASS_OF[ctx[head] % UNITS], (unit[head] - 1) // GROUP
            of, at = np.unique((one * CLASSES + c2) * GROUPS + group, return_inverse=True)
            order = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[order], np.arange(0, len(of) + at_once, at_once))
            for n, a in enumerate(range(0, len(of), at_once)):
                part, own = of[a : a + at_once], order[cuts[n] : cuts[n + 1]]
                first = part // GROUPS // CLASSES
                active = word_features(first, part // GROUPS % CLASSES, part % GROUPS)
                logs = _log_softmax(self.background[part % GROUPS] + self.words[CLASS_OF[first][:, None, None], active].sum(axis=2))
                out[head[own]] += logs[at[own] - a, (unit[head[own]] - 1) % GROUP]
        return out / np.log(10)


def fit(train: DataFrame, updates: int = UPDATES, prior: float = PRIOR) -> tuple[Model, DataFrame]:
    """A model of the column ``text``, and the table of word counts (h, n) beyond the frequent ones."""
    spark = train.sparkSession
    words = train.select("text").mapInArrow(_count_words, "h long, kind int, n long")
    counts = work_table(words.groupBy("h").agg(F.min("kind").alias("kind"), F.sum("n").alias("n")), "words")
    texts = train.count()
    by_kind = {r.kind: (r.n, r.v) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    top = counts.orderBy(F.desc("n"), "h").limit(HEAD).collect()
    step = F.floor(F.log2("n") * 4).cast("int")
    room, floor = FREQUENT, None
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), key=lambda r: -r.s):  # a few hundred rows
        room -= r["count"]
        if room < 0:
            break
        floor = r.s
    often = counts.where(step >= floor).select("h", "n").toArrow() if floor is not None else None
    h = often["h"].to_numpy().view(np.uint64) if often is not None else np.zeros(0, np.uint64)
    n = often["n"].to_numpy() if often is not None else np.zeros(0, np.int64)
    order = np.argsort(h)
    size, kinds = np.zeros(SPELLED), np.zeros(SPELLED)
    for kind, (total, v) in by_kind.items():
        size[kind], kinds[kind] = total, v
    for r in top:
        size[r.kind] -= r.n
        kinds[r.kind] -= 1
    norm = np.log10(size + kinds + 1)
    own = np.zeros(HEAD)
    own[: len(top)] = [r.n for r in top]
    own = own.reshape(GROUPS, GROUP)
    with np.errstate(divide="ignore"):
        background = np.log(own)  # a group without words is closed
    background[own.sum(axis=1) == 0] = 0.0
    open_classes = np.concatenate([[True], own.sum(axis=1) > 0, np.ones(SPELLED, bool)])
    model = Model(
        np.array([r.h for r in top], np.int64).view(np.uint64), open_classes, background, np.zeros((CLASSES, ROWS, CLASSES), np.float32), np.zeros((CLASSES, PAIRS), np.float32), norm,
        sum(t for t, _ in by_kind.values()) + texts, sum(v for _, v in by_kind.values()) + (texts > 0), texts, h[order], n[order],
    )
    slices = max(1, min(MOST_SLICES, -(-model.tokens // (CLASSES * SLICE_TOKENS))))
    triples = train.select("text").mapInArrow(_count_triples(model.top, slices), _TRIPLES)
    sums = triples.repartitionById(CLASSES * slices, "route").mapInArrow(_sum_slices(slices), _SUMS)
    held = spark.sparkContext.broadcast((open_classes, background))
    trained = sums.repartitionById(CLASSES, "block").mapInArrow(_train(held, updates, prior), _SUMS)
    for r in trained.toArrow().to_pylist():  # a row for each class, 23 MB in all
        model.classes[r["block"]] = np.frombuffer(r["classes"], "<f4").reshape(ROWS, CLASSES)
        model.words[r["block"]] = np.frombuffer(r["words"], "<f4")
    return model, (counts.where(step < floor) if floor is not None else counts).select("h", "n")


_DDL = "row long, doc_id long, n_tokens long, known long, base double, own double, rare array<long>"


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = model.value, TaskContext.get().partitionId() << 33
        for b, w in _texts(batches):
            unit, starts, place = units_of(w, m.top)
            spelled = unit > HEAD
            own = m.log10_unit(contexts(unit, starts), unit)
            own[spelled] -= m.norm[unit[spelled] - 1 - HEAD]
            at = np.minimum(np.searchsorted(m.frequent, w.hash), max(len(m.frequent) - 1, 0))
            hit = m.frequent[at] == w.hash if len(m.frequent) else np.zeros(len(w.hash), bool)
            log_n = np.zeros(len(w.hash))
            log_n[hit] = np.log10(m.frequent_n + 1.0)[at[hit]]
            base = np.full(len(unit), np.log10(m.ends + 1.0))
            base[place] = log_n
            own[place] += np.where(spelled[place], log_n, 0.0)
            known = np.full(len(unit), int(m.ends > 0))
            known[place] = hit
            rare = w.hash[~hit].view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(~hit)])[w.first].astype(np.int32)
            n, first = len(starts) - 1, starts[:-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), b.column("doc_id"), pa.array(np.diff(starts)), pa.array(np.add.reduceat(known, first)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(own, first)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(rare))],
                ["row", "doc_id", "n_tokens", "known", "base", "own", "rare"],
            )
            row += n

    return run


def score(docs: DataFrame, model: Model, rare_counts: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = work_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(held), _DDL), "scored")
    words = rows.select("row", F.explode("rare").alias("w"))
    more = words.join(rare_counts, words["w"] == rare_counts["h"]).groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count(F.lit(1)).alias("m"))
    both = rows.drop("rare").join(more.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")
    add = F.coalesce("more", F.lit(0.0))
    denominator = float(np.log10(model.tokens + model.types + 1))
    return both.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("m", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + add - F.col("n_tokens") * denominator).alias("base_score"), (F.col("own") + add).alias("score"),
    )


def split_of(doc_id: str, parts: int) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model, rare = fit(docs.where(split_of("doc_id", 7) != 2).select("text"))
    found = score(docs, model, rare)
    return found.select("doc_id", (split_of("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
