"""Language ID by interpolated Kneser-Ney character models.

Text is lower-cased; letters are kept and any run of other characters is one boundary. A
symbol is predicted from up to three symbols before it, not beyond the last boundary, so
texts never touch. For each language the four orders are interpolated Kneser-Ney: raw
counts at the top, continuation counts below. Known 4-grams are kept as one sorted array of
64-bit hashes with a column of log probabilities for each language (unseen ones backed off
beforehand); rarer positions go through the orders' own sorted hash arrays. The language
with the lowest cross-entropy per symbol wins, ties to the smaller name.

Score: the posterior of the winner, from the entropies times at most ``EVIDENCE`` symbols.
Rejection: a text is rejected if it has no letter, or if its entropy under the winner exceeds that
language's limit by a margin that shrinks with length. The limit is calibrated on labelled texts that the
n-grams were not counted on: the ``QUANTILE`` of their entropies under their own language, so that
a few odd or mislabelled ones do not set it, and ``MARGIN`` nats.

Scale: the model is fitted on at most about ``SAMPLE`` labelled texts a language and calibrated on
about ``CALIBRATION`` more (chosen by hash, so the bounds hold at any size), of the ``LANGUAGES`` with the
most texts; its n-grams are counted in Spark. Everything else is
a map over rows: no shuffle, the model (a few MB, bounded by the sample) is broadcast.

Defined results: a null text and one without letters get ``und`` with score 0. Rows without
language are not learned from; without any labelled row every text gets ``und``. Other
columns pass through; columns named as results, in any case, are replaced. Repeated rows get equal
results. An empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from ._common import by_size, others
from ._words import mix

SAMPLE = 500
CALIBRATION = 200
LANGUAGES = 200
FEW = 50
QUANTILE = 0.98
MARGIN = 1.0
EVIDENCE = 24
ORDER = 4
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@cache
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(sys.maxunicode + 1)), np.uint8).astype(bool)


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols predicted and their three contexts, four rows (c3, c2, c1, x); the text of each
    column; how many letters each text has."""
    low = [(" " + t.lower()) if t else " " for t in texts]
    text_of = np.repeat(np.arange(len(low)), [len(t) for t in low])
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    letters = np.bincount(text_of[letter], minlength=len(low))
    s = np.where(letter, points, 0).astype(np.uint32)
    first = np.ones(len(s), bool)
    first[1:] = text_of[1:] != text_of[:-1]
    keep = letter | first
    keep[1:] |= letter[:-1]
    s, text_of = s[keep], text_of[keep]
    starts = first[keep]
    g = np.zeros((ORDER, len(s)), np.uint32)
    g[3] = s
    g[2, 1:] = s[:-1]
    g[2, starts] = 0
    g[1, 2:] = s[:-2]
    g[1, g[2] == 0] = 0
    g[0, 3:] = s[:-3]
    g[0, g[1] == 0] = 0
    # a boundary after a boundary (a text's first symbol) carries nothing
    real = (g[3] != 0) | (g[2] != 0)
    return g[:, real], text_of[real], letters


def gram_hash(g: np.ndarray, order: int) -> np.ndarray:
    """Hash of the last ``order`` rows of (c3, c2, c1, x)."""
    h = np.full(g.shape[1], order, np.uint64)
    for row in g[ORDER - order :]:
        h = (h ^ row) * _K[0]
        h ^= h >> np.uint64(29)
    return mix(h)


def context_hash(g: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order - 1`` symbols before x."""
    h = np.full(g.shape[1], 100 + order, np.uint64)
    for row in g[ORDER - order : ORDER - 1]:
        h = (h ^ row) * _K[1]
        h ^= h >> np.uint64(31)
    return mix(h)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


class KneserNey:
    """One language: for each order sorted gram hashes with their discounted share, and sorted
    context hashes with the weight left to the order below."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, alphabet: int):
        """``grams``: distinct (c3, c2, c1, x) columns with their counts."""
        self.uniform, self.orders = 1.0 / (alphabet + 1), []
        for order in range(ORDER, 0, -1):
            h, at = np.unique(gram_hash(grams, order), return_index=True)
            if order < ORDER:  # how many different symbols precede the gram
                inverse = np.searchsorted(h, gram_hash(grams, order))
                counts = np.bincount(inverse, minlength=len(h)).astype(float)
            else:
                counts = np.asarray(counts, float)[at]
            grams = grams[:, at].copy()
            grams[: ORDER - order] = 0
            one, two = (counts == 1).sum(), (counts == 2).sum()
            discount = min(max(one / (one + 2 * two), 0.1), 0.95) if one + two else 0.5
            ctx = context_hash(grams, order)
            keys, inverse = np.unique(ctx, return_inverse=True)
            total = np.bincount(inverse, counts)
            share = (counts - discount) / total[inverse]
            left = discount * np.bincount(inverse) / total
            self.orders.append((order, h, share, keys, left))
        self.orders.reverse()

    def log_probability(self, g: np.ndarray) -> np.ndarray:
        p = np.full(g.shape[1], self.uniform)
        for order, h, share, keys, left in self.orders:
            at, ctx = _find(h, gram_hash(g, order)), _find(keys, context_hash(g, order))
            p = np.where(ctx >= 0, np.where(at >= 0, share[at], 0.0) + left[ctx] * p, p)
        return np.log(p)


class Model:
    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        """``grams``: language -> distinct grams (4 x n) and counts."""
        self.languages = sorted(grams)
        alphabet = len(np.unique(np.concatenate([g[3] for g, _ in grams.values()]))) if grams else 1
        self.models = [KneserNey(*grams[name], alphabet) for name in self.languages]
        self.limits = np.full(len(self.languages), np.inf)
        if grams:
            g = np.concatenate([grams[name][0] for name in self.languages], axis=1)
            self.keys, at = np.unique(gram_hash(g, ORDER), return_index=True)
            self.table = np.stack([m.log_probability(g[:, at]) for m in self.models], axis=1).astype(np.float32)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per symbol (texts x languages), symbols and letters of each text."""
        g, text_of, letters = symbols(texts)
        n = np.bincount(text_of, minlength=len(texts))
        at = _find(self.keys, gram_hash(g, ORDER))
        logs = self.table[at]
        rare = np.flatnonzero(at < 0)
        if len(rare):
            some = np.ascontiguousarray(g[:, rare])
            logs[rare] = np.stack([m.log_probability(some) for m in self.models], axis=1)
        total = np.stack([np.bincount(text_of, logs[:, k], minlength=len(texts)) for k in range(len(self.languages))], axis=1)
        return -total / np.maximum(n, 1)[:, None], n, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, rejected and cross-entropy of each text."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool), np.zeros(len(texts))
        h, n, letters = self.entropies(texts)
        best = h.argmin(axis=1)
        low = h[np.arange(len(h)), best]
        score = 1.0 / np.exp(-(h - low[:, None]) * np.minimum(n, EVIDENCE)[:, None]).sum(axis=1)
        none = letters == 0
        rejected = none | (low > self.limits[best] + 4.0 / np.sqrt(np.maximum(n, 1)))
        names = ["und" if x else self.languages[k] for k, x in zip(best, none, strict=True)]
        return names, np.where(none, 0.0, score), rejected, np.where(none, 0.0, low)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in by_size(batches, "text", 2 << 20):
        names, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
        for name in sorted(set(names)):
            g, _, _ = symbols([t for t, own in zip(texts, names, strict=True) if own == name])
            _, at, n = np.unique(gram_hash(g, ORDER), return_index=True, return_counts=True)
            cols = [pa.array(row[at].astype(np.int32)) for row in g]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), *cols, pa.array(n.astype(np.int64))], ["lang", "c3", "c2", "c1", "x", "n"])


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE, calibration: int = CALIBRATION) -> Model:
    """A model of the languages of the rows where ``train`` holds, from about ``sample`` texts each and
    limits from about ``calibration`` others; of fewer texts, both get their share, but of under
    ``FEW`` all serve for both."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.lit("language"), F.col(doc_id)).alias("h")).where(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    often = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    sizes = {r["lang"]: r["count"] for r in often}
    if not sizes:
        return Model({})
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min((sample + calibration) / n, 1.0))])
    # the hash, as a number from 0 to 1, is below the language's share; its last part is for calibration
    place = F.shiftrightunsigned("h", 11) / float(2**53) / F.try_element_at(share, F.col("lang"))
    chosen = rows.withColumn("place", place).where("place < 1")
    few, learned = F.col("lang").isin([name for name, n in sizes.items() if n < FEW]), F.col("place") < sample / (sample + calibration)
    counted = chosen.where(learned | few).select("text", "lang").mapInArrow(_count_grams, "lang string, c3 int, c2 int, c1 int, x int, n long").groupBy("lang", "c3", "c2", "c1", "x").agg(F.sum("n").alias("n")).toArrow()
    names = counted["lang"].to_numpy()
    grams = np.stack([counted[c].to_numpy().astype(np.uint32) for c in ("c3", "c2", "c1", "x")])
    n = counted["n"].to_numpy()
    model = Model({name: (grams[:, own], n[own]) for name in sorted(set(names)) if (own := names == name).any()})
    if not model.languages:
        return model

    def own_entropy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {name: k for k, name in enumerate(model.languages)}
        for b in by_size(batches, "text", 2 << 20):
            names = b.column("lang").to_pylist()
            h, n, letters = model.entropies(b.column("text").to_pylist())
            own = [(name, float(h[i, at[name]]) - 4.0 / n[i] ** 0.5) for i, name in enumerate(names) if name in at and letters[i]]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.string()), pa.array([y for _, y in own], pa.float64())], ["lang", "h"])

    held_back = chosen.where(~learned | few).select("text", "lang")
    found = held_back.mapInArrow(own_entropy, "lang string, h double").groupBy("lang").agg(F.percentile("h", F.lit(QUANTILE)).alias("h")).collect()  # at most LANGUAGES
    limits = {r.lang: r.h + MARGIN for r in found}
    model.limits = np.array([limits.get(name, max(limits.values(), default=np.inf)) for name in model.languages])
    return model


_RESULTS = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType()), StructField("cross_entropy", DoubleType())]


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, score, rejected, cross_entropy``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = others(docs, _RESULTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, text, 1 << 20):
            names, score, rejected, entropy = held.value.predict(b.column(text).to_pylist())
            results = [pa.array(names, pa.string()), pa.array(score), pa.array(rejected), pa.array(entropy)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *results], [*keep, *(f.name for f in _RESULTS)])

    return docs.mapInArrow(run, StructType([docs.schema[c] for c in keep] + _RESULTS))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    model = fit(docs.select("doc_id", "text", "lang"), ~F.coalesce(held_out, F.lit(False)))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")
