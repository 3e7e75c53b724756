"""Byte-level BPE encoding and decoding with the ids of a given vocabulary file.

Encoding: the text is cut at special tokens and by the pre-token pattern; a piece is encoded
left to right with the longest token that matches (Aho-Corasick gives the longest match at
every place), stepping back to shorter tokens while two neighbours are not compatible. Two
tokens are compatible if the merges would produce exactly this boundary; that answer is
kept in a table. The result equals that of applying the merges by rank, in linear time.
Decoding: one gather through a table of token bytes and offsets.

Scale: a map over rows, no shuffle. The vocabulary (fixed size, about 1 MB) is broadcast,
never read on executors. Recent pieces are kept in two generations of at most
``KEEP_PIECES`` entries each, texts are handled in slices of about 2 MB.

Defined results: a null text counts as empty and gives no ids. Other columns pass through;
a column named as the output is replaced. Invalid UTF-8 from arbitrary ids is decoded with
replacement characters; unknown ids decode to nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from ._common import binary_array, by_size, others

KEEP_PIECES = 130_000
KEEP_PAIRS = 300_000
LONG_PIECE = 32
#: The pre-token pattern of the byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


_CHARS = _byte_chars()


def _raw(token: str) -> bytes:
    """The bytes that a token of the file stands for."""
    return bytes(_CHARS[c] for c in token) if all(c in _CHARS for c in token) else token.encode()


class Vocabulary:
    """Tables made from the content of a vocabulary file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, char = spec["model"], _CHARS
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        split = spec.get("pre_tokenizer") or {}
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or split.get("use_regex") is False:
            raise ValueError("only the byte-level pre-tokenizer with its own pattern and no prefix space is supported")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with matching options are not supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # a token's place: single bytes first, then merges by rank
        names = [c for c, _ in sorted(char.items(), key=lambda x: x[1])] + [a + b for a, b in pairs]
        if len(set(names)) != len(names):
            raise ValueError("a token has several merges")
        place = {t: k for k, t in enumerate(names)}
        self.ids = np.array([model["vocab"][t] for t in names], np.uint32)
        self.tokens = [_raw(t) for t in names]
        self.length = [len(t) for t in self.tokens]
        self.parts = [(k, k) for k in range(256)] + [(place[a], place[b]) for a, b in pairs]
        self.merged = {(a, b): 256 + k for k, (a, b) in enumerate(self.parts[256:])}
        known = {t: k for k, t in enumerate(self.tokens)}
        self.shorter = [next((known[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in known), -1) for t in self.tokens]
        self.compatible: dict[tuple[int, int], bool] = {}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for k, t in enumerate(self.tokens):
            a.add_word(t.decode("latin-1"), k)
        a.make_automaton()
        return a

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves a boundary between the two tokens: no merge across
        it comes up before the merges that build the tokens on either side."""
        a, b, bound = left, right, 2**62
        while True:
            if self.merged.get((a, b), bound) < bound:
                return False
            if a > b:  # undo the later of the two merges, and look at what then touches
                if a < 256:
                    return True
                bound, a = a, self.parts[a][1]
            else:
                if b < 256:
                    return True
                bound, b = b + 1, self.parts[b][0]

    def fits(self, left: int, right: int) -> bool:
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) >= KEEP_PAIRS:
                self.compatible.clear()
            known = self.compatible[left, right] = self._fits(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Places of the tokens of one piece."""
        n = len(piece)
        longest = [0] * n
        for end, tok in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - self.length[tok]] = tok  # ends ascend: the last is the longest
        out: list[int] = []
        open_at = bytearray(b"\1") * (n + 1)
        at, tok = 0, longest[0] if n else 0
        while at < n:
            last = out[-1] if out else -1
            while True:
                end = at + self.length[tok]
                if open_at[end] and (last < 0 or self.fits(last, tok)):
                    out.append(tok)
                    at = end
                    tok = longest[at] if at < n else 0
                    break
                if (less := self.shorter[tok]) >= 0:
                    tok = less
                    continue
                open_at[at] = 0  # nothing fits here: take the last token back and shorten it
                tok = out.pop()
                at -= self.length[tok]
                break
        return out


class Decoder:
    """The bytes of all tokens, one after the other, and where each id's begin."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        texts = {i: _raw(t) for t, i in spec["model"]["vocab"].items()} | {t["id"]: _raw(t["content"]) for t in spec["added_tokens"]}
        size = max(texts) + 2
        lengths = np.array([len(texts.get(i, b"")) for i in range(size)], np.int64)
        self.text = np.frombuffer(b"".join(texts.get(i, b"") for i in range(size)), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum(lengths)])

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and byte offsets of many id lists, one after the other; ``first``: where each begins."""
        ids = np.minimum(ids.astype(np.int64), len(self.offset) - 2)
        begin, length = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        total = np.concatenate([[0], np.cumsum(length)])
        step = np.ones(int(total[-1]), np.int64)
        has = length > 0
        if has.any():
            at, b, e = total[:-1][has], begin[has], begin[has] + length[has]
            step[at[0]] = b[0]
            step[at[1:]] = b[1:] - e[:-1] + 1
        return self.text[np.cumsum(step)], total[first]


class Encoder(dict):
    """Maps a piece to the bytes of its ids, little-endian unsigned 32-bit; recent pieces stay."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}
        self.pieces = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(vocabulary.special, key=len, reverse=True)) + ")") if vocabulary.special else None

    def __missing__(self, piece: str) -> bytes:
        v = self.vocabulary
        found = self.older.get(piece)
        if found is None:
            found = v.ids[v.encode_piece(piece.encode())].astype("<u4").tobytes()
        if len(piece) <= LONG_PIECE:
            if len(self) >= KEEP_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        if self.special is None or not any(t in text for t in self.vocabulary.special):
            return b"".join(map(self.__getitem__, self.pieces(text)))
        out = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append(np.array([self.vocabulary.special[part]], "<u4").tobytes())
            else:
                out += map(self.__getitem__, self.pieces(part))
        return b"".join(out)


_held: dict[tuple, object] = {}


def _keep(broadcast, make):
    """What ``make`` builds of the vocabulary; one for each worker process, which serves many tasks."""
    content = broadcast.value
    key = (make, hash(content))
    if key not in _held:
        _held.clear()
        _held[key] = make(content)
    return _held[key]


def _new_encoder(content: bytes) -> Encoder:
    return Encoder(Vocabulary(content))


def _new_both(content: bytes) -> tuple[Encoder, Decoder]:
    return _new_encoder(content), Decoder(content)


def _content(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _with(schema: StructType, name: str, kind) -> StructType:
    return StructType([f for f in schema.fields if f.name.lower() != name.lower()] + [StructField(name, kind)])


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text`` as binary, little-endian unsigned 32-bit integers."""
    broadcast, keep = _content(df.sparkSession, path), others(df, [StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _keep(broadcast, _new_encoder)
        for b in by_size(batches, text, 2 << 20):
            ids = pa.array([encoder.encode(t) if t else b"" for t in b.column(text).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), ids], [*keep, out])

    return df.mapInArrow(run, _with(df.schema, out, BinaryType()))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of binary ``ids``."""
    broadcast, keep = _content(df.sparkSession, path), others(df, [StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _keep(broadcast, Decoder)
        for b in by_size(batches, ids, 2 << 20):
            col = b.column(ids)
            col = col.fill_null(b"") if col.null_count else col
            texts = _texts(decoder, col.to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), texts], [*keep, out])

    return df.mapInArrow(run, _with(df.schema, out, StringType()))


def encode_and_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """:func:`encode` and :func:`decode` in one Python worker a task: half the memory of two."""
    broadcast, keep = _content(df.sparkSession, path), others(df, [StructField(n, StringType()) for n in (ids, decoded)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _keep(broadcast, _new_both)
        for b in by_size(batches, text, 1 << 20):
            found = [encoder.encode(t) if t else b"" for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(found, pa.binary()), _texts(decoder, found)], [*keep, ids, decoded])

    return df.mapInArrow(run, _with(_with(df.schema, ids, BinaryType()), decoded, StringType()))


def _texts(decoder: Decoder, ids: list[bytes]) -> pa.Array:
    lengths = np.array([len(x) for x in ids], np.int64) // 4
    raw = binary_array(*decoder.decode(np.frombuffer(b"".join(ids), "<u4"), np.concatenate([[0], np.cumsum(lengths)])))
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = default_vocabulary()
    return encode_and_decode(docs, path).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
