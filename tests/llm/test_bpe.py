import hashlib
import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from cloakframe.llm import bpe

PATH = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return bpe.Encoder(bpe.Vocabulary(f.read()))


@pytest.fixture(scope="module")
def decoder():
    with open(PATH, "rb") as f:
        return bpe.Decoder(f.read())


def odd_texts(n=400):
    rng = random.Random(7)
    pools = ["abcdefghij  ", "aaaa", "the and ing tion ", "éàüß ñ ç ", "\n\t \r\x0b\x1c\x85  ", "日本語テキスト", "🙂👍🏽", "0123456789.,'$", "'s't're've'm'll'd ", "<|endoftext|>", "́‍­", "".join(map(chr, range(1, 300)))]
    for _ in range(n):
        yield "".join(rng.choice(rng.choice(pools)) if rng.random() < 0.9 else rng.choice(pools) for _ in range(rng.randrange(0, 60)))


def test_ids_equal_the_librarys(encoder, decoder, library):
    texts = [*odd_texts(), "", " ", "a" * 5000, "ab" * 3000, "x <|endoftext|> y<|endoftext|><|endoftext|>", "<|endoftext", " " * 50]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == want, t
        data, _ = decoder.decode(np.array(want, np.uint32), np.array([0, len(want)]))
        assert bytes(data).decode() == library.decode(want, skip_special_tokens=False)


def test_every_token_and_random_letters(encoder, library):
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 14)))
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_small_cache(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_PIECES", 3)
    monkeypatch.setattr(bpe, "KEEP_PAIRS", 3)
    for t in odd_texts(100):
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_query(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = bpe.op2_bpe(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "x", None), (2, "x", None)], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert [(r.doc_id, bytes(r.ids), r.decoded) for r in rows] == [(1, b"", ""), (2, b"", ""), (2, b"\x57\0\0\0", "x"), (2, b"\x57\0\0\0", "x")]
    assert bpe.encode(df.limit(0), PATH).count() == 0
    ids = spark.createDataFrame([(np.array([158, 99999999], "<u4").tobytes(),), (None,)], "ids binary")
    assert [r.decoded for r in bpe.decode(ids, PATH).collect()] == ["�", ""]


def test_results_replace_columns_in_any_case(spark):
    df = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id long, text string, IDS string, Decoded int")
    out = bpe.encode_and_decode(df, PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"] and out.first().decoded == "a b"


def test_other_pre_tokenizers_are_refused():
    spec = json.loads(open(PATH, "rb").read())
    for change in ({"add_prefix_space": True}, {"use_regex": False}, {"type": "Whitespace"}):
        with pytest.raises(ValueError, match="pre-tokenizer"):
            bpe.Vocabulary(json.dumps(spec | {"pre_tokenizer": spec["pre_tokenizer"] | change}).encode())
