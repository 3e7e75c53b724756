import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_jaccard import around_the_limit, kept_by_brute_force
from test_mixing import brute
from tokenizers import Tokenizer

import corpus_pipeline as p
from cloakframe.llm import language_id, mixing


@pytest.fixture(scope="module")
def table(spark, sf_dir, tmp_path_factory):
    """A folder with documents: those of the smallest table, near copies, and odd rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*p.COLUMNS)
    last = docs.agg({"doc_id": "max"}).first()[0]
    made = [(last + 1 + i, t, "en", f"made{i % 4}", len(t)) for i, t in around_the_limit(random.Random(21), 60)]
    odd = [(None, "the cat and the dog were in the house", "en", None, 1), (last + 9000, None, "en", "s1", 0), (last + 9001, "", None, None, 0), (last + 9002, " \t\n", "de", "s2", None), (last + 9003, "12 34 !?", "fr", "s3", 1)]
    odd += [(last + 9004, "the same words again in a row", None, "s1", 9)] * 3 + [(last + 9005, "and the long text of the house " * 20_000, "en", "s2", None)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    every = docs.unionByName(spark.createDataFrame(made + odd, docs.schema))
    every.withColumn("Kept", F.lit("k")).withColumn("root", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    return folder


def domain(source):
    digits = re.search(r"[0-9]+$", source or "")
    return f"domain{int(digits[0]) % 3 if digits else 0}"


def plain_run(rows, model):
    """The five stages in plain Python, from (doc_id, text, lang, source, n_chars)."""
    none_first = lambda i: (i is not None, i or 0)
    verdicts = {t: model.predict([t])[2][0] for t in {r[1] for r in rows}}
    rows = [r for r in rows if not verdicts[r[1]]]
    best = {}
    for r in rows:
        t = r[1] or ""
        if t not in best or none_first(r[0]) > none_first(best[t][0]):
            best[t] = r
    rows = list(best.values())
    kept = kept_by_brute_force([(r[0] if r[0] is not None else 10**9, r[1]) for r in rows])
    rows = [r for r in rows if (r[0] if r[0] is not None else 10**9) in kept]
    path = lambda r: (domain(r[3]), r[2] or "", r[3] or "")
    chosen = {x[0] for x in brute([(r[0], r[1], path(r)) for r in rows], mixing.WEIGHTS, (4, 5), 1, "pipeline")}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.no_truncation()
    tok.no_padding()
    return {r[0]: tok.encode(r[1] or "", add_special_tokens=False).ids for r in rows if r[0] in chosen}


def test_run_equals_the_plain_stages(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet").select(*p.COLUMNS)
    model = language_id.fit(docs.select("doc_id", "text", "lang"), F.lit(True))
    want = plain_run([tuple(r) for r in docs.collect()], model)
    got = p.run(spark, table).collect()
    assert len(got) == len({r.doc_id for r in got}) == len(want)
    for r in got:
        ids = [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)]
        assert ids == want[r.doc_id] and r.n_tokens == len(ids) and r.round_trip


def test_stages_take_effect_and_keep_the_columns(spark, table, sf_dir):
    assert [n for n, _ in p.STAGES] == ["language", "exact", "near", "mix", "tokens"]
    docs = spark.read.parquet(f"{table}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(p.STAGES):
        docs = stage(spark, docs, table)
        assert k == 4 or docs.columns == p.COLUMNS
        counts.append(docs.count())
        if k == 0:
            assert not [r for r in docs.collect() if not any(c.isalpha() for c in r.text or "")]
        if k == 1:
            texts = [r.text for r in docs.collect()]
            assert len(texts) == len(set(texts))
    assert counts[0] > counts[1] > counts[2] > counts[3] > counts[4] == counts[5]


@pytest.mark.parametrize("name, stage", p.STAGES)
def test_empty_tables(spark, sf_dir, name, stage):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    assert stage(spark, empty, sf_dir).count() == 0
