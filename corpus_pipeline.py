"""Documents to training tokens in five stages, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.

Defined results of every stage: an empty table gives an empty one; of extra columns none is
returned, whatever its name; texts of any length are taken whole; a null doc_id is an id like others,
smaller than any. What a null or a repeated row means is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe import ship
from cloakframe.llm import bpe, exact_dedup, jaccard, language_id, mixing
from cloakframe.llm._common import drop_since, tables_made, work_table

BATCH = "1m"  # of Arrow: an executor runs all five stages, so each must be small
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the language models reject: null or without a letter, or unlike every
    language. Rows without lang are not learned from, but judged; repeated rows share the verdict."""
    ship(spark, BATCH)
    model = language_id.fit(docs.select("doc_id", "text", "lang"), F.lit(True))
    return language_id.predict(docs.select(*COLUMNS), model).where("not rejected").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the largest doc_id; null equals empty; of repeated rows one stays."""
    ship(spark, BATCH)
    return exact_dedup.dedup(docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id (null last), of each component of texts with a five-word Jaccard
    index of 0.8 or more. Texts without words, null included, are one group; so are repeated rows."""
    ship(spark, BATCH)
    return jaccard.near_dedup(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, by the weights of domains and languages; no document twice. Null lang
    and source count as empty, null texts as no tokens; rows that repeat a doc_id go together."""
    chosen = mixing.mix(docs, mixing.domain_of(), mixing.WEIGHTS, share=(4, 5), max_epochs=1, seed="pipeline")
    return chosen.select("_row.*").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit), their number, and whether decoding gives the text back;
    a null text has no ids. Every row has a result, repeated ones too."""
    ship(spark, BATCH)
    path = bpe.default_vocabulary()
    both = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), path)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return both.select("doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]

#: SQL cannot express the language models and the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), tables_made()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work_table(docs, name)
            drop_since(spark, mark, keep=1)  # what the stage and the one before have left
    return docs
