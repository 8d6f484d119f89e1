"""Corpus pipeline: toxicity, near-dedup, decontamination, source mix, token tables.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns;
the last returns what its token tables hold.  run() writes every stage's result as Parquet into
the shared folder and reads it again, so a lost executor costs one stage's tasks at most; what the
stage wrote besides is removed then.

Defined results, for each stage over whatever the stage before kept:

* Null doc_id: such rows are judged, dropped, mixed and encoded like others, each by its own text.
* Null, empty or wordless text: never toxic by words (the model's intercept decides), no near copy of
  anything, holds no test item, and has no words to mix, so the mix leaves it out.
* Very long texts are read whole everywhere.
* Repeated rows: near-dedup leaves one of the rows with equal doc_id and equal shingles; rows of one
  doc_id with different texts belong to one group and stay together if theirs is the kept id.  The
  mix may then repeat any row, at most twice.
* Ties: the smallest doc_id of a group stays; equal rows stand in for each other.
* Empty tables: documents give an empty result; without labels nothing is toxic, without benchmark
  nothing is contaminated.
* Extra columns come through unchanged, whatever their names; the last stage returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import decontaminate, minhash_dedup, source_mix, token_tables, toxicity
from foliospark.llm.common import Scratch, drop_since, mark, table
from foliospark.llm.queries import tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.keep_one(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed_documents(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_tables.digest(token_tables.read(token_tables.write(docs, tokenizer_path())))


STAGES = [
    ("toxicity", without_toxic),
    ("minhash_dedup", without_near_copies),
    ("decontaminate", without_test_items),
    ("source_mix", mixed),
    ("token_tables", tokenised),
]

# Learned scores, edit distances and byte-pair ids have no SQL form: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, last = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        begun = mark()
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        drop_since(spark, begun)
        if last:
            scratch.drop(last)
        last = name
    return docs
