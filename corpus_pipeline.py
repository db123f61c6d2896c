"""A training corpus from raw documents, in five stages; each works on all that its predecessor kept.

toxicity drops what the class-conditional models score 0.3 or more; near_dedup keeps the first document of each group of
near copies (five-word shingles, similarity 0.8); secrets masks what is secret in each text; mixing repeats or leaves
out documents so that the sources' words meet their target weights; packing deals the token ids into windows.

Cases: null and empty texts score as texts without a word do, are copies of nothing, and are kept once by the mix, as they
have no words to weigh; rows of one doc_id fall or stay together as near copies; rows with a null doc_id are kept; a null
source is a source of its own; equal rows get alike in every stage; empty tables give empty results; all columns of the
documents stay through the first four stages, whatever they are called, and ``n_chars`` follows the masked text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm import mixing, near_dedup, packing, queries, secrets, toxicity
from parchmint.llm.shared import stored, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = unused(docs.columns, "score")
    return model.score(docs, keep=tuple(docs.columns), name=score).where(F.col(score) < queries.TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_duplicates(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, queries._tokenizer_path(), queries.END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Tokenisation, models and grouping have no form in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
