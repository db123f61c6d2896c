"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm.shared import new_folder, table

END_ID = 1
TOXIC = 0.3


def _tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm import pii

    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size("pii_" + k).cast("long").alias("n_" + k)
    base = F.concat(*[F.col("pii_" + k) for k in pii.BASE_KINDS])
    every = F.concat(*[F.col("pii_" + d.kind) for d in pii.DETECTORS])
    n = F.size(every).cast("long").alias("n_spans")
    return found.select("doc_id", *map(count, pii.BASE_KINDS), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(every).alias("spans"), n)


def op2_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm import wavelet

    path = new_folder(spark, "token-shards")
    wavelet.write_token_shards(table(spark, sf_dir, "documents"), path, _tokenizer_path(), END_ID)
    read = wavelet.read_token_shards(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm import sharding

    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    scored = toxicity.fit(docs, table(spark, sf_dir, "labels")).score(docs)
    held_out = F.coalesce(~toxicity.may_teach(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm import ann

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    found = ann.nearest(rows, F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm import secrets

    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["kind"] != "literal")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias("n_" + k)
    return found.select("doc_id", *map(count, secrets.KINDS[:3]), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("secrets")).alias("spans"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm import mixing

    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op8_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm import maxscore

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    found = maxscore.top_k(rows, F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op9_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm import near_dedup

    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm import packing

    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), _tokenizer_path(), END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_pii, op2_wavelet, op3_sharding, op4_toxicity, op5_ann, op6_secrets, op7_mixing, op8_maxscore, op9_superminhash, op10_packing)
    return {q.__name__: q for q in every}


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w) WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    """The others rest on tokenizers, hashes, learned models or positions of matches, which SQL can't state: tests hold
    them against brute force."""
    return {"op8_maxscore": OP8_SQL}
