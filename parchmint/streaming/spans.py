"""The figure reader on streams: stateless stages run unchanged on ``readStream``; counts are kept per source and kind."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions import spans


def figures(documents: DataFrame) -> DataFrame:
    """(source, kind, normalized) of every figure on every line of a batch or a stream of documents."""
    lines = documents.select("source", F.explode(F.split("text", "\n")).alias("text")).where(F.col("text").rlike("[0-9]"))
    found = spans.with_spans(lines, "text", ("source",)).select("source", F.explode("spans").alias("s"))
    return found.select("source", F.col("s.kind").alias("kind"), F.col("s.normalized").alias("normalized"))


def figures_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, kind, figures) of a stream that reads the documents once and ends. Documents have no time of their own, so
    the counts are of the whole stream, not of windows."""
    path = f"{sf_dir.rstrip('/')}/documents.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{path}*")
    counts = figures(stream).groupBy("source", "kind").agg(F.count("*").alias("figures"))
    # each batch writes the counts so far beside the others; the last one written holds the whole stream
    base = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/") + "/figures-" + uuid.uuid4().hex
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/counts/{number}")
        last.append(number)

    query = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{base}/counts/{max(last)}") if last else spark.createDataFrame([], counts.schema)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
