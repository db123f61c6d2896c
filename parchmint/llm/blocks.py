"""Searching a stated query set against all rows, in blocks.

Rows with equal vectors form a class with its k + 1 smallest ids, so a vector that very many rows share is searched once.
Classes are dealt into blocks by hash; each block is one task, which builds its index from the block's rows and then
answers the queries as they stream past it, a batch at a time, with each query's k + 1 best ids of the block. The best of
all blocks are merged per query vector by a limited window, and each query drops itself. An index row is shuffled once and
a query once per block; a task holds one block and one batch of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchmint.llm.shared import narrow_batches, stored

#: Rows of a block at most, about; blocks of tables that don't fill the cores with such blocks are smaller, down to FEW_ROWS.
INDEX_ROWS = 32_768
FEW_ROWS = 2048


def one_row_per_id(vectors: DataFrame, usable) -> DataFrame:
    """(id, v): the usable vectors of named rows; of rows with one id, the smallest vector counts."""
    return vectors.where(F.col("id").isNotNull() & usable).groupBy("id").agg(F.min("v").alias("v"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64("v", F.lit(1)))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _runs(values: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Stretches of rows in which none of the columns changes."""
    n = len(values[0])
    edges = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1 if n else []
    cuts = [0, *edges, n] if n else []
    yield from zip(cuts, cuts[1:])


def _answers(batches: Iterator[pa.RecordBatch], build: Callable, score_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (b, side, d, ids, h1, h2, v), sorted by b and side: side 0 a block's index, side 1 the queries it answers.

    ``build(vectors, ids)`` makes the index of the rows of one length; it answers ``best(vector)`` by (id, score) pairs.
    """
    now, held, made = None, {}, {}
    for batch in batches:
        names = batch.schema.names
        at = {n: batch.column(names.index(n)) for n in ("b", "side", "d", "ids", "h1", "h2", "v")}
        b, side, d = (at[n].to_numpy(zero_copy_only=False) for n in ("b", "side", "d"))
        out: tuple[list, ...] = ([], [], [], [])
        for start, end in _runs([b, side, d]):
            if b[start] != now:
                now, held, made = b[start], {}, {}
            length, part = int(d[start]), slice(start, end)
            vectors = matrix(at["v"][part])
            if side[start] == 0:
                held.setdefault(length, []).append((vectors, at["ids"][part].to_pylist()))
                continue
            if length in held and length not in made:
                made[length] = build(np.concatenate([x for x, _ in held[length]]), [i for _, ids in held[length] for i in ids])
                held[length] = None
            if length in made:
                for h1, h2, q in zip(at["h1"][part].to_pylist(), at["h2"][part].to_pylist(), vectors, strict=True):
                    for found, score in made[length].best(q):
                        for column, value in zip(out, (h1, h2, found, score), strict=True):
                            column.append(value)
        types = (pa.int64(), pa.int64(), pa.int64(), score_type)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["h1", "h2", "id", "score"])


def search(rows: DataFrame, is_query, k: int, build: Callable, score_type: str) -> DataFrame:
    """(query_id, rank, id, score) of each query's k best rows but itself, best first, ties to the smaller id.

    ``rows`` has (id, v) with unique ids; ``build`` makes a block's index, which gives at least the k + 1 best of the block,
    by score and then id, for a query vector.
    """
    spark = rows.sparkSession
    narrow_batches(spark)
    rows = stored(_keyed(rows), "vectors")
    first = Window.partitionBy("h1", "h2").orderBy("id")
    members = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    classes = stored(members.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min("v").alias("v")), "classes")
    asked = rows.where(is_query)
    wanted = asked.groupBy("h1", "h2").agg(F.min("v").alias("v"))
    n = classes.count()
    blocks = max(1, -(-n // INDEX_ROWS), min(spark.sparkContext.defaultParallelism, -(-n // FEW_ROWS)))
    of = F.pmod(F.xxhash64("h2", "h1"), F.lit(blocks)).cast("int")
    size, none = F.size("v").alias("d"), F.lit(None)
    index = classes.select(of.alias("b"), F.lit(0).alias("side"), size, "ids", none.cast("long").alias("h1"), none.cast("long").alias("h2"), "v")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")
    probes = wanted.select(every, F.lit(1).alias("side"), size, none.cast("array<long>").alias("ids"), "h1", "h2", "v")
    dealt = index.union(probes).repartitionById(blocks, F.col("b")).sortWithinPartitions("b", "side", "d")
    kernel = partial(_answers, build=build, score_type=pa.float64() if score_type == "double" else pa.int64())
    found = dealt.mapInArrow(kernel, f"h1 long, h2 long, id long, score {score_type}")
    best = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "id")
    top = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    lists = top.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score"))).alias("top"))
    own = asked.select(F.col("id").alias("query_id"), "h1", "h2").join(lists, ["h1", "h2"])
    kept = F.slice(F.filter("top", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(kept).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))
