"""Folds of groups as one stream of rows, and rows that many steps read written once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def plain_values(column: pa.Array) -> list:
    """The values of a column as Python objects; flat columns are converted at once instead of one by one."""
    t = column.type
    flat = pa.types.is_string(t) or pa.types.is_decimal(t) or not column.null_count and (pa.types.is_integer(t) or pa.types.is_floating(t) or pa.types.is_boolean(t))
    return column.to_numpy(zero_copy_only=False).tolist() if flat else column.to_pylist()


def fold_groups(rows: DataFrame, keys: list[str], fold: Callable[[list[dict]], list[dict]], schema: str, placed: bool = False) -> DataFrame:
    """What ``fold`` makes of the rows of each group (a page or a block: small), in Arrow.

    Rows stream through sorted by key, so that one call and one output batch serve thousands of groups; a task holds a batch
    and the group at its end. ``placed``: the rows of a group lie in one partition already (a window over the keys made them).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        last = None
        for batch in batches:
            names, out = batch.schema.names, []
            columns = [plain_values(c) for c in batch.columns]
            of_row = zip(*(columns[names.index(k)] for k in keys), strict=True)
            for key, values in zip(of_row, zip(*columns, strict=True), strict=True):
                if held and key != last:
                    out += fold(held)
                    held = []
                last = key
                held.append(dict(zip(names, values, strict=True)))
            if out:
                yield from pa.Table.from_pylist(out, schema=arrow).to_batches()
        if held:
            yield from pa.Table.from_pylist(fold(held), schema=arrow).to_batches()

    # by a hash of the keys, not by the keys: Spark (spark.sql.unionOutputPartitioning) takes a union of rows that lie by them
    # for rows that lie by them too and drops an exchange by the keys, though each side's partitions are coalesced on their own
    together = rows if placed else rows.repartition(F.xxhash64(*keys))
    return together.sortWithinPartitions(*keys).mapInArrow(run, schema)


def kept(rows: DataFrame, once: bool = False) -> DataFrame:
    """Rows that many steps read, written once to the checkpoint folder where the session has one: the plan starts anew from
    them, and a lost executor costs no more than its task. ``once``: the shuffle files that made them go at once, not when
    the driver happens to collect its garbage."""
    spark = rows.sparkSession
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not (named and once):
        return rows.checkpoint() if named else rows
    was = spark.conf.get(_CLEANS)
    spark.conf.set(_CLEANS, "true")
    try:
        return rows.select("*").checkpoint()
    finally:
        spark.conf.set(_CLEANS, was)
