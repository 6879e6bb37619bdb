"""Running numbers within groups of any size, without one task holding a group."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def numbered(df: DataFrame, group: str, part: Column, order: list[Column], out: str, facts: DataFrame | None = None) -> DataFrame:
    """df with `out`: 0, 1, 2, ... within each group, by part and then by order.

    Each (group, part) is sorted by itself; the counts of the parts, a row each, give its first number. Parts must be
    small for one task, so their number has to grow with the rows. facts has a row per group (not null) and columns to add; they
    travel with the first numbers, so rows need no further join.
    """
    df = df.withColumn("_part", part)
    sizes = df.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(
        F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first")
    )
    if facts is not None:
        firsts = firsts.join(facts.withColumnRenamed(group, "_g"), "_g")
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)).cast("long") - 1
    df = df.withColumn("_inside", inside)
    df = df.join(firsts, F.col(group).eqNullSafe(F.col("_g")) & F.col("_part").eqNullSafe(F.col("_p")))
    return df.withColumn(out, F.col("_first") + F.col("_inside")).drop("_part", "_inside", "_g", "_p", "_first")


def hash_parts(df: DataFrame, key: Column, rows_per_part: int = 5_000) -> Column:
    """A part for numbered(): rows dealt by the hash of their key, `rows_per_part` on average."""
    return F.pmod(F.xxhash64(key), F.lit(max(1, df.count() // rows_per_part + 1)))


def placed(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """df with `out`: 0, 1, 2, ... within each group (a string column without nulls) by order, nulls first.

    Rows are range-partitioned and numbered where they lie, so a group of any size is spread over tasks. A group that goes on from one
    partition to the next takes up the count; of these there is at most one per partition, which bounds the table that is broadcast.
    """
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for key in batch.column(group).to_pylist():
                n = n + 1 if key == last else 0
                last = key
                at.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], names=[*batch.schema.names, "_part", "_at"])

    rows = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    rows = cut(rows.mapInArrow(number, f"{schema}, _part int, _at long"))
    sizes = rows.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = sizes.withColumn("_before", before).where("_before > 0").select(group, "_part", "_before")
    rows = rows.join(F.broadcast(carried), [group, "_part"], "left")  # at most one row per partition
    return rows.withColumn(out, F.col("_at") + F.coalesce("_before", F.lit(0))).drop("_part", "_at", "_before")
