"""Exact global positions by range partitioning: no window over all rows, no group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.session import cut


def global_index(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """`df` with `name`, each row's position from 0 in the order `order` (ties in any order).

    The rows are range-partitioned and sorted within their partitions; only the partitions' sizes meet on the driver. A
    value with a third of all rows is one range only if nothing in `order` tells its rows apart.
    """
    n = "__m"
    while n in df.columns:
        n += "_"
    rows = cut(cut(df).repartitionByRange(*order).sortWithinPartitions(*order)).withColumn(n, F.monotonically_increasing_id())
    sizes = sorted(rows.groupBy(F.shiftright(n, 33).cast("int").alias("p")).count().collect())
    start, at = {}, 0
    for r in sizes:
        start[r.p], at = at, at + r["count"]
    if not start:
        return rows.drop(n).withColumn(name, F.lit(0).cast("bigint"))
    offset = F.create_map(*[F.lit(x).cast(t) for p, s in start.items() for x, t in ((p, "int"), (s, "bigint"))])
    local = F.col(n).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn(name, F.element_at(offset, F.shiftright(n, 33).cast("int")) + local).drop(n)


def sums_before(df: DataFrame, order: str, of: list[str]) -> DataFrame:
    """`df` with `avant_c` for each count `c` in `of`: its sum over the rows before in the order of `order`, whose values are
    distinct. Each range's rows are summed on their own; only the ranges' totals meet on the driver."""
    rows = cut(cut(df).repartitionByRange(order).sortWithinPartitions(order)).withColumn("__p", F.spark_partition_id())
    totals = sorted(rows.groupBy("__p").agg(*[F.sum(c).alias(c) for c in of]).collect())
    w = Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows
    for c in of:
        start, at = {}, 0
        for r in totals:
            start[r["__p"]], at = at, at + r[c]
        offset = F.create_map(*[F.lit(x).cast(t) for p, s in start.items() for x, t in ((p, "int"), (s, "bigint"))]) if start else F.lit(None).cast("map<int, bigint>")
        out = out.withColumn(f"avant_{c}", F.element_at(offset, F.col("__p")) + F.coalesce(F.sum(c).over(w), F.lit(0)))
    return out.drop("__p")
