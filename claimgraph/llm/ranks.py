"""Places of rows in an order and joins on keys that many rows share, without a whole stratum or key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def place(rows: DataFrame, strata: list[str], part: str, order: list[Column], out: str) -> DataFrame:
    """out: each row's place from 0 in its stratum by (part, order).

    part holds small whole numbers that cut a stratum into pieces for one task each: only counts of pieces are summed
    up along a stratum, rows are sorted within pieces. strata and part hold no nulls.
    """
    keys = [*strata, part]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_here"))
    before = Window.partitionBy(*(strata or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("_inside", inside).join(starts, keys).withColumn(out, F.col("_start") + F.col("_inside")).drop("_inside", "_start")


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], by: list[str], *, parts: int = 64) -> DataFrame:
    """rows joined on keys, which many of them may share, with table, whose keys are unique.

    A key's rows fall into parts by a hash of their columns by; a row of table is copied only to the parts that hold
    rows. rows is read twice.
    """
    cut = rows.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int"))
    copies = cut.select(*keys, "_part").distinct().join(table, keys)
    return cut.join(copies, [*keys, "_part"]).drop("_part")
