"""Exact order statistics of groups without a buffer that grows with a group's values.

A mergeable sketch of each group gives a range in which the wanted element very likely lies. One pass counts what lies
below and inside that range; only values inside are then summed up by value and counted along in order. Where the sketch
was wrong, which the counts show, the range is the whole group: the answer is exact either way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.storage import materialise

#: Half the width of the range around the wanted rank, some times a sketch's error, and ranks that a sketch is asked for.
MARGIN, GRID = 0.03, 64


def exact_elements(rows: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]], *, margin: float = MARGIN) -> DataFrame:
    """by and, for each name of places, the element at a place (from 0) of a group's sorted values.

    A place is given as a column of the number of values, such as ``lambda n: (n - 1) / 2``, and is cut to a whole
    number in the group. Null values and NaN don't count; a group without others has no row.
    """
    v = rows.select(*by, F.col(value).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    v = materialise(v, "quantile-values")
    sketched = v.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.kll_sketch_agg_double("_v").alias("_k"))
    n = F.col("_n")
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), F.greatest(F.lit(0), F.least(n - 1, F.floor(place(n)))).cast("long").alias("at")) for name, place in places.items()))
    share = (F.col("_w.at") + 0.5) / n
    # a sketch is asked at fixed ranks only
    sketched = sketched.withColumn("_grid", F.array(*(F.kll_sketch_get_quantile_double("_k", F.lit(i / GRID)) for i in range(GRID + 1))))
    of_grid = lambda i: F.get("_grid", F.greatest(F.lit(0), F.least(F.lit(GRID), i.cast("int"))))
    low, high = of_grid(F.floor((share - margin) * GRID)), of_grid(F.ceil((share + margin) * GRID))
    ranges = sketched.withColumn("_w", F.explode(wanted)).select(*by, F.col("_w.name").alias("_name"), F.col("_w.at").alias("_at"), low.alias("_low"), high.alias("_high"))
    ranges = materialise(ranges, "quantile-ranges")
    met = _met(v, ranges, by)
    inside = F.col("_v").between(F.col("_low"), F.col("_high"))
    counts = met.groupBy(*by, "_name").agg(F.count_if(F.col("_v") < F.col("_low")).alias("_below"), F.count_if(inside).alias("_inside"))
    right = (F.col("_below") <= F.col("_at")) & (F.col("_at") < F.col("_below") + F.col("_inside"))
    infinite = F.lit(float("inf"))
    sure = ranges.join(counts, [*by, "_name"]).select(
        *by, "_name", "_at", F.when(right, F.col("_low")).otherwise(-infinite).alias("_low"), F.when(right, F.col("_high")).otherwise(infinite).alias("_high"), F.when(right, F.col("_below")).otherwise(0).alias("_below")
    )
    histogram = _met(v, sure, by).filter(inside).groupBy(*by, "_name", "_at", "_below", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(*by, "_name").orderBy("_v"))
    found = histogram.withColumn("_upto", upto).filter(F.col("_upto") > F.col("_at")).groupBy(*by, "_name").agg(F.min("_v").alias("_v"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in places])


def _met(values: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    return values.join(ranges, by) if by else values.crossJoin(F.broadcast(ranges))  # without groups there is a row for each place


def exact_percentile(rows: DataFrame, by: list[str], value: str, p: float, name: str) -> DataFrame:
    """by and the percentile between 0 and 1, interpolated between neighbours like Spark's percentile."""
    found = exact_elements(rows, by, value, {"_lower": lambda n: F.floor((n - 1) * p), "_upper": lambda n: F.ceil((n - 1) * p)})
    n = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    part = (F.col("_n") - 1) * p - F.floor((F.col("_n") - 1) * p)
    joined = found.join(n, by) if by else found.crossJoin(F.broadcast(n))
    return joined.select(*by, (F.col("_lower") * (1 - part) + F.col("_upper") * part).alias(name))
