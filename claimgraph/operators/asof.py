"""As-of joins: for each asked row the newest row of its key at its own time.

Rows and questions of a key are laid into buckets of time. Within a bucket the last row before a question is found by
one window over the bucket; what came before the bucket is found by one window over a row for each bucket. So a key that
very many rows share is sorted bucket by bucket, in tasks of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.storage import materialise

DAY = 86_400_000_000


def latest_before(asked: DataFrame, rows: DataFrame, keys: list[str], *, as_of: str = "as_of", at: str = "at", tie: list[str] | None = None, bucket: int = DAY) -> DataFrame:
    """asked with ``found``: the row (a struct) of the same keys with the largest ``at`` not after ``as_of``; else null.

    Of rows of one time the smallest by ``tie`` (default: all columns) counts. Null keys match nothing, null times
    neither. bucket is in microseconds. Repeated questions are answered each.
    """
    payload = [c for c in rows.columns if c not in keys]
    order = [*(tie or []), *[c for c in payload if c not in (tie or []) and c != at]]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    known = F.col(at).isNotNull()
    for key in keys:
        known &= F.col(key).isNotNull()
    once = rows.filter(known).groupBy(*keys, F.col(at).alias("_at")).agg(F.min(F.struct(*order)).alias("_p") if order else F.first(F.struct(F.lit(0).alias("_"))).alias("_p"))
    once = once.withColumn("_t", micros("_at")).withColumn("_b", F.floor(F.col("_t") / bucket))
    asked = materialise(asked.withColumn("_id", F.monotonically_increasing_id()), "asof-asked").withColumn("_t", micros(as_of)).withColumn("_b", F.floor(F.col("_t") / bucket))
    last = F.max(F.struct("_t", "_at", "_p"))
    sums = once.groupBy(*keys, "_b").agg(last.alias("_last"))
    marks = asked.select(*keys, "_b").distinct()
    kind = sums.schema["_last"].dataType
    before = Window.partitionBy(*keys).orderBy("_b").rangeBetween(Window.unboundedPreceding, -1)
    earlier = sums.unionByName(marks.withColumn("_last", F.lit(None).cast(kind))).withColumn("_earlier", F.last("_last", ignorenulls=True).over(before))
    earlier = earlier.groupBy(*keys, "_b").agg(F.max("_earlier").alias("_earlier"))
    both = once.select(*keys, "_b", "_t", F.lit(0).alias("_kind"), F.struct("_t", "_at", "_p").cast(kind).alias("_row"), F.lit(None).cast("long").alias("_id"))
    both = both.unionByName(asked.select(*keys, "_b", "_t", F.lit(1).alias("_kind"), F.lit(None).cast(kind).alias("_row"), "_id"))
    here = Window.partitionBy(*keys, "_b").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = both.withColumn("_here", F.last("_row", ignorenulls=True).over(here)).filter("_kind = 1").select("_id", *keys, "_b", "_here")
    answer = same.join(earlier, [*keys, "_b"], "left").select("_id", F.coalesce("_here", "_earlier").alias("_row"))
    fields = [F.col(f"_row._p.{c}").alias(c) if c != at else F.col("_row._at").alias(at) for c in payload]
    found = answer.filter("_row is not null").select("_id", F.struct(*fields).alias("found"))
    return asked.join(found, "_id", "left").drop("_id", "_t", "_b")
