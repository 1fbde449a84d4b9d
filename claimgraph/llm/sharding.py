"""Sharding by proportional stratified interleaving, in DataFrame operations alone.

Rows of each source are shuffled by a seeded hash and ranked; sorting all rows by their rank as a fraction of their
source's rows spreads every source evenly over the whole order, so equal cuts of it all hold the corpus's mixture.
No source and no order is ever ranked in one task: ranks come from counts of small hash ranges, summed up over the
ranges of a source, plus the place within a range; the same holds for the final order, whose ranges are even because
fractional ranks are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.storage import materialise
from claimgraph.llm.ranks import join_hot, place

LAW = "rows"


def _ranges(n: int) -> int:
    """Hash ranges for n rows: about 1,000 rows of all sources in each, from 64 to 65,536 ranges."""
    return min(max(64, n // 1000), 65536)


def stratified_shards(documents: DataFrame, shards: int, *, seed: int = 17, id_col: str = "doc_id", stratum_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, source, law, shard, slot and grown_shard of every row of documents.

    The law is ``rows``: shards hold equally many rows, one more or less; slots count from 0 without gaps. A null
    source is a stratum of its own; a null text has size 8 and the checksum of no bytes. Rows with equal ids and
    texts are ranked one after the other, so ties change nothing but which of the equal rows is meant. Rows with a
    null id take part like others. An empty table gives no rows. grown_shard is always null under this law.
    Equal texts aren't kept in one shard: no law of whole groups can hold together with equal counts.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = documents.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.col(stratum_col).cast("string").alias("source")
    )
    seeded = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32"), F.col("size"))
    stratum = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = materialise(rows.select("*", F.md5(seeded).alias("_key"), stratum.alias("_stratum")), "shard-rows")
    total = rows.count()
    n = _ranges(total)
    tie = [F.col("_key"), F.col("doc_id"), F.col("text_crc32")]
    hashed = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    ranked = place(rows.withColumn("_range", F.shiftright(hashed * n, 32).cast("int")), ["_stratum"], "_range", tie, "_rank")
    ranked = join_hot(ranked, rows.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_of")), ["_stratum"], ["_key"])
    fraction = (F.col("_rank") + 0.5) / F.col("_of")
    ranked = ranked.withColumn("_fraction", fraction).withColumn("_range", F.least(F.lit(n - 1), (fraction * n).cast("int")))
    ranked = materialise(ranked.drop("_of", "_rank"), "shard-ranks")
    placed = place(ranked, [], "_range", [F.col("_fraction"), F.col("_stratum"), *tie], "_at")
    shard = F.expr(f"_at * {shards} div {max(total, 1)}")
    first = F.expr(f"(_shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("_shard", shard).select(
        "doc_id", "size", "text_crc32", "source", F.lit(LAW).alias("law"), F.col("_shard").cast("int").alias("shard"), (F.col("_at") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
