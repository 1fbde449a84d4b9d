"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r, the expected number of its copies. Among all rates from 0 to the largest allowed that
give every source its target in words, those closest to 1 in relative entropy have the form min(most, exp(lambda x)),
x being the document's size over its source's mean: one multiplier for each source's constraint. Newton steps, kept
inside a shrinking bracket, solve the convex dual; every step is one aggregation over the histogram of sizes by
source, so its cost depends on distinct sizes and not on documents, and a hot source is summed up by partial sums.

Rates become copies by size classes, largest first: a class takes as many extra copies as the words still owed need,
and what they miss passes to the next smaller class, so a source ends about one small document off its target.
Within a class the extra copies go to evenly spaced documents in a seeded order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.storage import materialise
from claimgraph.llm.ranks import join_hot, place

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
#: Size classes are this far apart, as a ratio.
CLASS_RATIO = 1.1
STEPS, TOLERANCE = 60, 1e-9
#: Steps between two writes of the multipliers.
AT_ONCE = 3
ROWS_A_PIECE = 50_000_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], most: float) -> DataFrame:
    """_source, source_size and target of each source: shares of all words by weight, none above most times its size.

    Sources in code-point order, the null source last, take the weights in turn. What a source can't take is shared
    again among the others: the level at which all is given away is found along the sources in the order in which
    they fill up. There is a row for each source, so these windows see no documents.
    """
    each = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("_source") == "", "_source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    each = each.withColumn("weight", weight.cast("double")).withColumn("full", most * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    filling = Window.orderBy(F.col("full") / F.col("weight"), "_source")
    owed = F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = owed / F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    each = each.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.col("level"))).over(everything))
    target = F.least(F.col("full"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return each.select("_source", "source_size", target.cast("double").alias("target"))


def _stepped(state: DataFrame, histogram: DataFrame, most: float) -> DataFrame:
    """state after one Newton step, or a halving where the step leaves the bracket, for all sources that aren't done."""
    x = F.col("size") / F.col("mean_size")
    rate = F.least(F.lit(float(most)), F.exp(F.least(F.col("lambda") * x, F.lit(50.0))))
    sums = histogram.join(state.filter(~F.col("done")).select("_source", "lambda", "mean_size"), "_source").groupBy("_source").agg(
        F.sum(F.col("n") * rate * F.col("size")).alias("given"), F.sum(F.when(rate < most, F.col("n") * rate * F.col("size") * x).otherwise(0.0)).alias("slope")
    )
    gap = F.col("given") - F.col("target")
    over = gap > 0
    low, high = F.when(over, F.col("low")).otherwise(F.col("lambda")), F.when(over, F.col("lambda")).otherwise(F.col("high"))
    newton = F.col("lambda") - gap / F.col("slope")
    step = F.when((F.col("slope") > 0) & (newton > low) & (newton < high), newton).otherwise((low + high) / 2)
    still = F.col("given").isNull() | (F.abs(gap) <= TOLERANCE * F.col("target"))
    keep = lambda c, new: F.when(still, F.col(c)).otherwise(new).alias(c)
    return state.join(sums, "_source", "left").select("_source", "source_size", "target", "mean_size", "least", keep("lambda", step), keep("low", low), keep("high", high), (F.col("done") | still).alias("done"))


def solve_rates(sizes: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """targets with lambda and mean_size: the multipliers for which rates of min(most, exp(lambda x)) meet them."""
    histogram = materialise(sizes.filter("size > 0").groupBy("_source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    shape = histogram.groupBy("_source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean_size"), F.min("size").alias("least"))
    smallest = F.col("least") / F.col("mean_size")
    state = targets.join(shape, "_source", "left").select(
        "*", F.lit(0.0).alias("lambda"), (F.lit(-60.0) / smallest).alias("low"), (F.lit(math.log(most) + 1e-6) / smallest).alias("high"), F.lit(False).alias("done")
    )
    state = materialise(state, "mix-state")
    for _ in range(-(-STEPS // AT_ONCE)):
        for _ in range(AT_ONCE):
            state = _stepped(state, histogram, most)
        state = materialise(state, "mix-state")
        if state.filter(~F.col("done")).isEmpty():
            break
    else:
        raise RuntimeError(f"a source has not met its target in {STEPS} steps")
    return state.select("_source", "source_size", "target", "mean_size", F.round("lambda", 9).alias("lambda"))


def mix(documents: DataFrame, *, weights: list[int], most: int = MOST, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row for each row of documents: doc_id, source, size, source_size, target, copies and taken (copies x size).

    size counts words; a null text has none and is never taken. A null source is a source of its own, the last one.
    Documents of equal size and source are ordered by a seeded hash of their id; repeated rows are documents of their
    own; a null id is an id. An empty table gives no rows. copies is at most ``most``. The same rows give the same
    copies on every run. Other columns are ignored.
    """
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), source.alias("_source"), words(F.col(text_col)).alias("size"))
    rows = materialise(rows, "mix-sizes")
    state = solve_rates(rows, source_targets(rows, weights, most), most)
    rate = F.least(F.lit(float(most)), F.exp(F.col("lambda") * F.col("size") / F.col("mean_size")))
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("target") >= most * F.col("source_size"), float(most)).otherwise(rate)
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = join_hot(rows, state, ["_source"], ["doc_id", "size"]).withColumn("_rate", rate).withColumn("_whole", F.floor("_rate"))
    rows = rows.withColumn("_class", F.when((F.col("size") > 0) & (F.col("_rate") < most), F.floor(F.log("size") / math.log(CLASS_RATIO))).otherwise(F.lit(-1)).cast("int"))
    pieces = max(16, rows.count() // ROWS_A_PIECE)
    rows = materialise(rows.select("doc_id", "source", "_source", "size", "source_size", "target", "_rate", "_whole", "_class", order.alias("_order"), F.pmod(order, F.lit(pieces)).cast("int").alias("_piece")), "mix-rates")
    classes = rows.filter("_class >= 0").groupBy("_source", "_class").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("size").alias("mean"), F.round(F.sum((F.col("_rate") - F.col("_whole")) * F.col("size")), 6).alias("owed")
    )
    extra = "greatest(0D, least(x.n, round((acc.rest + x.owed) / x.mean)))"
    fold = f"""aggregate(classes, named_struct('rest', 0D, 'given', cast(array() as array<struct<c:int,n:double,k:double>>)),
        (acc, x) -> named_struct('rest', acc.rest + x.owed - {extra} * x.mean, 'given', concat(acc.given, array(named_struct('c', -x.c, 'n', x.n, 'k', {extra})))), acc -> acc.given)"""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("_class")).alias("c"), "n", "mean", "owed"))).alias("classes")
    given = classes.groupBy("_source").agg(ordered).select("_source", F.explode(F.expr(fold)).alias("g")).select("_source", F.col("g.c").alias("_class"), F.col("g.n").cast("long").alias("_n"), F.col("g.k").cast("long").alias("_k"))
    placed = place(rows, ["_source", "_class"], "_piece", [F.col("size"), F.col("_order"), F.col("doc_id")], "_at")
    placed = placed.join(given, ["_source", "_class"], "left")
    chosen = F.when(F.col("_n").isNull(), 0).otherwise(F.expr("(_at + 1) * _k div _n - _at * _k div _n"))
    copies = (F.col("_whole") + chosen).cast("int")
    return placed.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def resample(documents: DataFrame, **options) -> DataFrame:
    """documents with each row as often as the mix takes it, not at all included. Equal rows are taken equally often.

    Nulls, empty texts and repeated rows count as in mix. A row travels whole, so its columns may have any names.
    """
    copies = mix(documents.select("doc_id", "source", "text"), **options)
    copies = copies.groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).filter("copies > 0").alias("c")
    rows = documents.select(F.struct("*").alias("row"), "doc_id", "source", words(F.col("text")).alias("size")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.size") == F.col("c.size"))
    return rows.join(copies, same).select("row", F.explode(F.sequence(F.lit(1), F.col("c.copies")))).select("row.*")
