"""K1-K9: what a concept graph lacks: isolated concepts, unstable and contradictory claims, missing bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.storage import materialise
from claimgraph.operators.graph import degrees, undirected
from claimgraph.operators.similarity import cosine_join, usable_vectors


def isolated(concepts: DataFrame, edges: DataFrame, *, limit: int = 100) -> DataFrame:
    """K1: concepts whose degree is under half the median, the least connected first; ties by id.

    The median is the element at half the number of sorted degrees, taken from their histogram; 2 where it is 0.
    """
    nodes = concepts.select("id").join(degrees(edges), F.col("id") == F.col("node"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    one = Window.partitionBy(F.lit(0))
    histogram = nodes.groupBy("degree").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(one.orderBy("degree"))).withColumn("all", F.sum("n").over(one))
    median = histogram.agg(F.min(F.when(F.col("upto") > F.expr("all div 2"), F.col("degree"))).alias("_m"))
    least = median.select(F.greatest(F.lit(1), F.expr("(CASE WHEN coalesce(_m, 0) = 0 THEN 2 ELSE _m END) div 2")).alias("threshold"))
    priority = F.round(F.least(F.lit(1.0), 0.4 * (2 - F.col("degree") / F.col("threshold"))), 4)
    return nodes.crossJoin(F.broadcast(least)).filter("degree < threshold").orderBy("degree", "id").limit(limit).select(F.col("id").cast("string").alias("subject"), "degree", priority.alias("priority"))


def unstable(votes: DataFrame, *, limit: int = 100, std: str = "estimated", least: float = 0.2) -> DataFrame:
    """K2: claims told often whose confidence varies; std is "estimated" from the number of models, or "sample"."""
    groups = votes.groupBy("subject", "relation", "object").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("model").alias("m"), F.stddev_samp("confidence").alias("s")).filter("n > 1")
    top = groups.orderBy(F.desc("n"), "subject", "relation", "object").limit(2 * limit)
    spread = F.col("s") if std == "sample" else F.when(F.col("n") > 2, F.least(F.lit(0.4), 0.1 * F.col("m"))).otherwise(0.15)
    rows = top.withColumn("std", spread).filter(F.col("std") >= least)
    priority = F.least(F.lit(1.0), 0.5 * F.col("std") * 3 * (1 + F.least(F.lit(1.0), F.col("n") / 5)))
    return rows.select("subject", "relation", "object", "n", F.round("std", 4).alias("std"), F.round(priority, 4).alias("priority"))


def weak_relations(edges: DataFrame, *, below: float = 0.6, limit: int = 100) -> DataFrame:
    """K3."""
    return edges.filter(F.col("weight") < below).orderBy("weight", "source", "target").limit(limit).select("source", "target", "weight", F.lit(0.25).alias("std"))


def contradictions(edges: DataFrame, incompatible: DataFrame) -> DataFrame:
    """K4: pairs of edges between the same two nodes whose relations exclude each other.

    incompatible (left, right, direction): same, reversed or both. Each unordered pair of edges appears once. Only the
    least confidence of each directed relation counts, so edges are summed up before any two meet.
    """
    sure = F.min(F.coalesce("confidence", F.lit(1.0))).alias("c")
    keyed = edges.groupBy("source", "target", "relation_type").agg(sure).withColumns({"a": F.least("source", "target"), "b": F.greatest("source", "target")})
    x, y = keyed.alias("x"), keyed.alias("y")
    same = F.col("x.source") == F.col("y.source")
    pairs = x.join(y, (F.col("x.a") == F.col("y.a")) & (F.col("x.b") == F.col("y.b")) & (F.col("x.relation_type") < F.col("y.relation_type")))
    pairs = pairs.select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("x.relation_type").alias("first"), F.col("y.relation_type").alias("second"), F.when(same, "same").otherwise("reversed").alias("direction"), F.least("x.c", "y.c").alias("c"))
    rules = incompatible.select(F.least("left", "right").alias("first"), F.greatest("left", "right").alias("second"), F.col("direction").alias("_d")).distinct()
    hit = pairs.join(rules, ["first", "second"]).filter((F.col("_d") == "both") | (F.col("_d") == F.col("direction")))
    return hit.groupBy("a", "b", "first", "second", "direction").agg(F.round(0.9 + 0.1 * F.min("c"), 4).alias("priority"))


def clusters(edges: DataFrame) -> DataFrame:
    """K5: (cluster, id, place, size): concepts that share their heaviest neighbour, two and more of them."""
    first = edges.groupBy(F.col("source").alias("id")).agg(F.min_by("target", F.struct((-F.col("weight")).alias("w"), "target")).alias("cluster"))
    of = Window.partitionBy("cluster")
    return first.withColumn("size", F.count(F.lit(1)).over(of)).withColumn("place", F.row_number().over(of.orderBy("id"))).filter("size > 1")


def bridges(edges: DataFrame, vectors: DataFrame, *, least: float = 0.6) -> DataFrame:
    """K5: pairs of clusters that are alike and not linked. vectors (id, embedding) are the concepts'.

    The likeness is the mean cosine over all pairs of the first three members of each that have vectors, low and
    negative ones too. It is the product of the clusters' mean unit vectors, so clusters meet as vectors of that length:
    the join by angle finds those that can reach ``least`` and no pair of members is formed. A zero vector has the
    cosine 0 with any other. A cross edge among the first ten of each rules the pair out.
    """
    member = clusters(edges)
    few = member.filter("place <= 3").select("cluster", "id", "size")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.transform("embedding", lambda x: F.when(F.col("_norm") > 0, x.cast("double") / F.col("_norm")).otherwise(0.0))
    known = usable_vectors(vectors).withColumn("_norm", norm).select("id", unit.alias("u"), F.size("embedding").alias("d"))
    mean = few.join(known, "id").select("cluster", "size", "d", F.posexplode("u")).groupBy("cluster", "size", "d", "pos").agg(F.sum("col").alias("s"), F.count(F.lit(1)).alias("n"))
    mean = mean.groupBy("cluster", "size", "d").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("s") / F.col("n")).alias("x")))), lambda p: p["x"]).alias("embedding"))
    mean = materialise(mean.withColumn("length", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))), "cluster-means")
    near = cosine_join(mean.select(F.col("cluster").alias("id"), "embedding"), least)
    side = lambda name, n, length: mean.select(F.col("cluster").alias(name), F.col("size").alias(n), "d", F.col("length").alias(length))
    alike = near.join(side("a", "na", "la"), "a").join(side("b", "nb", "lb"), ["b", "d"]).withColumn("sim", F.col("similarity") * F.col("la") * F.col("lb")).filter(F.col("sim") >= least)
    alike = alike.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "na", "nb", "sim")
    ten = member.filter("place <= 10").select("cluster", "id")
    pairs = undirected(edges)
    cross = pairs.join(ten.select(F.col("cluster").alias("p"), F.col("id").alias("a")), "a").join(ten.select(F.col("cluster").alias("q"), F.col("id").alias("b")), "b").filter("p != q").select(F.least("p", "q").alias("ca"), F.greatest("p", "q").alias("cb")).distinct()
    priority = F.least(F.lit(1.0), 0.3 * F.col("sim") * (1 + F.least(F.lit(1.0), (F.col("na") + F.col("nb")) / 20)))
    return alike.join(cross, ["ca", "cb"], "left_anti").select("ca", "cb", F.round("sim", 4).alias("similarity"), F.round(priority, 4).alias("priority"))


def ranked(gaps: list[DataFrame], *, per_type: int = 50) -> DataFrame:
    """K6: gaps (gap_type, key, priority) of all kinds, so many of each, by priority."""
    rows = gaps[0]
    for g in gaps[1:]:
        rows = rows.unionByName(g)
    place = F.row_number().over(Window.partitionBy("gap_type").orderBy(F.desc("priority"), "key"))
    return rows.withColumn("place", place).filter(F.col("place") <= per_type)


def active(gaps: DataFrame, addressed: DataFrame) -> DataFrame:
    """K7: gaps that no later event has addressed."""
    return gaps.join(addressed.select("gap_type", "key").distinct(), ["gap_type", "key"], "left_anti")


def same_gaps(now: DataFrame, before: DataFrame) -> DataFrame:
    """K8: whether two runs found the same gaps, by an order-free checksum of each."""
    def mark(df: DataFrame, name: str) -> DataFrame:
        h = F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)])
        return df.agg(F.count(F.lit(1)).alias(f"{name}_n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias(f"{name}_h"))
    both = mark(now, "now").crossJoin(F.broadcast(mark(before, "before")))
    return both.select((F.col("now_n") == F.col("before_n")).alias("same_size"), ((F.col("now_n") == F.col("before_n")) & (F.col("now_h") == F.col("before_h"))).alias("converged"))


#: K9: gaps that a kind of cycle looks at, and what tops them up.
MODES = {"divergent": (["isolated"], "degree"), "debate": (["unstable", "contradiction"], "weight"), "meta": (["bridge"], "recent")}


def targets(gaps: DataFrame, mode: str, *, degrees: DataFrame | None = None, edges: DataFrame | None = None, recent: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """K9: concepts to look at next: those of gaps (gap_type, id, priority) of the mode by priority, then others.

    divergent tops up by degrees (id, degree) below ten, the least connected first; debate by the ends of edges (source,
    target, weight) of a weight below 0.7, the weakest first; meta by recent (id, at), the latest first. Ties by id.
    """
    kinds, then = MODES[mode]
    first = gaps.filter(F.col("gap_type").isin(kinds)).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("stage"), (-F.col("priority")).cast("double").alias("rank"))
    if then == "degree":
        more = degrees.filter("degree < 10").select("id", F.col("degree").alias("rank"))
    elif then == "weight":
        more = edges.filter("weight < 0.7").select(F.explode(F.array("source", "target")).alias("id"), F.col("weight").alias("rank"))
    else:
        more = recent.select("id", (-F.unix_micros(F.col("at").cast("timestamp"))).alias("rank"))
    more = more.select(F.col("id").cast("string").alias("id"), F.lit(1).alias("stage"), F.col("rank").cast("double").alias("rank"))
    best = first.unionByName(more).groupBy("id").agg(F.min(F.struct("stage", "rank")).alias("o"))
    return best.orderBy("o", "id").limit(limit).select("id", F.col("o.stage").alias("stage"))
