"""Neighbours, degrees, curvature, changes, coverage and signatures of a weighted concept graph.

Edges are (source, target, weight, relation_type, confidence, model_source). "Touching a node" is an explode of both
ends and then an equi-join, never a join with OR.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.storage import materialise, release
from claimgraph.functions.versioned import VersionedTable
from claimgraph.operators.triangles import common_target_changes, common_targets, triangles


#: Pairs of seeds of two blocks of ends, about; a tile holds those of both orders.
PAIRS_A_TILE = 125_000


def incident(edges: DataFrame) -> DataFrame:
    """A row for each edge and node that it touches; a self-loop touches its node once."""
    return edges.withColumn("node", F.explode(F.array_distinct(F.array("source", "target"))))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct pairs a < b that have an edge."""
    return edges.filter("source != target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def neighbours(edges: DataFrame, *, k: int = 10, least_weight: float = 0.0) -> DataFrame:
    """G1: each source's k heaviest outgoing edges."""
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("weight"), "target"))
    return edges.filter(F.col("weight") >= least_weight).withColumn("place", place).filter(F.col("place") <= k).select("source", "target", "weight", "place")


def neighbours_of(edges: DataFrame, sources: DataFrame, *, k: int = 20, least_weight: float = 0.0) -> DataFrame:
    """The k heaviest edges that leave any of the sources."""
    return edges.join(sources.select("source").distinct(), "source", "left_semi").filter(F.col("weight") >= least_weight).orderBy(F.desc("weight"), "source", "target").limit(k).select("source", "target", "weight")


def search(concepts: DataFrame, edges: DataFrame, pattern: str, *, k: int = 20) -> DataFrame:
    """Concepts (id, name, rho) whose name is like the pattern, best connected first, then by rho."""
    found = concepts.filter(F.col("name").like(pattern)).join(degrees(edges), F.col("id") == F.col("node"), "left")
    return found.select("id", "name", F.coalesce("degree", F.lit(0)).alias("degree"), "rho").orderBy(F.desc("degree"), F.desc("rho"), "id").limit(k)


def degrees(edges: DataFrame) -> DataFrame:
    """Incident edges, derived rather than stored."""
    return incident(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def curvature_counts(edges: DataFrame, *, of: DataFrame | None = None) -> DataFrame:
    """What G5 rests on, of every edge or of the edges (source, target) of ``of``: weight, the degrees of both ends
    (du, dv), how many targets each has (nu, nv), and how many they have in common (both).

    Common targets are counted by colours of nodes, so that no hub's neighbours are gathered in one row or task.
    """
    degree, out = degrees(edges), edges.select("source", "target").distinct()
    wanted = edges.select("source", "target", "weight") if of is None else edges.join(of.select("source", "target").distinct(), ["source", "target"], "left_semi").select("source", "target", "weight")
    sizes = out.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    common = common_targets(out, None if of is None else wanted.select("source", "target").distinct())
    side = lambda table, key, names: table.select(F.col(key).alias(names[0]), F.col(table.columns[1]).alias(names[1]))
    rows = wanted.join(side(degree, "node", ("source", "du")), "source").join(side(degree, "node", ("target", "dv")), "target")
    rows = rows.join(side(sizes, "source", ("source", "nu")), "source", "left").join(side(sizes, "source", ("target", "nv")), "target", "left").join(common, ["source", "target"], "left")
    return rows.select("source", "target", "weight", "du", "dv", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("nu", "nv", "both")))


def curvature_of_counts(counts: DataFrame, *, alpha: float = 0.5, weightless: float = 0.0) -> DataFrame:
    """Ollivier, jaccard and hybrid curvature of edges whose counts are known; weightless is ollivier at a weight of 0."""
    union = F.col("nu") + F.col("nv") - F.col("both")
    ollivier = F.when((F.col("du") > 0) & (F.col("dv") > 0) & (F.col("weight") != 0), 1 / F.col("du") + 1 / F.col("dv") - 2 / F.col("weight")).otherwise(weightless)
    jaccard = F.when(union > 0, F.col("both") / union).otherwise(0.0)
    hybrid = alpha * (F.tanh(ollivier) + 1) / 2 + (1 - alpha) * jaccard
    # the double's product is rounded, as the SQL does, and not its shortest decimal: they differ next to halves
    r = lambda x, name: (F.round(x * 1e6) / 1e6).alias(name)
    return counts.select("source", "target", r(ollivier, "ollivier"), r(jaccard, "jaccard"), r(hybrid, "hybrid"))


def curvature(edges: DataFrame, *, alpha: float = 0.5, of: DataFrame | None = None) -> DataFrame:
    """Ollivier, jaccard and hybrid curvature of every edge, or of the edges (source, target) of ``of``."""
    return curvature_of_counts(curvature_counts(edges, of=of), alpha=alpha)


def changed_counts(was: DataFrame, now: DataFrame, nodes: DataFrame) -> DataFrame:
    """The counts of curvature_counts, as of now, of all edges that touch nodes, from their counts before.

    was holds the counts of all edges that touched nodes (node), now all edges (source, target, weight) that touch them;
    every edge that came or went has both ends among nodes. Common targets are carried on by what the changes add and
    take away; an end that isn't among nodes keeps its counts. An edge is one row. Nothing beyond these edges is read.
    """
    edge = ["source", "target"]
    was, now, nodes = materialise(was, "counts-was"), materialise(now.select(*edge, "weight"), "counts-now"), materialise(nodes.select("node").distinct(), "counts-nodes")
    came, went = now.select(*edge).join(was, edge, "left_anti"), was.select(*edge).join(now, edge, "left_anti")
    kept = materialise(was.drop("weight").join(now, edge), "counts-kept")
    gained = common_target_changes(kept, was, now, came.withColumn("sign", F.lit(1)).unionByName(went.withColumn("sign", F.lit(-1))))
    fresh = common_targets(now.select(*edge), came)
    both = gained.unionByName(fresh).withColumnRenamed("both", "more")
    of_node = nodes.join(degrees(now), "node", "left").join(now.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("n")), "node", "left")
    of_node = of_node.select("node", F.coalesce("degree", F.lit(0).cast("long")).alias("d"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    rows = kept.unionByName(came.join(now, edge), allowMissingColumns=True).join(both, edge, "left")
    for end, d, n in (("source", "du", "nu"), ("target", "dv", "nv")):
        own = of_node.select(F.col("node").alias(end), F.col("d").alias("_d"), F.col("n").alias("_n"))
        rows = rows.join(own, end, "left").withColumns({d: F.coalesce("_d", d), n: F.coalesce("_n", n)}).drop("_d", "_n")
    zero = F.lit(0).cast("long")
    made = rows.select(*edge, "weight", "du", "dv", "nu", "nv", (F.coalesce("both", zero) + F.coalesce("more", zero)).alias("both"))
    made = materialise(made, "counts-made")
    release(was, now, nodes, kept, gained)
    return made


def curvature_history(history: DataFrame, edges: DataFrame, touched: DataFrame, at: str) -> DataFrame:
    """History (source, target, hybrid, at) and the curvature, as of now, of all edges that touched ones make dirty."""
    now = curvature(edges, of=dirty_edges(edges, touched)).select("source", "target", "hybrid", F.lit(at).cast("timestamp").alias("at"))
    return history.select("source", "target", "hybrid", "at").unionByName(now)


def dirty_edges(edges: DataFrame, touched: DataFrame) -> DataFrame:
    """Edges (source, target) that share an end with a touched one and so need their curvature again."""
    ends = incident(touched.select("source", "target")).select("node").distinct()
    return incident(edges.select("source", "target")).join(ends, "node", "left_semi").select("source", "target").distinct()


def valid_deltas(deltas: DataFrame) -> DataFrame:
    """(…, valid): known operation, ends where an edge needs them, no self-loop, a weight in [0, 1] for edges.

    A confidence, where there is such a column, must lie in [0, 1].
    """
    edge = F.col("operation").isin("add_edge", "update_edge", "delete_edge")
    ends = F.col("source").isNotNull() & (~edge | (F.col("target").isNotNull() & (F.col("source") != F.col("target"))))
    weight = ~F.col("operation").isin("add_edge", "update_edge") | F.coalesce((F.col("weight") >= 0) & (F.col("weight") <= 1), F.lit(False))
    sure = F.coalesce(F.col("confidence").between(0, 1), F.lit(False)) if "confidence" in deltas.columns else F.lit(True)
    return deltas.withColumn("valid", (edge | (F.col("operation").isin("add_node", "delete_node"))) & ends & weight & sure)


def batch_allowed(deltas: DataFrame, nodes: DataFrame, edges: DataFrame, share: float = 0.05) -> DataFrame:
    """Per session, whether a batch is at most this share of the graph's nodes and edges, one at least."""
    n, e = nodes.agg(F.count(F.lit(1)).alias("_n")), edges.agg(F.count(F.lit(1)).alias("_e"))
    most = F.greatest(F.lit(1), F.floor((F.col("_n") + F.col("_e")) * share))
    return deltas.groupBy("session").agg(F.count(F.lit(1)).alias("changes")).crossJoin(n).crossJoin(e).select("session", "changes", (F.col("changes") <= most).alias("allowed"))


def accepted_deltas(deltas: DataFrame, nodes: DataFrame, edges: DataFrame, share: float = 0.05) -> DataFrame:
    """The valid changes of the batches that are small enough."""
    small = batch_allowed(deltas, nodes, edges, share).filter("allowed").select("session")
    return valid_deltas(deltas).filter("valid").drop("valid").join(small, "session", "left_semi")


def _at(operations: list[str], *more: str) -> Column:
    """The (ts, id, …) of rows of these operations."""
    return F.when(F.col("operation").isin(operations), F.struct("ts", "id", *more))


def _order(c: str) -> Column:
    return F.struct(F.col(f"{c}.ts"), F.col(f"{c}.id"))


def apply_deltas(edges: DataFrame, deltas: DataFrame) -> DataFrame:
    """Edges (source, target, weight) after changes (operation, source, target, weight, ts, id) in order.

    An edge is there if the last thing that made or ended it made it: its own addition or deletion, or the deletion of
    an end, which takes the edges of that node along. Its weight is that of the last addition or update since then; an
    update of an edge that isn't there does nothing. Only the last change of each kind is kept of an edge, by partial
    maxima, so an edge with very many changes isn't gathered. Invalid changes are left out.
    """
    good = valid_deltas(deltas).filter("valid")
    of_edge = good.filter(F.col("operation").isin("add_edge", "update_edge", "delete_edge")).groupBy("source", "target").agg(
        F.max(_at(["add_edge"])).alias("_add"), F.max(_at(["delete_edge"])).alias("_end"), F.max(_at(["add_edge", "update_edge"], "weight")).alias("_set")
    )
    gone = good.filter("operation = 'delete_node'").groupBy("source").agg(F.max(F.struct("ts", "id")).alias("_gone"))
    both = edges.select("source", "target", F.col("weight").alias("_old")).join(of_edge, ["source", "target"], "full")
    both = both.join(gone.withColumnRenamed("_gone", "_a"), "source", "left").join(gone.select(F.col("source").alias("target"), F.col("_gone").alias("_b")), "target", "left")
    end = F.greatest("_end", "_a", "_b")
    there = F.when(end.isNull(), F.col("_add").isNotNull() | F.col("_old").isNotNull()).otherwise(F.coalesce(F.col("_add") > end, F.lit(False)))
    since = F.col("_set").isNotNull() & (end.isNull() | (_order("_set") > end))
    weight = F.when(there, F.when(since, F.col("_set.weight")).otherwise(F.col("_old")))
    return both.select("source", "target", weight.alias("weight")).filter("weight is not null")


def apply_node_deltas(nodes: DataFrame, deltas: DataFrame) -> DataFrame:
    """Nodes (id) after changes: those added last, and those there before that no change deleted."""
    last = valid_deltas(deltas).filter(F.col("valid") & F.col("operation").isin("add_node", "delete_node")).groupBy(F.col("source").alias("id")).agg(F.max_by("operation", F.struct("ts", "id")).alias("_last"))
    rows = nodes.select("id", F.lit(True).alias("_there")).join(last, "id", "full")
    return rows.filter(F.coalesce(F.col("_last") == "add_node", F.col("_there"))).select("id")


def upsert_edges(current: DataFrame, new: DataFrame, policy: str = "average") -> DataFrame:
    """Edges after rows (source, target, weight, ord) and what of confidence, kappa, relation_type both tables have.

    "average" folds weights in order, each time to the mean of what was and what comes, "max" keeps the largest,
    "replace" the last. Confidence is folded like an average, kappa is the last, the type is the first and stays. The
    fold is a sum in which each row counts half as much as the next one: no edge's rows are gathered in an array.
    """
    newest = F.row_number().over(Window.partitionBy("source", "target").orderBy(F.desc("ord")))
    extra = [c for c in ("confidence", "kappa", "relation_type") if c in new.columns and c in current.columns]
    rows = new.withColumn("_r", newest).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("source", "target")))
    oldest = F.col("_r") == F.col("_n")
    folds = [c for c in ("weight", "confidence") if c == "weight" or c in extra]
    half = lambda c: F.sum(F.col(c) * F.pow(F.lit(0.5), F.col("_r")))
    sums = rows.groupBy("source", "target").agg(
        F.count(F.lit(1)).alias("_n"), F.max("weight").alias("_max"), *[x for c in folds for x in (half(c).alias(f"_half_{c}"), F.max(F.when(oldest, F.col(c))).alias(f"_first_{c}"))],
        F.max(F.when(F.col("_r") == 1, F.col("weight"))).alias("_last"), *([F.max(F.when(F.col("_r") == 1, F.col("kappa"))).alias("_kappa")] if "kappa" in extra else []),
        *([F.max(F.when(oldest, F.col("relation_type"))).alias("_type")] if "relation_type" in extra else []),
    )
    both = current.select("source", "target", F.col("weight").alias("_old"), *[F.col(c).alias(f"_old_{c}") for c in extra]).join(sums, ["source", "target"], "full")

    def average(c: str, old: str) -> Column:
        # without an old value the first row stands for it: it counts twice its half
        start = F.coalesce(F.col(old), F.col(f"_first_{c}")) * F.pow(F.lit(0.5), F.col("_n"))
        return F.when(F.col("_n").isNull(), F.col(old)).otherwise(F.col(f"_half_{c}") + start)

    weight = {"average": average("weight", "_old"), "max": F.greatest("_old", "_max"), "replace": F.coalesce("_last", "_old")}[policy]
    more = {"confidence": F.round(average("confidence", "_old_confidence"), 12) if "confidence" in extra else None, "kappa": F.coalesce("_kappa", "_old_kappa") if "kappa" in extra else None, "relation_type": F.coalesce("_old_relation_type", "_type") if "relation_type" in extra else None}
    return both.select("source", "target", F.round(weight, 12).alias("weight"), *[more[c].alias(c) for c in extra], F.coalesce("_n", F.lit(0)).alias("extractions"))


def upsert_stored(table: VersionedTable, new: DataFrame, policy: str = "average") -> None:
    """upsert_edges into a stored table of edges; only the buckets of new's edges are rewritten."""
    keys = new.select("source", "target")

    def change(now: DataFrame) -> DataFrame:
        made = upsert_edges(now, new, policy).withColumnRenamed("extractions", "_n")
        found = made.join(now.select("source", "target", "extractions"), ["source", "target"], "left")
        return found.withColumn("extractions", F.coalesce("extractions", F.lit(0)) + F.col("_n")).drop("_n")

    table.update(keys, change)


def to_undo(deltas: DataFrame, session: Column, *, since: str | None = None, ids: list[int] | None = None) -> DataFrame:
    """Deltas of the sessions for which ``session`` holds that aren't rolled back yet: all, those since a time, or by id."""
    rows = deltas.filter(session & F.col("rolled_back_at").isNull())
    if ids is not None:
        return rows.filter(F.col("id").isin(ids))
    return rows if since is None else rows.filter(F.col("ts") >= F.lit(since).cast("timestamp"))


def roll_back(edges: DataFrame, deltas: DataFrame) -> DataFrame:
    """Edges (source, target, weight, kappa) after deltas (…, old_weight, old_kappa, ts, id) are undone, newest first.

    An undone addition deletes the edge, an undone deletion restores it, an undone update sets it back if it is there,
    and an undone addition of a node takes its edges along. What was done first is undone last, so the oldest delta of
    each kind decides, by partial minima; deltas of other sessions in between don't matter. An edge whose old weight is
    unknown isn't restored; an unknown old kappa is one half.
    """
    old = F.struct("ts", "id", "old_weight", "old_kappa")
    known = F.col("old_weight").isNotNull()
    undone = deltas.filter(F.col("operation").isin("add_edge", "delete_edge", "update_edge")).groupBy("source", "target").agg(
        F.min(F.when((F.col("operation") == "add_edge") | ((F.col("operation") == "delete_edge") & known), F.struct("ts", "id", "operation", "old_weight", "old_kappa"))).alias("_made"),
        F.min(F.when((F.col("operation") == "update_edge") & known, old)).alias("_set"),
    )
    gone = deltas.filter("operation = 'add_node'").groupBy("source").agg(F.min(F.struct("ts", "id")).alias("_gone"))
    both = edges.select("source", "target", F.col("weight").alias("_w"), F.col("kappa").alias("_k")).join(undone, ["source", "target"], "full")
    both = both.join(gone.withColumnRenamed("_gone", "_a"), "source", "left").join(gone.select(F.col("source").alias("target"), F.col("_gone").alias("_b")), "target", "left")
    node, made, put = F.least("_a", "_b"), _order("_made"), _order("_set")
    made = F.when(F.col("_made").isNotNull(), made)
    put = F.when(F.col("_set").isNotNull(), put)
    last = F.least(node, made)
    restored = F.coalesce((made == last) & (F.col("_made.operation") == "delete_edge"), F.lit(False))
    there = F.when(last.isNull(), F.col("_w").isNotNull()).otherwise(restored)
    set_back = put.isNotNull() & (last.isNull() | (put < last))
    value = lambda field, now, none: F.when(set_back, F.coalesce(F.col(f"_set.{field}"), none)).when(restored, F.coalesce(F.col(f"_made.{field}"), none)).otherwise(F.col(now))
    rows = both.select("source", "target", there.alias("_there"), value("old_weight", "_w", F.lit(None)).alias("weight"), value("old_kappa", "_k", F.lit(0.5)).alias("kappa"))
    return rows.filter("_there").drop("_there")


def delta_history(deltas: DataFrame, *, session: int | None = None, rolled_back: bool = False, k: int = 100) -> DataFrame:
    """The k newest changes, of a session or of all, without those rolled back unless they are asked for."""
    rows = deltas if session is None else deltas.filter(F.col("session") == session)
    rows = rows if rolled_back else rows.filter(F.col("rolled_back_at").isNull())
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(k)


def mutation_stats(deltas: DataFrame, as_of: str) -> DataFrame:
    """(kind, name, n, rolled_back, avg_confidence): by operation, by model of what stays, and of the last day."""
    kept = F.col("rolled_back_at").isNull()
    of = lambda rows, kind, name: rows.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~kept).alias("rolled_back"), F.round(F.avg("confidence"), 4).alias("avg_confidence")).select(F.lit(kind).alias("kind"), "*")
    day = F.lit(as_of).cast("timestamp") - F.expr("interval 1 day")
    parts = [of(deltas, "operation", F.col("operation")), of(deltas.filter(kept), "model", F.col("model_source")), of(deltas.filter(kept & (F.col("ts") > day)), "last_day", F.lit("all"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def inject_triples(triples: DataFrame, existing: DataFrame, names: DataFrame | None = None, relations: DataFrame | None = None) -> DataFrame:
    """G11 of (key, source, target, relation_type, weight): what happens to each: injected, or why it is skipped.

    names (name, concept) are resolved names: an end that they don't hold is unresolved. relations (relation,
    canonical) replace types; one that they don't hold stays. A repeated key, or a repeated edge, counts once.
    """
    rows = triples
    if names is not None:
        of = names.filter("concept is not null").groupBy("name").agg(F.min("concept").alias("_c"))
        for end in ("source", "target"):
            rows = rows.join(of.withColumnRenamed("name", end), end, "left").drop(end).withColumnRenamed("_c", end)
    if relations is not None:
        of = relations.groupBy(F.col("relation").alias("relation_type")).agg(F.min("canonical").alias("_c"))
        rows = rows.join(of, "relation_type", "left").withColumn("relation_type", F.coalesce("_c", "relation_type")).drop("_c")
    first = F.row_number().over(Window.partitionBy("source", "target", "relation_type").orderBy("key"))
    there = existing.select("source", "target", "relation_type").distinct().withColumn("_there", F.lit(True))
    rows = rows.withColumn("_place", first).join(there, ["source", "target", "relation_type"], "left")
    reason = F.when(F.col("source").isNull() | F.col("target").isNull(), "unresolved").when(F.col("source") == F.col("target"), "self_loop").when(F.col("_place") > 1, "duplicate").when(F.col("_there"), "exists").otherwise("injected")
    return rows.withColumn("outcome", reason).drop("_place", "_there")


def injected_edges(edges: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Edges (source, target, weight) with what inject_triples injects: the larger weight where an edge is there."""
    new = outcomes.filter("outcome = 'injected'").select("source", "target", "weight", F.col("key").alias("ord"))
    return upsert_edges(edges, new, "max").select("source", "target", "weight")


def coverage(concepts: DataFrame, edges: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Density, mean confidence, diversity, isolated share, clustering and the composite.

    Diversity is the entropy over types (node, kind), such as G20 gives, or without them over nodes with at least ten
    edges, at most two, and the others.
    """
    nodes = concepts.select(F.col("id").alias("node")).join(degrees(edges), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("degree") == 0).alias("isolated"), F.count_if(F.col("degree") >= 10).alias("_hub"), F.count_if(F.col("degree") <= 2).alias("_leaf"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.avg("confidence").alias("_conf"))
    c = clustering(edges).agg(F.avg("coefficient").alias("_clustering"))
    rows = n.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(c))
    if types is None:
        kinds = [F.col("_hub"), F.col("_leaf"), F.col("nodes") - F.col("_hub") - F.col("_leaf")]
        used = sum((F.when(k > 0, 1).otherwise(0) for k in kinds), F.lit(0))
        entropy = sum((F.when(k > 0, -(k / F.col("nodes")) * F.ln(k / F.col("nodes"))).otherwise(0.0) for k in kinds), F.lit(0.0))
    else:
        each = types.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
        rows = rows.crossJoin(F.broadcast(each.agg(F.count(F.lit(1)).alias("_used"), F.sum("n").alias("_all"), F.sum(F.col("n") * F.ln("n")).alias("_nln"))))
        used, entropy = F.col("_used"), F.ln("_all") - F.col("_nln") / F.col("_all")
    density = F.when(F.col("nodes") < 2, 0.0).otherwise(F.least(F.lit(1.0), F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))))
    diversity = F.when(used > 1, entropy / F.ln(used)).otherwise(0.0)
    stability = F.coalesce("_clustering", F.lit(0.0))
    r = lambda x, name: F.round(x, 4).alias(name)
    return rows.select("nodes", "edges", r(density, "density"), r(F.coalesce("_conf", F.lit(0.0)), "consensus_density"), r(diversity, "diversity"), r(F.col("isolated") / F.col("nodes"), "isolated_ratio"), r(stability, "clustering"), r(0.4 * density + 0.3 * diversity + 0.3 * stability, "composite"))


def clustering(edges: DataFrame) -> DataFrame:
    """(node, degree, triangles, coefficient) of nodes with two neighbours or more.

    Each undirected edge points from its end of lower degree to the other, so that no node has more arcs than the square
    root of the edges; triangles are counted by colours of nodes.
    """
    pairs = undirected(edges)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    da, db = degree.select(F.col("node").alias("a"), F.col("degree").alias("da")), degree.select(F.col("node").alias("b"), F.col("degree").alias("db"))
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    arcs = pairs.join(da, "a").join(db, "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("source"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("target"))
    rows = degree.filter("degree >= 2").join(triangles(arcs), "node", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    return rows.withColumn("coefficient", F.col("triangles") / (F.col("degree") * (F.col("degree") - 1) / 2))


def candidates(votes: DataFrame, edges: DataFrame, *, least: int = 2) -> DataFrame:
    """G18 of votes (subject, object, model, confidence): concepts with enough extractions or edges."""
    touched = votes.withColumn("node", F.explode(F.array_distinct(F.array("subject", "object"))))
    found = touched.groupBy("node").agg(F.count(F.lit(1)).alias("extractions"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.countDistinct("model").alias("models"))
    rows = found.join(degrees(edges), "node", "full")
    rows = rows.select("node", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("extractions", "models", "degree")], "avg_confidence")
    return rows.filter((F.col("extractions") >= least) | (F.col("degree") >= least))


def cochain(edges: DataFrame) -> DataFrame:
    """Five scores of every node with an edge, and its type by the 20th and 80th percentile of degrees."""
    ends = incident(edges)
    sums = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.avg("weight").alias("_w"), F.countDistinct("model_source").alias("_m"))
    by_type = ends.groupBy("node", "relation_type").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.count(F.lit(1)).alias("_k"), F.sum(F.col("n") * F.ln("n")).alias("_nln"), F.sum("n").alias("_n"))
    rows = sums.join(by_type, "node").crossJoin(F.broadcast(sums.agg(F.max("degree").alias("_max")))).crossJoin(F.broadcast(_degree_bounds(sums)))
    centrality = F.col("degree") / F.col("_max")
    diversity = F.when(F.col("_k") > 1, (F.ln("_n") - F.col("_nln") / F.col("_n")) / F.ln("_k")).otherwise(0.0)
    agreement = F.least(F.lit(1.0), F.greatest(F.col("_m"), F.lit(1)) / 3)
    stability = F.least(F.lit(1.0), F.col("degree") / 10) * F.col("_w")
    kind = F.when((F.col("degree") > F.col("_p80")) & (diversity > 0.5), "generalist").when(F.col("degree") < F.col("_p20"), "specialised").otherwise("hybrid")
    r = lambda x, name: F.round(x, 4).alias(name)
    return rows.select("node", "degree", F.round(F.when(F.col("_w") == 0, 0.5).otherwise(F.col("_w")), 9).alias("consensus"), r(agreement, "agreement"), r(centrality, "centrality"), F.round(stability, 9).alias("stability"), r(diversity, "diversity"), r(1 - diversity, "consistency"), kind.alias("kind"))


def _degree_bounds(sums: DataFrame) -> DataFrame:
    """The sorted degrees at places int(.2 n) and int(.8 n), exactly, from the histogram of degrees."""
    histogram = sums.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy(F.lit(0))
    rows = histogram.withColumn("upto", F.sum("n").over(one.orderBy("degree"))).withColumn("all", F.sum("n").over(one))
    at = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("all") * share), F.col("degree")))
    return rows.agg(at(0.2).alias("_p20"), at(0.8).alias("_p80"))


def contributing_models(votes: DataFrame) -> DataFrame:
    """Each model's share of a concept's extractions times its mean confidence."""
    touched = votes.withColumn("node", F.explode(F.array_distinct(F.array("subject", "object"))))
    each = touched.groupBy("node", "model").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("node")) * F.col("c")
    return each.select("node", "model", F.round(share, 8).alias("contribution"))


def cochain_stats(cochains: DataFrame) -> DataFrame:
    """Nodes by type and band of consensus, with mean scores."""
    band = F.when(F.col("consensus") >= 0.8, "high").when(F.col("consensus") >= 0.5, "medium").otherwise("low")
    return cochains.groupBy("kind", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("centrality"), 4).alias("avg_centrality"), F.round(F.avg("stability"), 4).alias("avg_stability"))


def population(concepts: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """Concepts, those with edges, their mean degree and those with a vector (id), by origin."""
    rows = concepts.join(degrees(edges), F.col("id") == F.col("node"), "left").join(vectors.select("id").distinct().withColumn("_v", F.lit(1)), "id", "left")
    return rows.groupBy("origin").agg(F.count(F.lit(1)).alias("concepts"), F.count("degree").alias("connected"), F.round(F.avg(F.coalesce("degree", F.lit(0))), 4).alias("avg_degree"), F.count("_v").alias("with_vector"))


def relation_stats(edges: DataFrame) -> DataFrame:
    """Edges by relation and model."""
    return edges.groupBy("relation_type", "model_source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("weight"), 4).alias("avg_weight"), F.round(F.max("weight"), 4).alias("max_weight"))


def seed_edges(seeds: DataFrame, existing: DataFrame, symmetric: list[str]) -> DataFrame:
    """G24 of (source, target, relation_type, weight): new edges, symmetric relations both ways, none that exists."""
    back = seeds.filter(F.col("relation_type").isin(symmetric)).select(F.col("target").alias("source"), F.col("source").alias("target"), "relation_type", "weight")
    both = seeds.select("source", "target", "relation_type", "weight").unionByName(back)
    new = both.groupBy("source", "target", "relation_type").agg(F.max("weight").alias("weight"))
    return new.join(existing.select("source", "target").distinct(), ["source", "target"], "left_anti")


def group_seed_edges(left: DataFrame, right: DataFrame, existing: DataFrame, symmetric: list[str]) -> DataFrame:
    """G24 where all of a group are seeds: seed_edges of every left (id, group) to every right (id, group, relation_type,
    weight) of its group. Ids are of one type.

    Pairs are formed, turned, summed up and met with existing edges in the task of their tile, which is the blocks of both
    ends in either order. So only ends and existing edges are shuffled: ends as often as there are blocks, which is the
    square root of the pairs.
    """
    spark = left.sparkSession
    sizes = left.groupBy("group").agg(F.count(F.lit(1)).alias("a")).join(right.groupBy("group").agg(F.count(F.lit(1)).alias("b")), "group")
    blocks = max(1, math.ceil(math.sqrt((sizes.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0) / PAIRS_A_TILE)))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks * (blocks + 1) // 2)
    block, every = (lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = lambda rows, a, b: rows.withColumn("tile", F.least(a, b) * blocks + F.greatest(a, b))
    none = right.filter("false").select(F.struct("id", "relation_type", "weight").alias("target")).schema["target"].dataType.simpleString()
    sources = left.select(F.struct("id").alias("source"), F.lit(None).cast(none).alias("target"), "group", block("id").alias("x"), every.alias("y"))
    targets = right.select(F.lit(None).cast(sources.schema["source"].dataType.simpleString()).alias("source"), F.struct("id", "relation_type", "weight").alias("target"), "group", every.alias("x"), block("id").alias("y"))
    # grouped and not joined: a join would deal its sides by all of its keys, and so lose the tiles
    cells = dealt(sources.union(targets).filter("group is not null"), F.col("x"), F.col("y")).repartition(n, "tile")
    cells = cells.groupBy("tile", "x", "y", "group").agg(F.collect_list("source").alias("sources"), F.collect_list("target").alias("targets"))
    pairs = cells.select("tile", "sources", F.explode("targets").alias("t")).select("tile", F.explode("sources.id").alias("a"), F.col("t.id").alias("b"), "t.relation_type", "t.weight")
    there, back = F.struct(F.col("a").alias("source"), F.col("b").alias("target")), F.struct(F.col("b").alias("source"), F.col("a").alias("target"))
    both = F.when(F.col("relation_type").isin(symmetric), F.array(there, back)).otherwise(F.array(there))
    new = pairs.select("tile", "relation_type", "weight", F.inline(both)).groupBy("tile", "source", "target", "relation_type").agg(F.max("weight").alias("weight")).withColumn("known", F.lit(False))
    known = dealt(existing.select("source", "target"), block("source"), block("target")).repartition(n, "tile").filter("source is not null and target is not null")
    known = known.select("tile", "source", "target", F.lit(None).cast("string").alias("relation_type"), F.lit(None).cast("double").alias("weight"), F.lit(True).alias("known"))
    rows = new.select(known.columns).union(known).withColumn("exists", F.max("known").over(Window.partitionBy("tile", "source", "target")))
    return rows.filter("not exists").select("source", "target", "relation_type", "weight")


def seed_nodes(concepts: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Concepts (id) and the ends of new edges that aren't among them."""
    return concepts.select("id").union(new_edges.select(F.explode(F.array("source", "target")))).distinct()


def group_seed_nodes(concepts: DataFrame, left: DataFrame, right: DataFrame, existing: DataFrame, symmetric: list[str]) -> DataFrame:
    """seed_nodes of group_seed_edges, without its edges: an end of a group has a new one unless it has existing edges
    with all that it may be seeded with, so existing edges within groups are counted."""
    two_way = right.filter(F.col("relation_type").isin(symmetric))
    ends = lambda rows, name="id": rows.select(F.col("id").alias(name), "group").distinct()
    ways = F.array(F.struct(F.col("source").alias("l"), F.col("target").alias("r"), F.lit(False).alias("back")), F.struct(F.col("target").alias("l"), F.col("source").alias("r"), F.lit(True).alias("back")))
    both = right.select(F.col("id").alias("r"), "group", F.lit(False).alias("back")).union(two_way.select("id", "group", F.lit(True))).distinct()
    within = existing.select(F.inline(ways)).join(ends(left, "l"), "l").join(both, ["r", "group", "back"]).select("l", "r", "group", "back").distinct()
    within = materialise(within, "seeded-within")

    def lacking(rows: DataFrame, others: DataFrame, key: str, back: bool) -> DataFrame:
        of_group = ends(others).groupBy("group").agg(F.count(F.lit(1)).alias("n"))
        has = within.filter(F.col("back") == back).groupBy(F.col(key).alias("id"), "group").agg(F.count(F.lit(1)).alias("m"))
        return ends(rows).join(of_group, "group").join(has, ["id", "group"], "left").filter(F.col("n") > F.coalesce("m", F.lit(0))).select("id")

    new = lacking(left, right, "l", False).union(lacking(right, left, "r", False)).union(lacking(left, two_way, "l", True)).union(lacking(two_way, left, "r", True))
    return concepts.select("id").union(new).distinct()
