"""G24 of groups: seeds that are formed tile by tile, and their ends by counts, against the same from all pairs."""

import pytest
from pyspark.sql import functions as F

from claimgraph.operators import graph, name_index
from claimgraph.plans import catalogue, inputs


@pytest.mark.parametrize("pairs_a_tile", [3, 1_000_000])
def test_seeds_of_groups_are_those_of_all_pairs(spark, monkeypatch, pairs_a_tile):
    monkeypatch.setattr(graph, "PAIRS_A_TILE", pairs_a_tile)
    # ids of both sides overlap, so an edge and another's way back coincide; some rows, ids, groups and kinds are null or repeat
    left = spark.createDataFrame([(i, i % 3) for i in range(12)] + [(5, 0), (5, 2), (None, 1), (20, None), (21, 2)], "id long, group int")
    right = spark.createDataFrame(
        [(i, i % 3, "near" if i % 2 else "owes", i / 10) for i in range(9)] + [(4, 2, "near", 0.9), (4, 1, "near", 0.95), (None, 0, "near", 0.5), (30, None, "near", 1.0), (8, 2, None, None)],
        "id long, group int, relation_type string, weight double",
    )
    existing = spark.createDataFrame([(3, 0), (3, 0), (4, 4), (None, 1), (1, None), (7, 4), (1, 7)] + [(21, x) for x in (2, 4, 5, 8)] + [(x, 21) for x in (4, 5)], "source long, target long")
    seeds = left.join(right, "group").select(left.id.alias("source"), right.id.alias("target"), "relation_type", "weight")
    concepts = spark.createDataFrame([(2,), (40,)], "id long")
    rows_of = lambda df: sorted(map(str, df.collect()))
    want = graph.seed_edges(seeds, existing, ["near"])
    assert rows_of(graph.group_seed_edges(left, right, existing, ["near"])) == rows_of(want)
    assert rows_of(graph.group_seed_nodes(concepts, left, right, existing, ["near"])) == rows_of(graph.seed_nodes(concepts, want))
    assert want.filter(F.col("source") == 21).isEmpty()  # it has all of its edges already, and is no new node


def test_pairs_of_seeds_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS_A_TILE", 3)
    left, right = spark.createDataFrame([(1, 1), (2, 1)], "id long, group int"), spark.createDataFrame([(3, 1, "near", 0.5)], "id long, group int, relation_type string, weight double")
    new = graph.group_seed_edges(left, right, spark.createDataFrame([(1, 3)], "source long, target long"), ["near"])
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == plan.count("REPARTITION_BY_NUM") == 2


def test_all_customers_are_seeds_of_edges(spark):
    folder = "/root/testdata/sf0.001"
    of_nation = inputs.table(spark, folder, "customer").join(inputs.table(spark, folder, "supplier"), F.col("c_nationkey") == F.col("s_nationkey"))
    pairs = of_nation.select(F.col("c_custkey").alias("source"), F.col("s_suppkey").alias("target")).subtract(inputs.start_pairs(spark, folder))
    found = catalogue.queries()["g24_seed_edges"](spark, folder).select("source", "target")
    assert pairs.count() > 0 and pairs.subtract(found).count() == 0


def test_search_by_index_counts_all_edges_and_repeated_names(spark, tmp_path):
    # an id with two names, and an edge that is there twice, which the index counted once
    names = spark.createDataFrame([(1, "a bolt", 1.0), (1, "bolt bolt", 2.0), (2, "no bo or lt", 3.0), (3, "blue bolt", 1.0)], "id long, name string, rho double")
    edges = spark.createDataFrame([(1, 3), (1, 3), (3, 3), (2, 3), (None, 1)], "source long, target long")
    index = name_index.NameIndex.create(str(tmp_path / "index"), names, buckets=4)
    for pattern in ("%bolt%", "%b%", "%blue%bolt"):
        assert index.search(edges, pattern, k=9).collect() == graph.search(names, edges, pattern, k=9).collect()


def test_purchases_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(inputs, "TASK_LINES", 500)
    few = inputs.start_edges(spark, "/root/testdata/sf0.001")
    n = -(-inputs.table(spark, "/root/testdata/sf0.001", "lineitem").count() // 500)
    assert few._jdf.queryExecution().executedPlan().toString().count(f", {n}), REPARTITION_BY_NUM") == 3
    assert few.rdd.getNumPartitions() == n
