"""Queries on tables put together of several, which the given ones don't look like, against their SQL."""

import os

import duckdb
import pytest

from claimgraph.operators import align
from claimgraph.plans import catalogue, inputs
from tests.unit.test_oracles import SF, TABLES, plain


def linked(tmp_path, *, but: dict[str, str]) -> str:
    """A folder with the smallest tables, but these by a DuckDB query."""
    con = duckdb.connect()
    for t in TABLES:
        if t in but:
            con.execute(f"copy ({but[t].format(t=f'{SF}/{t}.parquet')}) to '{tmp_path}/{t}.parquet' (format parquet)")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def same(spark, folder: str, name: str) -> None:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = catalogue.queries()[name](spark, folder)
    names = sorted(df.columns)
    found = con.execute(catalogue.oracle_sql()[name])
    at = [[c[0] for c in found.description].index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(v) for v in r) for r in df.select(names).collect()), key=str) == want


@pytest.mark.parametrize("name", ["g7_apply_deltas", "g7_apply_node_deltas", "t2_follow_deltas_stream", "t2_dirty_queue_stream", "t2_curvature_stream"])
def test_changes_go_by_their_numbers(spark, tmp_path, name):
    same(spark, linked(tmp_path, but={"events": "select * replace (5000 - event_id as event_id) from '{t}'"}), name)


@pytest.mark.parametrize("name", ["g7_apply_deltas", "g7_apply_node_deltas", "t2_follow_deltas_stream", "t2_dirty_queue_stream", "t2_curvature_stream"])
def test_changes_of_any_confidence_and_weight_are_those_of_the_sql(spark, tmp_path, name):
    # deletions and changes of nodes with a value above 500, and additions that weigh nothing, which larger tables have
    many = "CASE WHEN event_type IN ('signup', 'error') THEN value * 9 WHEN event_id % 7 = 0 THEN 0 ELSE value END"
    same(spark, linked(tmp_path, but={"events": f"select * replace ({many} as value) from '{{t}}'"}), name)


def test_a_first_task_without_rows_lands_no_file(spark, tmp_path):
    folder = linked(tmp_path, but={})
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        same(spark, folder, "s5_landed_folder")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_plans_of_matching_stay_small(spark):
    plan = catalogue.queries()["j6_neighbour_matches"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 12, plan.count("Exchange hashpartitioning")


def test_names_and_matches_are_not_broadcast(spark):
    names = spark.createDataFrame([(f"name{i}",) for i in range(50)], "name string")
    assert "Broadcast" not in align.similar_names(names)._jdf.queryExecution().executedPlan().toString()
    matches = catalogue.queries()["j6_neighbour_matches"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert matches.count("BroadcastExchange") <= 1, "relations that are compatible, and no names or matches"


def test_tasks_of_edges_grow_in_number_with_line_items(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inputs, "TASK_LINES", 500, raising=False)
    folder = linked(tmp_path, but={})
    assert inputs.edges(spark, folder).rdd.getNumPartitions() >= 12
    same(spark, folder, "g1_neighbours")
    same(spark, folder, "k5_clusters")


def test_windows_of_a_stream_keep_their_state_in_files_and_sum_up_once(spark, tmp_path):
    from claimgraph.plans import of_logs

    stream = of_logs.streams.windowed_consensus(of_logs.votes_with_time(of_logs.stream_of(spark, SF, "lineitem")), inputs.models(spark))
    query = of_logs.streams.run_to_table(stream, f"{tmp_path}/t4")
    operators = query.recentProgress[0].stateOperators
    assert len(operators) == 2, "deduplication and one aggregation"
    assert all("rocksdbPutCount" in o.customMetrics for o in operators)
    assert not [c for c in of_logs.streams.STATE if "rocksdb." in c and spark.conf.get(c, None) == of_logs.streams.STATE[c]]
