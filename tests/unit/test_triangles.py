"""Common targets and triangles by colour against sets."""

import random
from collections import Counter

import duckdb
import pytest

from claimgraph.operators import graph, triangles
from tests.unit.test_streams import rows_of


@pytest.mark.parametrize(("task_arcs", "at_once"), [(1 << 20, 1 << 21), (60, 5)])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_triangles_by_colour(spark, monkeypatch, task_arcs, at_once, kind):
    monkeypatch.setattr(triangles, "TASK_ARCS", task_arcs)
    monkeypatch.setattr(triangles, "AT_ONCE", at_once)
    rng = random.Random(task_arcs)
    arcs = {(rng.randrange(30), rng.randrange(30)) for _ in range(250)} | {(0, i) for i in range(40)} | {(5, 5)}
    frame = spark.createDataFrame(sorted(arcs), "source long, target long").selectExpr(f"cast(source as {kind}) source", f"cast(target as {kind}) target")
    typed = str if kind == "string" else int
    out = {}
    for a, b in arcs:
        out.setdefault(a, set()).add(b)
    want = {(typed(a), typed(b)): len(out[a] & out.get(b, set())) for a, b in arcs}
    got = {(r.source, r.target): r.both for r in triangles.common_targets(frame).collect()}
    assert got == {p: n for p, n in want.items() if n}
    few = frame.filter("source in (0, 1, 2)")
    assert {(r.source, r.target): r.both for r in triangles.common_targets(frame, few).collect()} == {p: n for p, n in got.items() if p[0] in map(typed, (0, 1, 2))}
    up = {(min(p), max(p)) for p in arcs if p[0] != p[1]}
    counts = Counter(x for a, b in up for c in range(45) if (a, c) in up and (b, c) in up for x in (a, b, c))
    low = spark.createDataFrame(sorted(up), "source long, target long").selectExpr(f"cast(source as {kind}) source", f"cast(target as {kind}) target")
    assert dict(rows_of(triangles.triangles(low), "node", "triangles")) == {typed(k): n for k, n in counts.items()}
    assert triangles.triangles(low.limit(0)).isEmpty() and triangles.common_targets(low.limit(0)).isEmpty()


def random_graph(rng, nodes=25, edges=160):
    return {(rng.randrange(nodes), rng.randrange(nodes)): rng.randrange(1, 10) / 10 for _ in range(edges)} | {(0, i): 0.5 for i in range(30)} | {(5, 5): 0.3}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_counts_carried_on_equal_counts_taken_anew(spark, monkeypatch, seed):
    """Arcs come and go, weights change, a hub goes, self-loops come: the counts are those of the new graph."""
    monkeypatch.setattr(triangles, "TASK_ARCS", 100)
    rng = random.Random(seed)
    old = random_graph(rng)
    new = {e: (w if rng.random() < 0.9 else 0.95) for e, w in old.items() if rng.random() < 0.85 and (seed != 2 or 0 not in e)}
    new |= {(rng.randrange(28), rng.randrange(28)): 0.7 for _ in range(20)} | ({(7, 7): 0.1} if seed == 3 else {})
    nodes = {n for e in old.keys() | new.keys() if old.get(e) != new.get(e) for n in e}
    frame = lambda g: spark.createDataFrame([(a, b, w) for (a, b), w in sorted(g.items())], "source long, target long, weight double")
    touched = spark.createDataFrame([(n,) for n in sorted(nodes)], "node long")
    beside = lambda rows: rows.filter(f"source in {tuple(nodes)} or target in {tuple(nodes)}")
    want = beside(graph.curvature_counts(frame(new)))
    got = graph.changed_counts(beside(graph.curvature_counts(frame(old))), beside(frame(new)), touched)
    assert rows_of(got, *want.columns) == rows_of(want) and want.count() > 20


def test_counts_without_changes_stay(spark):
    rows = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (2, 3, 0.5)], "source long, target long, weight double")
    counts, nodes = graph.curvature_counts(rows), spark.createDataFrame([(1,)], "node long")
    beside = counts.filter("source = 1 or target = 1")
    assert rows_of(graph.changed_counts(beside, rows.filter("source = 1"), nodes), *counts.columns) == rows_of(beside)
    assert graph.changed_counts(beside.limit(0), rows.limit(0), nodes).isEmpty()


def test_arcs_between_close_nodes_are_copied_a_few_times(spark, monkeypatch):
    monkeypatch.setattr(triangles, "TASK_ARCS", 200)
    rng = random.Random(3)
    copies = {}
    for groups in (10, 60):
        arcs = {(20 * g + a, 20 * g + b) for g in range(groups) for a, b in (sorted(rng.sample(range(20), 2)) for _ in range(150))}
        frame = spark.createDataFrame(sorted(arcs), "source long, target long").cache()
        dealt = triangles._dealt(frame, frame, frame, 3 * len(arcs))
        copies[groups] = dealt.count() / len(arcs)
        assert dealt.groupBy("task").count().agg({"count": "max"}).first()[0] <= 600
    assert copies[60] <= 1.25 * copies[10] and copies[60] < 3 * (3 * len(arcs) / 200) ** 0.5 / 2


def test_curvature_of_no_weight_and_next_to_halves_is_that_of_the_sql(spark):
    rows = [(1, 2, 0.0, 3, 4), (1, 3, 0.08192, 25, 25), (1, 4, 0.08192, 5, 200)]
    counts = spark.createDataFrame([(*r, 2, 2, 1) for r in rows], "source long, target long, weight double, du long, dv long, nu long, nv long, both long")
    found = {r.target: r.ollivier for r in graph.curvature_of_counts(counts, weightless=float("-inf")).collect()}
    for _, target, weight, du, dv in rows:
        want = duckdb.execute("SELECT round(1 / ?::BIGINT + 1 / ?::BIGINT - 2 / ?::DOUBLE, 6)", [du, dv, weight]).fetchone()[0]
        assert found[target] == want


def test_copies_of_arcs_are_small(spark, monkeypatch):
    monkeypatch.setattr(triangles, "TASK_ARCS", 2000)
    rng = random.Random(4)
    arcs = spark.createDataFrame(sorted({(rng.randrange(400), rng.randrange(400)) for _ in range(8000)}), "source long, target long").cache()
    n, size = arcs.count(), triangles._blocks(arcs, arcs, arcs, 3 * arcs.count()).selectExpr("sum(length(block)) AS bytes", "count(*) AS blocks").first()
    copies = triangles._dealt(arcs, arcs, arcs, 3 * n).count()
    assert copies >= 6 * n, "nodes are linked at random: each arc is needed in several tasks"
    assert size.bytes < 5 * copies + 1000 * size.blocks, "an arc's two numbers took 16 bytes and more"
