"""Joins by angle, leaders along long chains, bridges and aliases against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimgraph.operators import components, gaps, similarity
from tests.unit.test_streams import rows_of


def vector_rows(n=600, d=12, groups=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    return [centres[i % groups] + 0.15 * rng.normal(size=d) for i in range(n)]


def frame(spark, rows, label=None):
    return spark.createDataFrame([(i, None if r is None else [float(x) for x in r], i % 3 if label is None else label) for i, r in enumerate(rows)], "id long, embedding array<double>, label int")


def plain_pairs(rows, least, within=None):
    out = {}
    for i, x in enumerate(rows):
        for j in range(i + 1, len(rows)):
            y = rows[j]
            if x is None or y is None or len(x) != len(y) or (within and within(i) != within(j)):
                continue
            c = float(np.dot(x, y) / ((np.linalg.norm(x) * np.linalg.norm(y)) or 1))
            if c >= least:
                out[i, j] = c
    return out


@pytest.mark.parametrize("block", [2048, 20])
def test_join_by_angle_loses_no_pair(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", block)
    rows = [*vector_rows(), None, np.zeros(12), np.ones(5), np.ones(5) * 2, np.array([np.inf] * 12), np.array([-1.0, 0, 0, 0, 0])]
    clean = [None if r is None or not np.isfinite(r).all() else r for r in rows]
    for least, within in ((0.9, None), (0.97, "label"), (-0.2, None)):
        want = plain_pairs(clean, least, (lambda i: i % 3) if within else None)
        got = {(r.a, r.b): r.similarity for r in similarity.cosine_join(frame(spark, rows), least, within=within).collect()}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert similarity.cosine_join(frame(spark, rows).limit(0), 0.5).isEmpty()


def test_most_pairs_of_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 20)
    _, blocks = similarity.angle_blocks(frame(spark, vector_rows()))
    n = blocks.count()
    kept, loose = similarity.block_pairs(blocks, 0.9).count(), similarity.block_pairs(blocks, -1.0).count()
    assert loose == n * (n + 1) // 2 and n >= 30 and kept < 0.4 * loose


def test_blocks_grow_and_components_need_a_forest_alone(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 20)
    monkeypatch.setattr(similarity, "BLOCKS", 4, raising=False)
    rows, linked = vector_rows(), []
    assert similarity.angle_blocks(frame(spark, rows))[1].count() <= 12, "blocks of 150 rows, not of 20"
    settle = similarity.connected_components
    monkeypatch.setattr(similarity, "connected_components", lambda edges: settle(linked.append(edges) or edges))
    got = dict(rows_of(similarity.cosine_components(frame(spark, rows), 0.9)))
    want = {i: i for i in range(len(rows))}
    pairs = plain_pairs(rows, 0.9)
    for _ in range(6):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert got == {i: c for i, c in want.items() if any(i in p for p in pairs)}
    assert linked[0].count() < len(pairs) / 4


@pytest.mark.parametrize("block", [2048, 25])
def test_top_similar_with_a_moving_bound(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", block)
    rows, k = vector_rows(300), 4
    edges = [(i, i + 12) for i in range(0, 200, 5)]
    pairs = {p: c for p, c in plain_pairs(rows, 0.6).items() if p not in set(edges)}
    ends = defaultdict(list)
    for (a, b), c in pairs.items():
        ends[a].append((-round(c, 9), a, b))
        ends[b].append((-round(c, 9), a, b))
    want = {(a, b) for found in ends.values() for _, a, b in sorted(found)[:k]}
    got = similarity.top_similar(frame(spark, rows), spark.createDataFrame(edges, "source long, target long"), k=k)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_top_similar_passes_on_few_pairs_of_other_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 100)
    passed, compared = [], similarity._compared
    monkeypatch.setattr(similarity, "_compared", lambda *given: passed.append(compared(*given)) or passed[-1])
    rng = np.random.default_rng(8)
    rows = [rng.normal(size=6) for _ in range(600)]
    got = similarity.top_similar(frame(spark, rows), spark.createDataFrame([(0, 1)], "source long, target long"), least=0.2, k=2)
    own, others = (p.count() for p in passed)
    pairs = plain_pairs(rows, 0.2)
    assert got.count() > 300 and others < (len(pairs) - own) / 5, (own, others, len(pairs))


def greedy(n, pairs):
    smaller, leader = defaultdict(list), {}
    for a, b in pairs:
        smaller[max(a, b)].append(min(a, b))
    for i in range(n):
        led = [j for j in smaller[i] if leader[j] == j]
        leader[i] = min(led) if led else i
    return leader


@pytest.mark.parametrize("task_edges", [7, 60, 1 << 20])
def test_leaders_are_those_of_the_greedy_order(spark, task_edges):
    rng = random.Random(task_edges)
    shapes = {"random": {tuple(sorted(rng.sample(range(120), 2))) for _ in range(150)}, "chain": {(i, i + 1) for i in range(90)}, "star": {(0, i) for i in range(1, 60)}, "hub last": {(i, 119) for i in range(80)}, "dense": {(i, j) for i in range(25) for j in range(i)}, "none": set()}
    if task_edges == 7:
        shapes = {k: shapes[k] for k in ("random", "hub last", "dense")}
    for name, pairs in shapes.items():
        items, edges = spark.range(120), spark.createDataFrame(sorted(pairs), "a long, b long")
        assert dict(rows_of(similarity.assign_leaders(items, edges, task_edges=task_edges))) == greedy(120, pairs), name


@pytest.mark.parametrize("chunk", [2048, 20])
def test_leaders_of_vectors_need_no_pairs(spark, monkeypatch, chunk):
    rows = [*vector_rows(700 if chunk > 20 else 150), None, np.zeros(12), np.ones(5), np.ones(5) * 2, np.array([np.inf] * 12), np.array([-1.0, 0, 0, 0, 0])]
    clean = [None if r is None or not np.isfinite(r).all() else r for r in rows]
    for name, size in (("CHUNK_ROWS", chunk), ("DECIDED_ROWS", 3 * chunk), ("COVERED_ROWS", 2 * chunk)):
        monkeypatch.setattr(similarity, name, size)
    joined = similarity.cosine_join
    monkeypatch.setattr(similarity, "cosine_join", lambda *a, **k: 1 / 0)
    for least, within in ((0.97, "label"), (0.97, None)):
        want = greedy(len(rows), plain_pairs(clean, least, (lambda i: i % 3) if within else None))
        assert dict(rows_of(similarity.vector_leaders(frame(spark, rows), least, within=within))) == want
    got = similarity.duplicate_penalty(frame(spark, rows), least=0.97)
    assert dict(rows_of(got)) == {i: 1.0 if i == leader else 0.5 for i, leader in want.items()}
    assert similarity.vector_leaders(frame(spark, rows).limit(0), 0.5).isEmpty()
    monkeypatch.setattr(similarity, "cosine_join", joined)
    twice = frame(spark, rows[:40]).unionByName(frame(spark, rows[12:14]))  # vectors 12 and 13 under the ids 0 and 1 as well
    assert dict(rows_of(similarity.vector_leaders(twice, 0.9)))[0] == 0


def test_a_chain_of_a_hundred_thousand_items(spark):
    n = 100_000
    edges = spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b")
    got = similarity.assign_leaders(spark.range(n), edges)
    assert got.filter("leader != id - id % 2").isEmpty() and got.count() == n


def test_components_of_a_chain(spark):
    edges = spark.range(3000).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.createDataFrame([(5000, 5000), (6001, 6000)], "a long, b long"))
    got = components.connected_components(edges)
    assert rows_of(got.groupBy("component").count()) == [(0, 3001), (5000, 1), (6000, 2)]


def test_bridges_are_means_over_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = {i: rng.normal(size=4) for i in range(60) if i % 11}
    rows[7] = np.zeros(4)
    edges = [(i, 100 + i % 7, 0.5 + (i % 3) / 10) for i in range(60)] + [(3, 100, 0.1), (4, 5, 0.1)]
    e = spark.createDataFrame(edges, "source long, target long, weight double")
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in rows.items()], "id long, embedding array<double>")
    member = defaultdict(list)
    for i in range(60):
        member[max([x for x in edges if x[0] == i], key=lambda x: (x[2], -x[1]))[1]].append(i)
    cross = {(min(a, b), max(a, b)) for a, b, _ in edges}
    want = {}
    for a in member:
        for b in member:
            if a < b:
                sims = [np.dot(rows[i], rows[j]) / ((np.linalg.norm(rows[i]) * np.linalg.norm(rows[j])) or 1) for i in member[a][:3] for j in member[b][:3] if i in rows and j in rows]
                linked = any((min(i, j), max(i, j)) in cross for i in member[a][:10] for j in member[b][:10])
                if np.mean(sims) >= 0.05 and not linked:
                    want[a, b] = round(float(np.mean(sims)), 4)
    got = {(r.ca, r.cb): r.similarity for r in gaps.bridges(e, v, least=0.05).collect()}
    assert got.keys() == want.keys() and got and all(abs(got[p] - want[p]) < 2e-4 for p in want)


def test_names_resolved_by_vector_become_aliases(spark):
    names = spark.createDataFrame([("x",), ("y",), ("z",), ("known",)], "name string")
    aliases = spark.createDataFrame([("known", "c0")], "alias string, concept string")
    similar = spark.createDataFrame([("x", "c1", 0.95), ("x", "c2", 0.93), ("y", "c1", 0.9), ("known", "c1", 0.99)], "name string, concept string, similarity double")
    concepts = spark.createDataFrame([("c0",), ("c1",)], "concept string")
    resolved = similarity.resolve_entities(names, aliases, concepts, similar)
    made = similarity.new_aliases(resolved, similar)
    assert rows_of(made) == [("x", "c1", 0.95, "embedding")]
    again = similarity.resolve_entities(names, aliases.unionByName(made.select("alias", "concept")), concepts, similar)
    assert dict(rows_of(again, "name", "method"))["x"] == "alias"
