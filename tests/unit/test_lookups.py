"""Exact quantiles, as-of joins, the trigram index and landed folders against plain Python."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimgraph.functions import quantiles
from claimgraph.operators import asof, calibrate, graph, name_index
from claimgraph.sources import folders
from tests.unit.test_streams import rows_of

DAY = datetime(2024, 1, 1)


@pytest.mark.parametrize("margin", [0.03, 0.0])
def test_exact_elements_of_groups(spark, margin):
    rng = random.Random(2)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(4000)] + [("ties", float(rng.randrange(3))) for _ in range(501)] + [("one", 7.0), ("none", None), ("nan", float("nan")), ("two", 1.0), ("two", 2.0)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    places = {"low": lambda n: n * 0.2, "middle": lambda n: F.floor(n / 2), "last": lambda n: n + 5}
    got = {r.g: (r.low, r.middle, r.last) for r in quantiles.exact_elements(frame, ["g"], "v", places, margin=margin).collect()}
    want = {}
    for g in ("hot", "ties", "one", "two"):
        v = sorted(x for k, x in rows if k == g)
        want[g] = (v[int(len(v) * 0.2)], v[len(v) // 2], v[-1])
    assert got == want
    median = {r.g: r.m for r in quantiles.exact_percentile(frame, ["g"], "v", 0.5, "m").collect()}
    assert all(abs(median[g] - np.median([x for k, x in rows if k == g])) < 1e-12 for g in want)
    every = quantiles.exact_percentile(frame, [], "v", 0.25, "m").first().m
    assert abs(every - np.quantile([x for _, x in rows if x is not None and x == x], 0.25)) < 1e-12


@pytest.mark.parametrize("bucket", [asof.DAY, 3_600_000_000, 10**15])
def test_latest_before_equals_a_nested_loop(spark, bucket):
    rng = random.Random(bucket)
    when = lambda: DAY + timedelta(minutes=rng.randrange(0, 20000))
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(4)}", when(), i % 7, f"p{i}") for i in range(400)] + [(None, DAY, 1, "null"), ("k1", None, 1, "no time")]
    rows += [("k0", DAY, 2, "b"), ("k0", DAY, 1, "a")]
    asked = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", when()) for _ in range(200)] + [("k0", DAY), ("k0", DAY), (None, DAY), ("k1", None)]
    got = asof.latest_before(spark.createDataFrame(asked, "k string, as_of timestamp").repartition(3), spark.createDataFrame(rows, "k string, at timestamp, n int, p string").repartition(3), ["k"], tie=["n", "p"], bucket=bucket)
    want = []
    for k, t in asked:
        found = [r for r in rows if t and k and r[0] == k and r[1] and r[1] <= t]
        newest = [r for r in found if r[1] == max(x[1] for x in found)]
        want.append((k, t, min(newest, key=lambda r: r[2:])[3] if newest else None))
    assert sorted(((r.k, r.as_of, r.found.p if r.found else None) for r in got.collect()), key=str) == sorted(want, key=str)


def test_cache_and_staleness_at_each_own_time(spark):
    at = lambda h: DAY + timedelta(hours=h)
    made = spark.createDataFrame([("q", "c1", 0.9, "verified", at(0)), ("q", "c2", 0.1, "verified", at(5)), ("q", "c3", 0.8, "validated", at(10)), ("q", "c4", 0.9, "sandbox", at(11))], "question string, claim_hash string, score double, tier string, at timestamp")
    asked = spark.createDataFrame([("q", at(6)), ("q", at(12)), ("q", at(40)), ("other", at(6)), ("q", at(-1))], "question string, as_of timestamp")
    got = calibrate.cached_as_of(made, asked, hours=24)
    assert rows_of(got, "question", "as_of", "claim_hash") == sorted([("q", at(6), "c1"), ("q", at(12), "c3"), ("q", at(40), None), ("other", at(6), None), ("q", at(-1), None)], key=str)
    wanted = spark.createDataFrame([("s", "h", 4, at(3)), ("s", "h", 4, at(9)), ("s", "h", 4, at(11)), ("s", "x", 4, at(3))], "source_id string, query_hash string, ttl_hours int, as_of timestamp")
    shots = spark.createDataFrame([("s", "h", at(0)), ("s", "h", at(10))], "source_id string, query_hash string, fetched_at timestamp")
    assert rows_of(calibrate.stale_as_of(wanted, shots)) == sorted([("s", "h", at(9), at(0)), ("s", "x", at(3), None)], key=str)


def test_search_by_trigrams_equals_like(spark, tmp_path):
    rng = random.Random(4)
    names = [(i, "".join(rng.choice("abé b") for _ in range(rng.randrange(0, 12))), i % 5 / 5) for i in range(400)] + [(500, "a%b_c", 0.1), (501, None, 0.2)]
    concepts = spark.createDataFrame(names, "id long, name string, rho double")
    edges = spark.createDataFrame([(rng.randrange(400), rng.randrange(400), 0.5) for _ in range(500)], "source long, target long, weight double").dropDuplicates(["source", "target"])
    index = name_index.NameIndex.create(str(tmp_path / "index"), concepts, buckets=16)
    for pattern in ("%abb%", "abé%", "%éab%ba%", "%a_bab%", "ab", "%", "%a\\%b\\_c%", "%zzz%"):
        assert rows_of(index.matches(pattern)) == rows_of(concepts.filter(F.col("name").like(pattern))), pattern
        assert rows_of(index.search(edges, pattern, k=15)) == rows_of(graph.search(concepts, edges, pattern, k=15)), pattern
    assert name_index.literal_grams("%a\\%b\\_c%") == {"a%b", "%b_", "b_c"} and not name_index.literal_grams("ab%ba_a")
    read = [f for f in index.postings.read(buckets=index.postings.touched(spark.createDataFrame([("abb",)], "gram string"))).inputFiles()]
    assert len(read) < len(index.postings.read().inputFiles())


def test_landed_folders_tell_rejects_apart(spark, tmp_path):
    for name, text in {"a/good.json": '{"a": 1}\n[2]\n\n  \n"x"\n', "a/cut.json": '{"a": 1}\n{"a": [1, 2', "b/empty.json": "", "b/blank.json": " \n\n", "b/prose.json": "not json"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    landed = folders.read_landed(spark, str(tmp_path))
    got = sorted((r.path.rsplit("/", 1)[1], r.state, r.raw or "") for r in landed.collect())
    assert got == sorted([("good.json", "good", '{"a": 1}'), ("good.json", "good", "[2]"), ("good.json", "good", '"x"'), ("cut.json", "good", '{"a": 1}'), ("cut.json", "broken", '{"a": [1, 2'), ("empty.json", "empty", ""), ("blank.json", "empty", ""), ("prose.json", "broken", "not json")])
    assert rows_of(folders.landing_report(landed)) == [("broken", 2, 2), ("empty", 2, 2), ("good", 2, 4)]
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "w.json").write_text('{\n "a":\n 1}\n')
    assert rows_of(folders.read_landed(spark, str(tmp_path / "whole"), whole_files=True), "state") == [("good",)]
