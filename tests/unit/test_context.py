"""Keywords and the concepts next to them, without rows for all pairs of a text and a concept."""

import random
from collections import defaultdict

from claimgraph.operators import sessions


def brute(found, edges, *, least=0.1, k=5):
    by_source, sums = defaultdict(list), defaultdict(float)
    for source, target, weight in edges:
        if weight >= least:
            by_source[source].append((target, weight))
    for i, word in set(found):
        for target, weight in by_source[word]:
            sums[i, target] += weight
    near = defaultdict(list)
    for (i, target), weight in sums.items():
        near[i].append((-round(weight, 4), target))
    return sorted((i, t, -w, place) for i, rows in near.items() for place, (w, t) in enumerate(sorted(rows)[:k], 1))


def most_rows(spark, since: int) -> tuple[int, int]:
    """The largest number of rows that a step of any query has given since an execution, and how many there are."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    executions = store.executionsList()
    for n in range(since, executions.size()):
        one = executions.apply(n)
        values = store.executionMetrics(one.executionId())
        for m in range(one.metrics().size()):
            metric = one.metrics().apply(m)
            if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most, executions.size()


def context(spark, found, edges, **kw):
    rows = sessions.context(spark.createDataFrame(found, "id long, word string"), spark.createDataFrame(edges, "source string, target string, weight double"), **kw)
    return sorted(tuple(r) for r in rows.select("id", "target", "weight", "place").collect())


def test_context_is_that_of_all_pairs(spark):
    draw = random.Random(3)
    for words, wide in ((4, 0), (30, 0), (12, 1), (400, 1)):
        pick = lambda n: draw.sample([f"w{i}" for i in range(words)], min(n, words))  # noqa: E731, B023
        found = [(i, w) for i in range(60) for w in pick(draw.randint(1, 9 if wide else 5))]
        edges = [(w, f"t{i}", draw.choice([0.05, 0.1, 0.3, 0.3, 0.7])) for i in range(150) for w in pick(draw.randint(1, 25 if wide else 10))]
        # copies of concepts, and an edge that comes twice
        edges += [(s, t + "x", w) for s, t, w in edges if t < "t3"] + edges[:3]
        assert context(spark, found, edges) == brute(found, edges)
        assert context(spark, found, edges, least=-1.0, k=3) == brute(found, edges, least=-1.0, k=3)


def test_context_forms_no_pairs_of_what_shares_a_word(spark):
    n = 600
    found = [(i, w) for i in range(n) for w in ("common", f"own{i % 50}")]
    edges = [(w, f"t{i:04}", 1.0 + i % 7) for i in range(n) for w in ("common", f"own{i % 50}")]
    _, since = most_rows(spark, 0)
    assert context(spark, found, edges) == brute(found, edges)
    most, _ = most_rows(spark, since)
    assert 0 < most < 40 * n, most


def test_keywords_move_no_words(spark):
    rows = spark.createDataFrame([(1, "Alpha beta beta with gamma"), (2, None), (3, "an of"), (None, "delta")], "id long, text string")
    found = sessions.keywords(rows, k=2)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((tuple(r) for r in found.collect()), key=str) == [(1, 1, "beta", 8), (1, 2, "alpha", 5), (None, 1, "delta", 5)]


def test_keywords_of_an_id_of_several_rows_are_counted_together(spark):
    rows = spark.createDataFrame([(1, "alpha alpha beta"), (1, "beta beta"), (2, "gamma")], "id long, text string")
    assert sorted(tuple(r) for r in sessions.keywords(rows, k=1).collect()) == [(1, 1, "beta", 12), (2, 1, "gamma", 5)]
