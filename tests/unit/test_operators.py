"""Hand-made tables for the rules that data doesn't reach, and independent Python for what SQL can't say."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimgraph.functions import storage
from claimgraph.operators import align, calibrate, components, gaps, graph, sessions, similarity, text, votes
from claimgraph.sources import landing
from claimgraph.streaming import streams

VOTE = "model string, subject string, relation string, object string, confidence double, ord long"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_consensus_of_ties_repeats_and_silent_models(spark):
    v = spark.createDataFrame([("m1", "A", "r", "b", 0.9, 1), ("m1", " a ", "R", "b", 0.5, 2), ("m2", "a", "r", "B", 0.7, 3), ("m2", "c", "r", "d", 0.1, 4), ("m3", "e", "r", "f", None, 5)], VOTE)
    m = votes.model_table(spark, {"m1": 1.0, "m2": 0.5, "m3": 0.5, "m4": 0.0})
    got = rows_of(votes.exact_consensus(v, m), "subject", "n_votes", "agreement", "avg_confidence", "std_confidence", "score", "models")
    assert got == [("A", 3, 0.75, 0.7, 0.2, 0.73, "m1,m2")]
    assert votes.exact_consensus(v, m, distinct_models=True).first()["agreement"] == 0.5
    assert rows_of(votes.weighted_consensus(v, m), "agreement", "avg_confidence") == [(0.75, round((0.5 + 0.35) / 1.5, 6))]
    assert votes.exact_consensus(v.limit(0), m).count() == 0 and votes.vote_entropy(v.limit(0), m).first()["vote_entropy"] == 0.0


def test_cleaning(spark):
    df = spark.createDataFrame([("m", "  Éa\t b ", "r", "x1", "0.5"), ("m", "it", "r", "it", "abc"), ("m", "[a]", "", "12", "-3"), ("m", None, "r", "ok", None)], "model string, subject string, relation string, object string, confidence string")
    got = text.validate_votes(df).select("valid", "confidence", F.size("errors").alias("n")).collect()
    assert [(r.valid, r.confidence) for r in got] == [(True, 0.5), (False, 0.5), (False, 0.0), (False, 0.7)]
    assert df.select(text.normalise(F.col("subject"))).first()[0] == "éa b"
    one = spark.range(1)
    assert one.select(text.claim_hash(F.lit(" A"), F.lit("b"), F.lit("C "), None) == text.claim_hash(F.lit("a"), F.lit("B"), F.lit("c"), F.lit(None))).first()[0]
    assert one.select(text.family(F.lit("local::qwen2.5:7b"), {"qwen": "q"})).first()[0] == "q"


def lfmis(ids, pairs):
    near, leader = {i: set() for i in ids}, {}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    leaders = []
    for i in sorted(ids):
        best = [x for x in leaders if x in near[i]]
        leader[i] = best[0] if best else i
        if not best:
            leaders.append(i)
    return leader


def test_leaders_and_components(spark):
    rng = random.Random(1)
    for n, m in ((1, 0), (12, 11), (30, 60), (40, 25)):
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)} if n > 1 else set()
        items, edges = spark.createDataFrame([(i,) for i in range(n)], "id long"), spark.createDataFrame(sorted(pairs), "a long, b long")
        assert dict(rows_of(similarity.assign_leaders(items, edges))) == lfmis(range(n), pairs)
        of = {i: i for i in range(n)}
        for _ in range(n):
            for a, b in pairs:
                of[a] = of[b] = min(of[a], of[b])
        touched = {x for p in pairs for x in p}
        assert dict(rows_of(components.connected_components(edges), "node", "component")) == {i: of[i] for i in touched}


def test_chain_has_leaders_apart_but_one_component(spark):
    items, edges = spark.createDataFrame([(i,) for i in range(3)], "id long"), spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    assert rows_of(similarity.assign_leaders(items, edges)) == [(0, 0), (1, 0), (2, 2)]
    assert {r[1] for r in rows_of(components.connected_components(edges), "node", "component")} == {0}


def test_vectors_of_zero_and_null(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [0.6, 0.8])], "id long, embedding array<float>")
    assert rows_of(similarity.cosine_join(v, 0.6), "a", "b") == [(1, 2)] or rows_of(similarity.cosine_join(v, 0.59), "a", "b") == [(1, 2), (1, 5), (2, 5)]
    assert rows_of(similarity.dispersion(v.withColumn("g", F.lit(0)), ["g"]), "n", "dispersion") == [(4, round(1 - (1 + 0.6 + 0.6) / 6, 6))]


def test_graph_corner_cases(spark):
    e = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.4), (2, 3, 1.0), (3, 1, 0.2)], "source long, target long, weight double").withColumns({"relation_type": F.lit("r"), "confidence": F.lit(0.5), "model_source": F.lit("m")})
    assert rows_of(graph.degrees(e)) == [(1, 4), (2, 3), (3, 2)]
    assert rows_of(graph.clustering(e), "node", "triangles", "coefficient") == [(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0)]
    assert graph.curvature(e).count() == 5 and graph.cochain(e).count() == 3 and graph.cochain(e.limit(0)).count() == 0


def replay(edges, changes, policy):
    out = dict(edges)
    for key, w in changes:
        old = out.get(key)
        out[key] = w if old is None or policy == "replace" else max(old, w) if policy == "max" else (old + w) / 2
    return {k: round(w, 6) for k, w in out.items()}


def test_upserts_and_rollbacks(spark):
    rng = random.Random(2)
    start = {(rng.randrange(4), rng.randrange(4)): rng.random() for _ in range(6)}
    changes = [((rng.randrange(4), rng.randrange(4)), rng.random()) for _ in range(30)]
    current = spark.createDataFrame([(*k, w) for k, w in start.items()], "source long, target long, weight double")
    new = spark.createDataFrame([(*k, w, i) for i, (k, w) in enumerate(changes)], "source long, target long, weight double, ord long")
    for policy in ("average", "max", "replace"):
        assert {(r.source, r.target): round(r.weight, 6) for r in graph.upsert_edges(current, new, policy).collect()} == replay(start, changes, policy)


def replay_deltas(edges, nodes, deltas):
    """One change after the other."""
    edges, nodes = dict(edges), set(nodes)
    for op, a, b, w in deltas:
        if op == "add_node":
            nodes.add(a)
        elif op == "delete_node":
            nodes.discard(a)
            edges = {k: v for k, v in edges.items() if a not in k}
        elif b is None or a == b or (op != "delete_edge" and not (w is not None and 0 <= w <= 1)):
            continue
        elif op == "delete_edge":
            edges.pop((a, b), None)
        elif op == "add_edge" or (a, b) in edges:
            edges[a, b] = w
    return edges, nodes


def replay_undo(edges, deltas):
    edges = dict(edges)
    for op, a, b, w, k in reversed(deltas):
        if op == "add_edge":
            edges.pop((a, b), None)
        elif op == "add_node":
            edges = {e: v for e, v in edges.items() if a not in e}
        elif w is not None and (op == "delete_edge" or (op == "update_edge" and (a, b) in edges)):
            edges[a, b] = (w, 0.5 if k is None else k)
    return edges


def test_changes_and_rollbacks_equal_one_after_the_other(spark):
    rng = random.Random(5)
    ops = ["add_edge", "update_edge", "delete_edge", "add_node", "delete_node"]
    for trial in range(3):
        start = {(rng.randrange(5), rng.randrange(5)): round(rng.random(), 3) for _ in range(8)}
        log = [(rng.choices(ops, [4, 3, 3, 1, 1])[0], rng.randrange(5), rng.choice([None, *range(5)]), rng.choice([None, 1.5, *[round(rng.random(), 3)] * 6])) for _ in range(60)]
        now = spark.createDataFrame([(*k, w) for k, w in start.items()], "source long, target long, weight double")
        deltas = spark.createDataFrame([(*d, i, i // 3) for i, d in enumerate(log)], "operation string, source long, target long, weight double, id long, ts long")
        edges, nodes = replay_deltas(start, {0, 1, 7}, log)
        assert {(r.source, r.target): r.weight for r in graph.apply_deltas(now, deltas).collect()} == edges
        assert {r.id for r in graph.apply_node_deltas(spark.createDataFrame([(0,), (1,), (7,)], "id long"), deltas).collect()} == nodes
        undo = [(op if op != "delete_node" else "add_node", a, b, rng.choice([None, w]), rng.choice([None, 0.25])) for op, a, b, w in log if b is not None]
        kappa = {k: (w, 0.75) for k, w in start.items()}
        table = spark.createDataFrame([(*d, i, i) for i, d in enumerate(undo)], "operation string, source long, target long, old_weight double, old_kappa double, id long, ts long")
        got = graph.roll_back(now.withColumn("kappa", F.lit(0.75)), table).collect()
        assert {(r.source, r.target): (r.weight, r.kappa) for r in got} == replay_undo(kappa, undo)


def test_batches_that_are_too_large_are_turned_away(spark):
    deltas = spark.createDataFrame([("s1", "add_edge", 1, 2, 0.5, i, i) for i in range(3)] + [("s2", "add_edge", 3, 4, 0.5, 9, 9), ("s2", "add_edge", 5, 5, 0.5, 10, 10)], "session string, operation string, source long, target long, weight double, id long, ts long")
    edges = spark.createDataFrame([(i, i + 1, 0.1) for i in range(30)], "source long, target long, weight double")
    nodes = spark.range(12)
    assert rows_of(graph.batch_allowed(deltas, nodes, edges)) == [("s1", 3, False), ("s2", 2, True)]
    assert [r.id for r in graph.accepted_deltas(deltas, nodes, edges).collect()] == [9]
    assert rows_of(graph.batch_allowed(deltas.filter("id = 9"), nodes.limit(0), edges.limit(0)), "allowed") == [(True,)]


def test_undo_scopes(spark):
    d = spark.createDataFrame([(1, "a", "2024-01-01", None), (2, "a", "2024-01-05", None), (3, "a", "2024-01-06", "2024-01-07"), (4, "b", "2024-01-05", None)], "id long, session string, ts string, rolled_back_at string").withColumn("ts", F.to_timestamp("ts"))
    of = lambda **k: sorted(r.id for r in graph.to_undo(d, F.col("session") == "a", **k).collect())
    assert (of(), of(since="2024-01-02"), of(ids=[1, 3, 4])) == ([1, 2], [2], [1])


def test_similar_names_lose_nothing(spark):
    rng = random.Random(3)
    names = {"color", "colour", "analyze", "analyse", "x", "xy", "aaaa", "aaab", "été", "êté", "été long", "\U0001f44dok", "\U0001f44dokk", "martha", "marhta"}
    while len(names) < 260:
        base = rng.choice(sorted(names))
        at = rng.randrange(len(base) + 1)
        names.add(rng.choice([base[:at] + rng.choice("abcde") + base[at:], base[:at] + base[at + 1 :] or "q", base[::-1], "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))]))
    frame = spark.createDataFrame([(n,) for n in [*names, "color", None, ""]], "name string")
    ordered = sorted(names)
    for least in (0.9, 0.85):
        want = {(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if align.jaro_winkler(a, b) > least}
        assert set(rows_of(align.similar_names(frame, least=least))) == want and ("color", "colour") in want


def test_anchors_groups_and_vectors_in_neighbour_matches(spark):
    schema = "term string, model string, pos long, relation string, concept string"
    g = spark.createDataFrame([("a", "m1", 1, "causes", "Paris"), ("a", "m1", 2, "leads to", "colour"), ("a", "m1", 3, "is", "auto"), ("b", "m2", 1, "caused", "Pariss"), ("b", "m2", 2, "causes", "color"), ("b", "m2", 3, "is", "car"), ("b", "m2", 4, "causes", "paris")], schema)
    found = lambda **k: {(r.concept_x, r.concept_y, r.weight) for r in align.neighbour_matches(g, **k).collect()}
    groups = spark.createDataFrame([("leads to", "cause"), ("causes", "cause")], "relation string, canonical string")
    vectors = spark.createDataFrame([("auto", [1.0, 0.1]), ("car", [1.0, 0.0]), ("color", [0.0, 1.0])], "name string, embedding array<double>")
    assert found() == {("paris", "paris", 2.0)}
    assert found(groups=groups) == {("paris", "paris", 2.0), ("colour", "color", 1.0)}
    assert found(vectors=vectors) == {("paris", "paris", 2.0), ("auto", "car", 1.0)}
    assert found(groups=groups, known=spark.createDataFrame([("COLOR",)], "name string")) == {("paris", "paris", 2.0)}


def test_reconciliation_is_skipped_without_enough_terms(spark):
    v = spark.createDataFrame([("m1", "car", "has", "wheel", 0.9, 1), ("m2", "auto", "has", "wheel", 0.9, 2), ("m2", "tree", "has", "leaf", 0.9, 3), ("m1", "oak", "has", "leaf", 0.8, 4)], VOTE)
    m = votes.model_table(spark, {"m1": 1.0, "m2": 1.0})
    g = spark.createDataFrame([("car", "m1", 1, "r", "Wheel"), ("auto", "m2", 1, "r", "Wheel")], "term string, model string, pos long, relation string, concept string")
    how = lambda rows, **k: (lambda r: (r[0], rows_of(r[1], "subject", "n_votes")))(align.reconciled_consensus(rows, m, g, **k))
    assert how(v) == ("aligned", [("auto", 2), ("oak", 1), ("tree", 1)])
    assert how(v, enabled=False)[0] == "disabled" and how(v.limit(0)) == ("no votes", []) and how(v.limit(2))[0].startswith("fewer")


def test_hashed_join_and_blocks_of_queries(spark, monkeypatch):
    rng = random.Random(9)
    x = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(120)]
    x += [[c + rng.gauss(0, 0.05) for c in v] for v in x[:40]]
    v = spark.createDataFrame([*enumerate(x), (500, [1.0]), (501, [float("inf")] * 8), (502, None)], "id long, embedding array<double>")
    exact, hashed = ({(r.a, r.b) for r in f(v, 0.95).collect()} for f in (similarity.cosine_join, similarity.cosine_join_hashed))
    assert hashed <= exact and len(hashed) >= 0.9 * len(exact) > 30
    asked = v.filter("id % 7 = 0").select(F.col("id").alias("query"), "embedding")
    whole = rows_of(similarity.nearest_to(v, asked, k=3, least=-1.0))
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)
    assert rows_of(similarity.nearest_to(v, asked, k=3, least=-1.0)) == whole and len(whole) == 3 * 23


def test_crystallise_takes_the_first_of_a_hash_before_scores(spark):
    rows = [("A", "r", "b", 0.1, 2, "m1", 1, "voted", None), (" a", "R", "b", 0.9, 3, "m1,m2", 2, "voted", None), ("c", "r", "d", 0.9, 3, "m1,m2,x3", 3, "deterministic", None), ("e", "verdict", "NO", 0.8, 3, "m1,m2,x3", 4, "deterministic", "s")]
    c = spark.createDataFrame(rows, "subject string, relation string, object string, score double, n_votes long, models string, ord long, method string, anchor string").withColumn("claim_type", F.lit("odd"))
    got = votes.crystallise(c, families={"m": "mill"}, verdict_penalties={"YES": 1.0}, type_penalties={"odd": 0.5})
    assert rows_of(got, "subject", "score", "agreeing", "n_models") == [("e", 0.26, 3, 3)]


def test_evidence_by_whole_path(spark, tmp_path):
    import hashlib

    for folder, body in (("a", b"one"), ("b", b"two")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.txt").write_bytes(body)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    one = hashlib.sha256(b"one").hexdigest()
    rows = [("a/x.txt", one), ("b/x.txt", one), ("b/../a/./x.txt", one), ("a/../../x.txt", one), ("/a/x.txt", one), ("x.txt", one), ("https://h/x", one)]
    got = landing.verify_evidence(spark.createDataFrame(rows, "location string, sha256 string"), files, str(tmp_path))
    assert {r.location: r.state for r in got.collect()} == dict(zip((r[0] for r in rows), ["verified", "different", "verified", "outside", "outside", "missing", "declared"], strict=True))
    assert {r.state: r.n for r in landing.evidence_totals(got).collect()}["all"] == len(rows)


def test_tampered_proposals(spark):
    items = spark.createDataFrame([(1, "f", "h", [("k", "b", "0", "d"), ("k", "a", "0", "d")]), (2, "f", None, []), (3, None, None, [])], "id long, frame string, frame_hash string, evidence array<struct<kind:string,location:string,sha256:string,description:string>>")
    built = landing.proposals(items)
    changed = built.withColumn("artifact", F.when(F.col("id") == 1, F.regexp_replace("artifact", "proposed", "accepted")).otherwise(F.col("artifact")))
    assert rows_of(landing.verify_proposals(built), "id", "complete", "intact") == [(1, True, True), (2, False, True), (3, True, True)]
    assert rows_of(landing.verify_proposals(changed), "id", "intact") == [(1, False), (2, True), (3, True)]


def test_pinned_rows_and_retention(spark):
    log = spark.createDataFrame([(1, 0, "system", "x" * 9000), (1, 1, "user", "a" * 400), (1, 2, "user", "b" * 40), (2, 0, "user", "c" * 9000)], "conv_id long, turn long, role string, text string")
    assert rows_of(sessions.trim(log, budget=50), "conv_id", "turn", "back") == [(1, 0, 0), (1, 2, 1), (2, 0, 1)]
    events = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-02-01")], "session string, ts string").withColumn("ts", F.to_timestamp("ts"))
    other = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "session string, id long")
    assert rows_of(sessions.retain(events, "2024-01-15", of=other), "id") == [(2,), (3,)]
    assert rows_of(sessions.forget_session(other, events, "2024-01-15"), "id", "session") == [(1, None), (2, "b"), (3, None)]


def test_written_tables_are_released(spark):
    import os

    kept, gone = (storage.materialise(spark.range(5), "test") for _ in range(2))
    folder = os.path.dirname(gone.inputFiles()[0].removeprefix("file://"))
    storage.release(gone)
    assert not os.path.exists(folder) and kept.count() == 5


def test_gaps(spark):
    concepts = spark.createDataFrame([(i,) for i in range(6)], "id long")
    e = spark.createDataFrame([(a, b, 1.0) for a in range(5) for b in range(a)], "source long, target long, weight double")
    assert rows_of(gaps.isolated(concepts, e), "subject", "priority") == [("5", 0.8)]
    c = spark.createDataFrame([(1, 2, "cause", 0.5), (2, 1, "caused_by", None), (1, 2, "stop", 0.2), (3, 4, "cause", 0.1)], "source long, target long, relation_type string, confidence double")
    rules = spark.createDataFrame([("stop", "cause", "same"), ("cause", "caused_by", "same")], "left string, right string, direction string")
    assert rows_of(gaps.contradictions(c, rules), "first", "second", "priority") == [("cause", "stop", 0.92)]


def test_runs_and_predictions(spark):
    run = lambda rows: spark.createDataFrame(rows, "claim_hash string, tier string, score double")
    got = dict(rows_of(calibrate.compare_runs(run([("a", "sandbox", 0.1), ("b", "verified", 0.9), ("c", "validated", 0.7)]), run([("a", "proposition", 0.5), ("b", "validated", 0.8), ("d", "sandbox", 0.2)])), "claim_hash", "status"))
    assert got == {"a": "improved", "b": "degraded", "c": "lost", "d": "new"}
    p = spark.createDataFrame([("m", 0.8, True, 1), ("m", 0.8, False, 1), ("m", 0.5, True, None)], "model string, confidence double, agreed boolean, outcome int")
    assert sorted(r.brier for r in calibrate.resolve(p).collect()) == [0.04, 0.64]
    staged = spark.createDataFrame([(1, [1.0, 2.0], "new"), (2, [1.0], "new")], "id long, embedding array<float>, model_id string")
    current = spark.createDataFrame([(1, [9.0, 9.0], "old")], staged.schema)
    assert rows_of(calibrate.finalise_migration(current, staged, 2), "id", "model_id") == [(1, "old")]
    assert rows_of(calibrate.finalise_migration(current, staged.limit(1), 2), "id", "model_id") == [(1, "new")]


@given(st.text("abcdé", max_size=8), st.text("abcdé", max_size=8))
@settings(max_examples=200, deadline=None)
def test_jaro_winkler_is_a_similarity(a, b):
    s = align.jaro_winkler(a, b)
    assert 0 <= s <= 1 and (s == 1) == (a == b) and abs(s - align.jaro_winkler(b, a)) < 1e-9


def test_jaro_winkler_of_many_pairs_equals_one_by_one():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(0, 9)))
    pairs = [(word(), word()) for _ in range(3000)] + [("", ""), ("", "a"), ("same", "same"), ("日本", "本日")]
    got = align.jaro_winkler_pairs(*map(list, zip(*pairs)))
    assert max(abs(x - align.jaro_winkler(a, b)) for x, (a, b) in zip(got, pairs)) < 1e-12


def test_jaro_winkler_known_values():
    assert [round(align.jaro_winkler(a, b), 4) for a, b in (("martha", "marhta"), ("dwayne", "duane"), ("dixon", "dicksonx"))] == [0.9611, 0.84, 0.8133]


def test_alignment(spark):
    g = spark.createDataFrame([(t, m, i, "r", c) for t, m, cs in (("car", "m1", ["wheel", "road"]), ("auto", "m2", ["wheel", "road"]), ("tree", "m2", ["leaf"])) for i, c in enumerate(cs)], "term string, model string, pos long, relation string, concept string")
    scores = align.overlap(g, align.neighbour_matches(g))
    assert rows_of(scores, "term_x", "term_y", "score") == [("car", "auto", 1.0)]
    groups = align.term_clusters(scores)
    canonical = align.canonical_terms(groups, spark.createDataFrame([("car", 1), ("auto", 1)], "term string, n long"))
    mapping = align.alignment(groups, canonical, scores)
    v = spark.createDataFrame([("Car", "is", "x"), ("car", "is", "auto")], "subject string, relation string, object string")
    assert rows_of(mapping) == [("car", "auto", 1.0)] and rows_of(align.apply_alignment(v, mapping), "subject", "object") == [("auto", "auto"), ("auto", "x")]


def test_parsing(spark):
    raw = spark.createDataFrame([(1, 'x [{"subject": "a", "object": "b", "confidence": 1}] y'), (2, "{bad"), (3, None)], "id long, text string")
    assert rows_of(landing.parse_triples(raw), "id", "subject", "rejected") == [(1, "a", False), (2, None, True), (3, None, True)]


def test_rolling_calibration_as_a_stream(spark, tmp_path):
    rng = random.Random(4)
    day = lambda d, h: f"2024-01-{d:02d} {h:02d}:00:00"
    p = spark.createDataFrame([(i % 40, f"m{i % 3}", rng.random(), day(1 + i % 20, i % 24)) for i in range(300)], "claim long, model string, p double, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    o = spark.createDataFrame([(i % 40, i % 2, day(1 + i % 20, i % 24)) for i in range(120)], "claim long, outcome int, resolved_at string").withColumn("resolved_at", F.to_timestamp("resolved_at"))
    end = spark.createDataFrame([(999, "m0", 0.5, "2024-06-01 00:00:00")], "claim long, model string, p double, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    p.unionByName(end).write.parquet(str(tmp_path / "p"))
    o.unionByName(end.select("claim", F.lit(1).alias("outcome"), F.col("created_at").alias("resolved_at"))).write.parquet(str(tmp_path / "o"))
    read = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    options = {"width": "5 days", "slide": "5 days", "patience": "2 days"}
    got = rows_of(streams.drain(streams.rolling_calibration(read("p", p), read("o", o), **options), "test"))
    want = rows_of(streams.rolling_calibration(p, o, **options))
    assert got and got == want


def test_batch_and_stream_agree(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i % 20:02d} 0{i % 10}:00:00", "abc"[i % 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "user_id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([(1, "2024-03-01 00:00:00", "z")], "user_id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    late.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = rows_of(streams.drain(streams.event_rates(stream), "test"))
    want = [r for r in rows_of(streams.event_rates(df))]
    assert [r for r in got if r[1] != "z"] == want
