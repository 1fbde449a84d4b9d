"""Streams that stop and start, timers, late rows and stored tables, against the same rows taken at once."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claimgraph.functions.versioned import VersionedTable
from claimgraph.operators import calibrate, graph, sessions, votes
from claimgraph.streaming import streams
from claimgraph.streaming.edge_store import EdgeStore

DELTA = "operation string, source long, target long, weight double, id long, ts long"
DAY = datetime(2024, 1, 1)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def random_deltas(n, nodes, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["add_edge"] * 5 + ["update_edge"] * 3 + ["delete_edge"] * 2 + ["add_node", "delete_node"])
        out.append((kind, rng.randrange(nodes), rng.randrange(nodes) if kind.endswith("edge") else None, rng.random() * 1.1, i, i))
    return out


def test_edge_store_equals_one_replay_whatever_stops(spark, tmp_path):
    rng = random.Random(1)
    start = spark.createDataFrame(sorted({(rng.randrange(60), rng.randrange(60)): rng.random() for _ in range(150)}.items()), "e struct<source:long,target:long>, weight double").select("e.*", "weight")
    changes = random_deltas(240, 60, 2)
    batches = [spark.createDataFrame(changes[i : i + 40], DELTA) for i in range(0, 240, 40)]
    store = EdgeStore.create(str(tmp_path / "store"), start, buckets=8)
    for number, batch in enumerate(batches):
        if number == 2:  # stopped after the edges were written and before the queue was
            whole = store._queued
            store._queued = lambda n: 1 / 0
            with pytest.raises(ZeroDivisionError):
                store.merge(batch, number)
            store._queued = whole
        store = EdgeStore(spark, str(tmp_path / "store"))  # another process
        store.merge(batch, number)
        if number in (1, 4):
            store.merge(batch, number)  # comes again
            assert store.refresh() == number and store.queue().isEmpty()
        upto = spark.createDataFrame(changes[: 40 * (number + 1)], DELTA)
        assert rows_of(store.edges()) == rows_of(graph.apply_deltas(start, upto))
    store.merge(batches[0], 0)  # long done
    assert {r.batch for r in store.queue().collect()} == {5}
    store.refresh()
    assert rows_of(store.curvature()) == rows_of(graph.curvature(store.edges())) and store.refresh() == 5


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    start = spark.range(0, 400, 2).selectExpr("id AS source", "id + 1 AS target", "0.5D AS weight")
    store = EdgeStore.create(str(tmp_path / "store"), start, buckets=32)
    before = store.table.manifest()["folders"]
    store.merge(spark.createDataFrame([("add_edge", 10, 20, 0.9, 1, 1), ("delete_node", 30, None, None, 2, 2)], DELTA), 0)
    after = store.table.manifest()["folders"]
    ends = store.table.touched(spark.createDataFrame([(10,), (20,), (30,), (31,)], "node long"))
    changed = {int(b) for b in before.keys() | after.keys() if before.get(b) != after.get(b)}
    assert changed <= set(ends) and len(changed) >= 2
    curved = store.curved.manifest()["folders"]
    store.refresh()
    now = store.curved.manifest()["folders"]
    assert 0 < sum(now.get(b) != f for b, f in curved.items()) <= 7
    assert rows_of(store.curvature()) == rows_of(graph.curvature(store.edges()))


def test_a_refresh_reads_no_edges_of_neighbours(spark, tmp_path, monkeypatch):
    """A hub's neighbours have edges of their own, in other buckets, which a change at the hub leaves unread."""
    rows = [(0, i, 0.5) for i in range(1, 120)] + [(i, i + 200, 0.4) for i in range(1, 120)] + [(5, 6, 0.3)]
    store = EdgeStore.create(str(tmp_path / "store"), spark.createDataFrame(rows, "source long, target long, weight double"), buckets=64)
    store.merge(spark.createDataFrame([("add_edge", 0, 205, 0.9, 1, 1), ("delete_edge", 5, 6, None, 2, 2), ("update_edge", 0, 7, 0.1, 3, 3)], DELTA), 0)
    nodes = set(store.table.touched(store.queue().select("node")))
    read, looked = VersionedTable.read, []
    monkeypatch.setattr(VersionedTable, "read", lambda table, **of: (looked.append((table.path, of.get("buckets"))), read(table, **of))[1])
    store.refresh()
    of_edges = [set(b) for path, b in looked if path == store.table.path and b is not None]
    assert of_edges and all(b <= nodes for b in of_edges) and len(nodes) <= 5
    monkeypatch.undo()
    assert rows_of(store.curvature()) == rows_of(graph.curvature(store.edges()))


def test_a_stream_of_deltas_goes_on_after_a_stop(spark, tmp_path):
    changes, start = random_deltas(90, 25, 5), spark.createDataFrame([(1, 2, 0.3), (6, 7, 0.2)], "source long, target long, weight double")
    read = lambda: spark.readStream.schema(DELTA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for part in range(3):
        spark.createDataFrame(changes[30 * part : 30 * part + 30], DELTA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        store = streams.follow_deltas(start, read(), path=str(tmp_path / "store"), buckets=4)
        assert rows_of(store.edges()) == rows_of(graph.apply_deltas(start, spark.createDataFrame(changes[: 30 * part + 30], DELTA)))
    assert store.table.tag == {"batch": 2}
    store.refresh()
    assert rows_of(store.curvature()) == rows_of(graph.curvature(store.edges()))


def events_of(spark, seed=3):
    rng = random.Random(seed)
    found = [(u, DAY + timedelta(minutes=rng.randrange(0, 6000))) for u in range(12) for _ in range(rng.randrange(1, 25))]
    return spark.createDataFrame([*found, found[0]], "user_id long, ts timestamp")


@pytest.mark.parametrize("files", [1, 5])
def test_inactivity_is_told_once_by_timers(spark, tmp_path, files):
    events = events_of(spark)
    ordered = events.orderBy("ts").collect() if files > 1 else events.collect()
    end = spark.createDataFrame([(99, DAY + timedelta(days=30))], "user_id long, ts timestamp")
    for i in range(files):  # within a file and between two neighbours any order, as within the watermark
        part = ordered[i * len(ordered) // files : (i + 1) * len(ordered) // files]
        random.Random(i).shuffle(part)
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streams.drain(streams.inactivity(stream, gap="2 hours", late="2 days"), "inactive").filter("user_id != 99")
    assert rows_of(got) == rows_of(streams.inactivity(events, gap="2 hours"))
    last = got.groupBy("user_id").agg(F.max("last_at").alias("last_at"), F.max("events").alias("events"))
    log = events.withColumnRenamed("user_id", "session")
    assert rows_of(last) == rows_of(sessions.inactive(log, "2024-01-30 00:00:00"))


def votes_of(spark):
    rng = random.Random(7)
    rows = []
    for i in range(700):
        rows.append((DAY + timedelta(hours=rng.randrange(0, 480)), i % 2, f"m{rng.randrange(4)}", i, rng.choice(["A", "a ", "b"]), "r", rng.choice("xy"), rng.random(), i))
    return spark.createDataFrame([*rows, *rows[:50]], "ts timestamp, run_id int, model string, pos int, subject string, relation string, object string, confidence double, ord int")


@pytest.mark.parametrize("weighted", [False, True])
def test_streamed_consensus_equals_the_batch_by_run(spark, tmp_path, weighted):
    cast = votes_of(spark)
    models = votes.model_table(spark, {f"m{i}": 1 - i / 10 for i in range(5)})
    end = cast.limit(1).withColumn("ts", F.lit("2024-06-01").cast("timestamp")).withColumn("pos", F.lit(-1))
    cast.repartition(3).write.parquet(str(tmp_path / "in"))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cast.schema).parquet(str(tmp_path / "in"))
    got = streams.drain(streams.windowed_consensus(stream, models, weighted=weighted, width="5 days"), "t4")
    of = votes.weighted_consensus if weighted else votes.exact_consensus
    want = []
    once = cast.dropDuplicates(["run_id", "model", "pos"]).withColumn("began", F.window("ts", "5 days")["start"])
    for began, run in once.select("began", "run_id").distinct().collect():
        part = of(once.filter((F.col("began") == began) & (F.col("run_id") == run)), models)
        want += [(began, run, *r) for r in part.collect()]
    names = [c for c in got.columns if c not in ("began", "run_id")]
    assert rows_of(got, "began", "run_id", *names) == sorted(want, key=str) and len(want) > 20


def test_late_rows_are_counted(spark, tmp_path):
    cast = votes_of(spark).filter("ts < '2024-01-15'")
    first = cast.limit(1).withColumn("ts", F.lit("2024-03-01").cast("timestamp"))
    late = cast.filter("ord >= 100").limit(30).withColumn("pos", F.col("pos") + 5000)
    # a batch drops what lies behind the watermark with which the batch before it began
    for part in (cast, first, first.withColumn("pos", F.lit(-7)), late):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cast.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    models = votes.model_table(spark, {"m0": 1.0, "m1": 1.0})
    rows, told = streams.drain_with_late(streams.windowed_consensus(stream, models, width="5 days"), "late")
    of = {(r.batch, r.operator): r.late_rows for r in told.collect()}
    assert sum(n for (_, name), n in of.items() if name.startswith("dedupe")) == late.count()
    assert told.columns == ["batch", "place", "operator", "watermark", "rows_in", "late_rows"] and rows.count() > 0


def test_versions_stay_readable_and_old_ones_go(spark, tmp_path):
    rows = spark.range(100).selectExpr("id AS k", "id * 2 AS v")
    table = VersionedTable.create(str(tmp_path / "t"), rows, ["k"], buckets=8, tag={"n": 0})
    with pytest.raises(FileExistsError):
        VersionedTable.create(str(tmp_path / "t"), rows, ["k"])
    keys = spark.createDataFrame([(5,), (6,)], "k int")  # another type of the same numbers
    table.update(keys, lambda now: now.filter("k != 5").withColumn("v", F.when(F.col("k") == 6, -1).otherwise(F.col("v"))), tag={"n": 1})
    again = VersionedTable(spark, str(tmp_path / "t"))
    assert again.versions() == [0, 1] and again.tag == {"n": 1}
    assert rows_of(again.read(version=0)) == rows_of(rows) and again.read().count() == 99 and again.read().filter("v = -1").count() == 1
    old, new = again.manifest(0)["folders"], again.manifest(1)["folders"]
    assert {int(b) for b in old if old[b] != new.get(b)} == set(again.touched(keys))
    again.rewrite([], rows.limit(0))
    again.rewrite(list(range(8)), rows.limit(0))
    assert again.read().isEmpty() and again.versions() == [0, 1, 2, 3]
    again.rewrite(list(range(8)), rows)
    again.expire(keep=1)
    assert again.versions() == [4] and rows_of(again.read()) == rows_of(rows) and len(again._names("data")) == 1
    with pytest.raises(RuntimeError, match="already"):
        again._commit(again.manifest(), rows.limit(0), [])


def test_stored_sessions_edges_and_snapshots(spark, tmp_path):
    log = spark.createDataFrame([(c, t, "user", f"text {t}") for c in range(40) for t in range(3)], "conv_id long, turn long, role string, text string")
    store = sessions.export_sessions(log, str(tmp_path / "sessions"), buckets=16)
    assert rows_of(sessions.import_sessions(store)) == rows_of(log)
    assert rows_of(sessions.import_sessions(store, log.filter("conv_id in (3, 4)").select("conv_id"))) == rows_of(log.filter("conv_id in (3, 4)"))
    new = spark.createDataFrame([(3, 0, "user", "only this"), (77, 0, "user", "new")], log.schema)
    before = store.manifest()["folders"]
    sessions.export_sessions(new, str(tmp_path / "sessions"))
    assert rows_of(sessions.import_sessions(store)) == rows_of(log.filter("conv_id != 3").union(new))
    events = spark.createDataFrame([(c, DAY if c == 5 else DAY + timedelta(days=9)) for c in range(40)], "session long, ts timestamp")
    after = store.manifest()["folders"]
    assert {int(b) for b in after if after[b] != before.get(b)} <= set(store.touched(new))
    sessions.forget_stored(store, events, "2024-01-05")
    assert {r.conv_id for r in sessions.import_sessions(store).collect()} == {*range(40), 77} - {5}
    last = store.manifest()["folders"]
    assert {int(b) for b in after if after[b] != last.get(b)} == set(store.touched(spark.createDataFrame([(5,)], "conv_id long")))

    edges = spark.range(50).selectExpr("id AS source", "id + 1 AS target", "0.4D AS weight")
    stored = VersionedTable.create(str(tmp_path / "edges"), edges.withColumn("extractions", F.lit(0).cast("long")), ["source", "target"], buckets=8)
    seen = spark.createDataFrame([(1, 2, 0.8, 1), (90, 91, 0.5, 2), (1, 2, 0.6, 3)], "source long, target long, weight double, ord long")
    graph.upsert_stored(stored, seen)
    assert rows_of(stored.read(), "source", "target", "weight") == rows_of(graph.upsert_edges(edges, seen), "source", "target", "weight")

    landed = spark.createDataFrame([("s", str(i % 9), "v1", f"raw {i}", i) for i in range(30)], "source_id string, query_hash string, source_version string, raw_response string, fetched_at long")
    kept = calibrate.land_snapshots(landed.filter("fetched_at >= 12"), str(tmp_path / "snapshots"), buckets=4)
    kept = calibrate.land_snapshots(landed, str(tmp_path / "snapshots"))
    assert rows_of(kept.read()) == rows_of(calibrate.store_snapshots(landed))
