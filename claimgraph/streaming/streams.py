"""The same logic over event streams, with watermarks and windows. Batch tables may be passed in too."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from claimgraph.functions.storage import shared_dir
from claimgraph.operators import votes as batch_votes
from claimgraph.sources.landing import conflict_status
from claimgraph.streaming.edge_store import EdgeStore


def session_activity(events: DataFrame, *, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """T1 of (user_id, ts): each session's events, begin and last activity; a session ends after a gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def signed_degrees(deltas: DataFrame) -> DataFrame:
    """T2 of (operation, source, target): each node's edges added less those deleted, kept up to date."""
    sign = F.when(F.col("operation") == "add_edge", 1).when(F.col("operation") == "delete_edge", -1)
    each = deltas.withColumn("sign", sign).filter("sign is not null").select(F.explode(F.array_distinct(F.array("source", "target"))).alias("node"), "sign")
    return each.groupBy("node").agg(F.sum("sign").alias("degree"), F.count(F.lit(1)).alias("changes"))


def event_rates(events: DataFrame, *, width: str = "1 day", baseline: float = 50.0, late: str = "1 day") -> DataFrame:
    """T3 of (ts, event_type): events of each window against a baseline, and what that means."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    ratio = F.col("n") / baseline
    return rows.select(F.col("w.start").alias("began"), "event_type", "n", F.round(ratio, 4).alias("ratio"), conflict_status(ratio).alias("status"))


def _spans(found: list[list[int]], gap: int) -> list[list[int]]:
    """[first, last, events] of spans of activity in order, those not more than a gap apart as one."""
    out: list[list[int]] = []
    for first, last, n in sorted(found):
        if out and first <= out[-1][1] + gap:
            out[-1] = [out[-1][0], max(out[-1][1], last), out[-1][2] + n]
        else:
            out.append([first, last, n])
    return out


def inactivity(events: DataFrame, *, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """T1 of (user_id, ts): a row (user_id, last_at, events) each time a session has had no event for the gap.

    events counts all of the session's events so far. A session that comes back and rests again is told of again. The
    state of a session is its spans of activity that the watermark hasn't passed yet and its count; a timer at the end
    of the earliest span tells of it though no further event comes. Rows come out the same whatever their batches and
    the order within the watermark. A table gives what its rows as a stream would, once all is over.
    """
    micros = int(pd.Timedelta(gap) // pd.Timedelta("1us"))
    rows = events.select("user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    if not events.isStreaming:
        spans = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_at"))
        return spans.select("user_id", "last_at", F.sum("n").over(Window.partitionBy("user_id").orderBy("last_at")).alias("events"))
    kind = events.schema["user_id"].dataType.simpleString()

    def told(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, known = state.get if state.exists else (0, "[]")
        spans = _spans([*json.loads(known), *([int(t), int(t), 1] for part in parts for t in part["us"])], micros)
        passed, out = state.getCurrentWatermarkMs() * 1000, []
        while spans and spans[0][1] + micros <= passed:
            _, last, n = spans.pop(0)
            total += n
            out.append((key[0], last, total))
        state.update((total, json.dumps(spans)))
        if spans:
            state.setTimeoutTimestamp(max((spans[0][1] + micros) // 1000, passed // 1000 + 1))
        yield pd.DataFrame(out, columns=["user_id", "us", "events"])

    stateful = rows.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(told, f"user_id {kind}, us long, events long", "total long, spans string", "append", GroupStateTimeout.EventTimeTimeout)
    return stateful.select("user_id", F.timestamp_micros("us").alias("last_at"), "events")


def windowed_consensus(votes: DataFrame, models: DataFrame, *, weighted: bool = False, width: str = "7 days", late: str = "1 day", **thresholds) -> DataFrame:
    """T4: A1's claims, or A2's with ``weighted``, of each run and window, each vote counted once.

    votes have A1's columns and ts, run_id and pos; a model's vote at a place of a run counts once. The columns, the
    thresholds and what they filter are those of exact_consensus and weighted_consensus, which do the work. A window's
    claims come out when the watermark has passed it.
    """
    once = ["run_id", "model", "pos"]
    rows = votes.withWatermark("ts", late).dropDuplicatesWithinWatermark(once) if votes.isStreaming else votes.dropDuplicates(once)
    rows = rows.withColumn("w", F.window("ts", width))
    of = batch_votes.weighted_consensus if weighted else batch_votes.exact_consensus
    found = of(rows, models, by=["w", "run_id"], **thresholds)
    return found.withColumn("began", F.col("w.start")).drop("w")


def rolling_calibration(predictions: DataFrame, outcomes: DataFrame, *, width: str = "30 days", slide: str = "10 days", late: str = "1 day", patience: str = "90 days") -> DataFrame:
    """T5 of predictions (claim, model, p, created_at) and outcomes (claim, outcome, resolved_at): Brier by window and model."""
    p, o = predictions.withWatermark("created_at", late), outcomes.withWatermark("resolved_at", late)
    near = (F.col("o.resolved_at") >= F.col("p.created_at")) & (F.col("o.resolved_at") <= F.col("p.created_at") + F.expr(f"interval {patience}"))
    both = p.alias("p").join(o.alias("o"), (F.col("p.claim") == F.col("o.claim")) & near)
    b: Column = F.pow(F.col("p.p") - F.col("o.outcome"), 2)
    rows = both.groupBy(F.window("p.created_at", width, slide).alias("w"), F.col("p.model").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(b), 4).alias("avg_brier"), F.round(F.min(b), 4).alias("least"), F.round(F.max(b), 4).alias("most"))
    return rows.select(F.col("w.start").alias("began"), "model", "n", "avg_brier", "least", "most")


#: State of a stream lies in files, not in the executors' heaps, where all of it would have to fit at once.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # else each row written is looked up once more
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def run_to_table(stream: DataFrame, path: str, *, mode: str = "append") -> StreamingQuery:
    """All that a stream holds now, written to a Parquet table; its checkpoint lies beside it in the shared folder."""
    conf = stream.sparkSession.conf
    before = {name: conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        conf.set(name, value)
    try:  # a query keeps the settings that it was started with
        query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
    query.awaitTermination()
    return query


class LateRows(StreamingQueryListener):
    """Counts, batch by batch, the rows of a query that came behind its watermark and were dropped.

    Spark counts them at each stateful operator. Where that is a deduplication or keyed state these are rows as they
    came; an aggregation sees rows that its tasks have summed up, of which each counts once.
    """

    def __init__(self) -> None:
        self.found: list[tuple] = []

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for place, operator in enumerate(p.stateOperators):
            self.found.append((str(p.runId), p.batchId, place, operator.operatorName, p.eventTime.get("watermark"), p.numInputRows, operator.numRowsDroppedByWatermark))

    def of(self, query: StreamingQuery) -> list[tuple]:
        return [r[1:] for r in self.found if r[0] == str(query.runId)]


LATE = "batch long, place int, operator string, watermark string, rows_in long, late_rows long"


def drain_with_late(stream: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """What drain gives, and (batch, place, operator, watermark, rows_in, late_rows) of each stateful operator."""
    spark, listener = stream.sparkSession, LateRows()
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    spark.streams.addListener(listener)
    try:
        query = run_to_table(stream, path)
    finally:
        spark.streams.removeListener(listener)
    # listeners are told a little later than awaitTermination returns; the query itself keeps its last batches
    told = {(r[0], r[1]): r for r in listener.of(query)}
    for p in query.recentProgress:
        for place, operator in enumerate(p.stateOperators):
            told.setdefault((p.batchId, place), (p.batchId, place, operator.operatorName, p.eventTime.get("watermark"), p.numInputRows, operator.numRowsDroppedByWatermark))
    return spark.read.schema(stream.schema).parquet(path), spark.createDataFrame(sorted(told.values()), LATE)


def drain(stream: DataFrame, tag: str) -> DataFrame:
    """The rows that a stream of what is there now gives in append mode, as a table."""
    path = f"{shared_dir(stream.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    run_to_table(stream, path)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def follow_deltas(start: DataFrame, deltas: DataFrame, *, path: str | None = None, buckets: int = 64) -> EdgeStore:
    """The store of edges, queue and curvature after all that a stream of deltas holds now.

    A store that is at the path already goes on from its last batch, and start is then left aside. Without a path the
    store has a place of its own in the shared folder.
    """
    store = EdgeStore(deltas.sparkSession, path or f"{shared_dir(deltas.sparkSession)}/t2-{uuid.uuid4().hex}")
    if not store.table.versions() or not store.curved.versions():
        store = EdgeStore.create(store.path, start, buckets=buckets)
    store.follow(deltas)
    return store
