"""Queries of logs and landed text: sessions, keywords, memory, source normalisers and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimgraph.functions.storage import materialise, shared_dir
from claimgraph.functions.versioned import VersionedTable
from claimgraph.operators import sessions
from claimgraph.plans import inputs as I
from claimgraph.plans.of_graphs import CURVED
from claimgraph.sources import folders, landing
from claimgraph.streaming import streams


def talk(s, d):
    return I.table(s, d, "conversations")


def by_user(s, d):
    return I.table(s, d, "events").withColumnRenamed("user_id", "session")


def memory(s, d):
    v = I.vectors(s, d)
    return v.select(F.col("label").alias("session"), F.col("id").alias("turn"), "embedding")


def asked(s, d):
    v = I.vectors(s, d)
    best = v.groupBy("label").agg(F.min_by("embedding", "id").alias("query"), F.max("id").alias("now"))
    return best.withColumnRenamed("label", "session")


def responses(s, d):
    """Raw model answers made of orders: a fenced array, JSON lines, a single object, or prose."""
    o = I.table(s, d, "orders")
    one = lambda i: F.concat(F.lit('{"subject": "order '), F.col("o_orderkey"), F.lit(f'", "relation": "r{i}", "object": "'), F.col("o_orderstatus"), F.lit('", "confidence": 0.5}'))
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("<think>[1]</think>```json\n["), one(0), F.lit(", "), one(1), F.lit("]\n```"))).when(F.col("o_orderkey") % 4 == 1, F.concat(one(0), F.lit("\n"), one(1), F.lit("\nend"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("Here: "), one(0))).otherwise(F.lit("no answer"))
    return o.select(F.col("o_orderkey").alias("id"), text.alias("text"))


def verdict_texts(s, d):
    o = I.table(s, d, "orders")
    text = F.concat(F.lit('{"verdict": "'), F.when(F.col("o_orderstatus") == "F", "supported").when(F.col("o_orderstatus") == "O", "Contested").otherwise("maybe"), F.lit('", "claim_type": "Predictive", "confidence": 0.75, "reasoning": "because", "evidence": [{"subject": "a", "object": "b"}, {"subject": "c"}]}'))
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, "nothing").otherwise(text).alias("text"))


def snapshots(s, d):
    e = I.table(s, d, "events")
    raw = F.concat(
        F.lit('{"results": [{"score": '), F.col("event_id") % 100, F.lit('}, {"similarity": 0.4}], "attributes": [{"code": "st", "value": "'), F.when(F.col("event_type") == "view", "Active").otherwise("Inactive"),
        F.lit('"}], "documents": [{"uploaded": "2020-01-01"}], "predictions": ['), F.when(F.col("event_id") % 3 == 0, F.lit('{"probability": 0.25}')).otherwise(""), F.lit('], "bindings": ['), F.when(F.col("event_id") % 2 == 0, F.lit('{"x": "1"}, {"x": "2"}')).otherwise(""), F.lit("]}"),
    )
    return e.select(F.concat(F.lit("s"), F.col("event_id") % 2).alias("source_id"), F.col("event_id").cast("string").alias("query_hash"), raw.alias("raw"))


def texts(s, d):
    return I.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")


def in_context(s, d):
    """Documents next to those that hold their five keywords among ten."""
    best = materialise(sessions.keywords(texts(s, d), k=10), "x4-keywords")
    items = best.select(F.col("word").alias("source"), F.concat(F.lit("item "), "id").alias("target"), (F.col("score") / 100).alias("weight"))
    return sessions.context(best.filter(F.col("place") <= 5), items).select("id", "target", "weight", "place")


def turns(s, d):
    """Events as turns of users' sessions, with made-up physics."""
    e = I.table(s, d, "events").select("event_id", F.col("user_id").alias("session"), F.to_date("ts").cast("string").alias("day"), (F.col("value") / 97.13).alias("weight"), (F.col("event_id") % 6).alias("concepts"), (F.col("event_id") % 3 / 2).alias("tau"), (F.col("event_id") % 5 / 4 - 0.5).alias("delta_r"), (F.col("event_id") % 11 / 10 - 0.5).alias("rho"), (50 + F.col("event_id") % 300).alias("length"))
    return sessions.turn_metrics(e)


def evidence(s, d):
    """Declared files: the table of nations by its right and by a wrong hash, by a path with detours, and others."""
    files = s.read.format("binaryFile").load(f"{d}/nation.parquet")
    right = files.select(F.sha2("content", 256).alias("right"))
    key = F.col("n_nationkey")
    where = F.when(key == 0, "nation.parquet").when(key == 1, "https://x/y").when(key == 2, "../nation.parquet").when(key == 3, "nation.parquet").when(key == 4, "./x/../nation.parquet").when(key == 5, "x/nation.parquet").otherwise(F.concat("n_name", F.lit(".txt")))
    declared = I.table(s, d, "nation").crossJoin(right).select(where.alias("location"), F.when(key.isin(0, 4), F.col("right")).otherwise("0").alias("sha256"))
    return landing.verify_evidence(declared, files, d)


def stream_of(s, d, name: str):
    """The table as a stream of its files."""
    schema = I.table(s, d, name).schema
    rows = s.readStream.schema(schema).parquet(f"{d}/{name}.parquet*")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


def votes_with_time(lines):
    """Line items as votes at the time they were shipped; the place of a vote in its run is all that tells it apart."""
    place = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    return I.as_votes(lines).select("model", "subject", "relation", "object", "confidence", "ord", "run_id", F.col("l_shipdate").cast("timestamp").alias("ts"), place.alias("pos"))


def landed_events(s, d):
    """Events as JSON lines in a folder, every fifth cut off, read back."""
    line, path = F.to_json(F.struct("event_id", "event_type", "props")), f"{shared_dir(s)}/s5-{uuid.uuid4().hex}"
    cut = F.expr("substring(value, 1, length(value) - 3)")
    rows = I.table(s, d, "events").select("event_id", line.alias("value")).select(F.when(F.col("event_id") % 5 == 0, cut).otherwise(F.col("value")).alias("value"), F.coalesce(F.col("event_id") % 5 == 0, F.lit(False)).alias("is_cut"))
    # by folders, as a first task without rows would else leave a file without any, which nothing was landed in
    rows.write.partitionBy("is_cut").text(path)
    return folders.read_landed(s, path)


def stored_sessions(s, d):
    """Conversations exported in two goes, the second over some of the first, and imported again."""
    path = f"{shared_dir(s)}/s15-{uuid.uuid4().hex}"
    sessions.export_sessions(talk(s, d).withColumn("text", F.when(F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 0, "an earlier state").otherwise(F.col("text"))), path)
    return sessions.import_sessions(sessions.export_sessions(talk(s, d).filter(F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 0), path))


def forgotten(s, d):
    table = VersionedTable.scratch(by_user(s, d).select("event_id", "session"), ["session"], "x10")
    sessions.forget_stored(table, by_user(s, d), CUTOFF, key="session")
    return table.read()


def followed(s, d):
    """The store of customers' and suppliers' edges after the events as a stream of changes, with curvature taken again."""
    store = streams.follow_deltas(I.start_edges(s, d), I.in_order(I.as_deltas(stream_of(s, d, "events"))))
    return store


def refreshed(s, d):
    store = followed(s, d)
    store.refresh()
    return store.curvature(weightless=float("-inf"))  # as 2 / 0 is in the SQL


def as_predictions(rows):
    return rows.filter("event_type = 'view'").select(F.col("user_id").alias("claim"), F.concat(F.lit("m"), F.col("event_id") % 3).alias("model"), (F.col("value") / 500).alias("p"), F.col("ts").alias("created_at"))


def as_outcomes(rows):
    return rows.filter("event_type = 'purchase'").select(F.col("user_id").alias("claim"), (F.col("value") > 100).cast("int").alias("outcome"), F.col("ts").alias("resolved_at"))


WORDS = "w AS (SELECT doc_id AS id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-zà-öø-ÿ]{4,}') AS ws FROM documents))"
KEYWORDS = f"""{WORDS}, k AS (SELECT id, word, count(*) * length(word) AS score, min(pos) AS f FROM w WHERE word NOT IN ({', '.join(f"'{x}'" for x in sessions.STOP_WORDS)}) GROUP BY 1, 2),
    kw AS (SELECT id, word, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, f) AS place FROM k)"""

SESSIONS = """o AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM o), ses AS (SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 2 HOUR AS ended, count(*) AS n FROM g GROUP BY user_id, k)"""
RATES = """rates AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS began, event_type, count(*) AS n, round(count(*) / 50, 4) AS ratio,
    CASE WHEN count(*) / 50 > 2 THEN 'escalation' WHEN count(*) / 50 < 0.5 THEN 'de-escalation' ELSE 'stable' END AS status FROM events GROUP BY 1, 2)"""
#: Sessions without an event since then are inactive.
CUTOFF = "2024-01-30 00:00:00"
#: What a stream has closed when its watermark, a day behind the last event, has passed the end.
CLOSED = "<= (SELECT max(ts) - INTERVAL 1 DAY FROM events)"

METRICS = """t AS (SELECT event_id, user_id AS session, ts::DATE::VARCHAR AS day, value / 97.13 AS w, event_id % 6 AS n, event_id % 3 / 2 AS tau, event_id % 5 / 4 - 0.5 AS dr, event_id % 11 / 10 - 0.5 AS rho, 50 + event_id % 300 AS len FROM events),
    x AS (SELECT *, CASE WHEN rho > 0 THEN 200 + 100 * rho WHEN rho < 0 THEN 150 + 50 * rho ELSE 150 END AS ex FROM t),
    y AS (SELECT *, CASE WHEN n > 0 THEN least(1, greatest(0, w / n / 0.8)) ELSE 0 END AS c, least(1, greatest(0, 0.3 * abs(dr) + 0.7 * tau / (tau + 1))) AS p, least(1, greatest(0, 1 - abs(len - ex) / ex)) AS f FROM x),
    z AS (SELECT *, least(1, greatest(0, 0.4 * (1 - c) + 0.6 * p)) AS te FROM y),
    metrics AS (SELECT event_id, session, day, round(c, 9) AS coherence, round(p, 9) AS pressure, round(f, 9) AS fit, round(te, 9) AS tension, round(least(1, greatest(0, 0.5 * (c + f) - 0.5 * te)), 9) AS stability FROM z)"""
SUMMARY = """count(*) AS turns, round(avg(coherence), 12) AS avg_coherence, round(avg(pressure), 12) AS avg_pressure, round(avg(fit), 12) AS avg_fit, round(avg(tension), 12) AS avg_tension, round(avg(stability), 12) AS avg_stability,
    round(quantile_cont(tension, 0.5), 12) AS median_tension, round(count(*) FILTER (tension > 0.7) / count(*), 12) AS share_tense, round(count(*) FILTER (fit < 0.3) / count(*), 12) AS share_unfit FROM metrics"""

FOLLOWED = f"""WITH {I.DELTAS}, {I.START}, {I.VALID}, ks AS (SELECT source, target FROM start UNION SELECT source, target FROM v WHERE operation LIKE '%edge'),
    ev AS (SELECT source, target, id, operation, weight FROM v WHERE operation LIKE '%edge' UNION ALL SELECT ks.source, ks.target, id, operation, NULL FROM ks JOIN v ON operation = 'delete_node' AND (v.source = ks.source OR v.source = ks.target)),
    z AS (SELECT source, target, max(id) FILTER (operation = 'add_edge') AS a, max(id) FILTER (operation LIKE 'delete%') AS e, arg_max(weight, id) FILTER (operation IN ('add_edge', 'update_edge')) AS w FROM ev GROUP BY 1, 2),
    after AS (SELECT * FROM (SELECT ks.source, ks.target, CASE WHEN e IS NULL THEN CASE WHEN start.weight IS NOT NULL OR a IS NOT NULL THEN coalesce(w, start.weight) END WHEN a > e THEN w END AS weight FROM ks LEFT JOIN z USING (source, target) LEFT JOIN start USING (source, target)) WHERE weight IS NOT NULL)
    {{select}}"""

SO_FAR = "(sum(n) OVER (PARTITION BY user_id ORDER BY ended))::BIGINT"
#: Nodes whose edges valid changes make dirty: their ends, and the neighbours of nodes that go.
DIRTY = """dirty AS (SELECT source AS node FROM v UNION SELECT target FROM v WHERE operation LIKE '%edge' UNION SELECT start.target FROM start JOIN v ON v.source = start.source AND operation = 'delete_node'
    UNION SELECT start.source FROM start JOIN v ON v.source = start.target AND operation = 'delete_node')"""
T4_WIDTH, T4_LEAST = "1200 days", 0.3
RUNS = f"""{I.MODELS}, once AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, l_shipdate FROM lineitem),
    cast_ AS (SELECT time_bucket(INTERVAL 1200 DAY, l_shipdate::TIMESTAMP, TIMESTAMP '1970-01-01') AS began, l_orderkey % 2 AS run_id, 'm' || (l_suppkey % 5) AS model, 'part ' || l_partkey AS subject, l_returnflag AS relation, l_linestatus AS object,
        l_quantity / 50.0 AS confidence, {I.ORDINAL} AS ord, substr(sha256(lower('part ' || l_partkey) || '|' || lower(l_returnflag) || '|' || lower(l_linestatus)), 1, 16) AS claim_key FROM once WHERE l_quantity / 50.0 >= 0.3),
    grouped AS (SELECT began, run_id, claim_key, any_value(subject) AS subject, any_value(relation) AS relation, any_value(object) AS object, count(*) AS n_votes, min(ord) AS ord, avg(confidence) AS a, coalesce(stddev_samp(confidence), 0) AS s,
        list_sort(list(DISTINCT model)) AS ms, count(*) / (SELECT count(*) FROM models) AS agr FROM cast_ GROUP BY 1, 2, 3),
    claims AS (SELECT began, run_id, claim_key, subject, relation, object, n_votes, round(agr, 4) AS agreement, round(a, 4) AS avg_confidence, round(s, 4) AS std_confidence, round(0.6 * agr + 0.4 * a, 4) AS score,
        len(ms) AS n_models, array_to_string(ms, ',') AS models, ord FROM grouped WHERE agr >= 0.3)"""
T4_CLOSED = "began + INTERVAL 1200 DAY <= (SELECT max(l_shipdate)::TIMESTAMP - INTERVAL 1 DAY FROM lineitem)"

QUERIES = {
    "s1_concept_list": (
        lambda s, d: landing.concept_list(I.table(s, d, "part").select(F.concat(F.lit("  "), F.upper("p_type"), F.lit("  ("), F.col("p_brand"), F.lit(")")).alias("value"))),
        r"SELECT DISTINCT trim(regexp_replace(regexp_replace(lower(p_type || '  (' || p_brand || ')'), '[^\p{L}\p{N} _''-]', '', 'g'), ' +', ' ', 'g')) AS concept FROM part",
    ),
    "s2_parse_triples": (
        lambda s, d: landing.parse_triples(responses(s, d)),
        """WITH r AS (SELECT o_orderkey AS id, o_orderstatus AS st, CASE o_orderkey % 4 WHEN 0 THEN [0, 1] WHEN 1 THEN [0, 1] WHEN 2 THEN [0] END AS ps FROM orders), u AS (SELECT id, st, unnest(ps) AS pos FROM r WHERE ps IS NOT NULL)
            SELECT id, pos, 'order ' || id AS subject, 'r' || pos AS relation, st AS object, '0.5' AS confidence, false AS rejected FROM u UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, true FROM r WHERE ps IS NULL""",
    ),
    "s3_parse_verdicts": (
        lambda s, d: landing.parse_verdicts(verdict_texts(s, d)).select("id", "verdict", "claim_type", "confidence"),
        """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN o_orderstatus = 'F' THEN 'SUPPORTED' WHEN o_orderstatus = 'O' THEN 'CONTESTED' ELSE 'INSUFFICIENT_EVIDENCE' END AS verdict,
            CASE WHEN o_orderkey % 5 = 0 THEN 'empirical' ELSE 'predictive' END AS claim_type, CASE WHEN o_orderkey % 5 = 0 THEN 0.0::DOUBLE ELSE 0.75 END AS confidence FROM orders""",
    ),
    "s4_verdict_triples": (
        lambda s, d: landing.verdict_triples(landing.parse_verdicts(verdict_texts(s, d)), F.concat(F.lit("claim "), "id")),
        """WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN o_orderstatus = 'F' THEN 'SUPPORTED' WHEN o_orderstatus = 'O' THEN 'CONTESTED' ELSE 'INSUFFICIENT_EVIDENCE' END AS v, CASE WHEN o_orderkey % 5 = 0 THEN 0.0::DOUBLE ELSE 0.75 END AS confidence FROM orders)
            SELECT id, 0 AS pos, 'claim ' || id AS subject, 'verdict' AS relation, v AS object, confidence FROM o UNION ALL SELECT id, 1, 'a', 'evidence', 'b', confidence FROM o WHERE id % 5 <> 0 UNION ALL SELECT id, 2, 'claim ' || id, 'reasoning', 'because', confidence FROM o WHERE id % 5 <> 0""",
    ),
    "s5_explode_cycles": (
        lambda s, d: landing.explode_cycles(talk(s, d).select(F.col("conv_id").alias("run_id"), F.col("turn").alias("cycle"), F.to_json(F.create_map(F.lit("m1"), F.col("role"), F.lit("m2"), F.upper("role"))).alias("responses"))),
        "SELECT conv_id AS run_id, turn AS cycle, 'm1' AS model, role AS text FROM conversations UNION ALL SELECT conv_id, turn, 'm2', upper(role) FROM conversations",
    ),
    "s5_landed_folder": (
        lambda s, d: folders.landing_report(landed_events(s, d)).select("state", "n"),
        "SELECT CASE WHEN event_id % 5 = 0 THEN 'broken' ELSE 'good' END AS state, count(*) AS n FROM events GROUP BY 1",
    ),
    "s6_conflict_events": (
        lambda s, d: landing.conflict_events(I.table(s, d, "events").select(F.col("user_id").alias("region"), "event_type", F.when(F.col("event_id") % 7 == 0, "unknown").otherwise((F.col("event_id") % 5).cast("string")).alias("fatalities")), ["region"]),
        """WITH e AS (SELECT user_id AS region, event_type, CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 5 END AS f FROM events), t AS (SELECT region, event_type || '=' || count(*) AS p FROM e GROUP BY region, event_type)
            SELECT region, count(*) AS event_count, sum(f)::BIGINT AS fatalities, (SELECT string_agg(p, ',' ORDER BY p) FROM t WHERE t.region = e.region) AS by_type, round(count(*) / 500, 4) AS ratio, round(least(1, count(*) / 500), 4) AS score,
            CASE WHEN count(*) / 500 > 2 THEN 'escalation' WHEN count(*) / 500 < 0.5 THEN 'de-escalation' ELSE 'stable' END AS status FROM e GROUP BY region""",
    ),
    "s7_conflict_forecast": (
        lambda s, d: landing.conflict_forecast(snapshots(s, d)),
        "SELECT 's' || (event_id % 2) AS source_id, event_id::VARCHAR AS query_hash, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS periods, CASE WHEN event_id % 3 = 0 THEN 0.25 END AS score, CASE WHEN event_id % 3 = 0 THEN 'forecast' ELSE 'no_data' END AS status FROM events",
    ),
    "s8_screening": (
        lambda s, d: landing.screening(snapshots(s, d), {"s0": 100.0}),
        """WITH e AS (SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN greatest(event_id % 100, 0.4) / 100 ELSE greatest(event_id % 100, 0.4) END, 4) AS score FROM events)
            SELECT 's' || (event_id % 2) AS source_id, event_id::VARCHAR AS query_hash, score, CASE WHEN score >= 0.85 THEN 'match' ELSE 'clear' END AS status FROM e""",
    ),
    "s9_registry": (
        lambda s, d: landing.registry(snapshots(s, d), "st"),
        "SELECT 's' || (event_id % 2) AS source_id, event_id::VARCHAR AS query_hash, CASE WHEN event_type = 'view' THEN 'active' ELSE 'inactive' END AS status, CASE WHEN event_type = 'view' THEN 1.0::DOUBLE ELSE 0.5 END AS score, '2020-01-01' AS version FROM events",
    ),
    "s10_bindings": (
        lambda s, d: landing.bindings(snapshots(s, d)),
        "SELECT 's' || (event_id % 2) AS source_id, event_id::VARCHAR AS query_hash, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS n, CASE WHEN event_id % 2 = 0 THEN 0.7::DOUBLE ELSE 0 END AS score, CASE WHEN event_id % 2 = 0 THEN 'found' ELSE 'none' END AS status FROM events",
    ),
    "a14_deterministic": (
        lambda s, d: landing.deterministic(landing.bindings(snapshots(s, d)), F.concat(F.lit("claim "), "query_hash")).select("subject", "object", "score", "anchor_hash"),
        """WITH e AS (SELECT event_id, 's' || (event_id % 2) AS s, CASE WHEN event_id % 2 = 0 THEN 'found' ELSE 'none' END AS o FROM events)
            SELECT 'claim ' || event_id AS subject, o AS object, CASE o WHEN 'found' THEN 0.7::DOUBLE ELSE 0 END AS score, sha256('{"object":"' || o || '","query_hash":"' || event_id || '","source_id":"' || s || '"}') AS anchor_hash FROM e""",
    ),
    "s13_verify_evidence": (
        lambda s, d: landing.evidence_totals(evidence(s, d)),
        """WITH e AS (SELECT CASE n_nationkey WHEN 0 THEN 'verified' WHEN 1 THEN 'declared' WHEN 2 THEN 'outside' WHEN 3 THEN 'different' WHEN 4 THEN 'verified' ELSE 'missing' END AS state FROM nation) SELECT state, count(*) AS n FROM e GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM e""",
    ),
    "s14_proposals": (
        lambda s, d: landing.verify_proposals(landing.proposals(I.table(s, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("frame")).agg(F.collect_list(F.struct(F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("location"), F.lit("0").alias("sha256"), F.lit("d").alias("description"))).alias("evidence")).withColumn("frame_hash", F.when(F.col("frame") != "P", F.sha2("frame", 256)).otherwise("")))).select("id", "frame", "hash", "complete", "intact"),
        """WITH g AS (SELECT o_custkey AS id, o_orderstatus AS frame, CASE WHEN o_orderstatus <> 'P' THEN sha256(o_orderstatus) ELSE '' END AS fh, string_agg('{"kind":"order","location":"' || o_orderkey || '","sha256":"0","description":"d"}', ',' ORDER BY o_orderkey::VARCHAR) AS e FROM orders GROUP BY 1, 2, 3)
            SELECT id, frame, sha256('{"decision":"proposed","evidence":[' || e || '],"frame":"' || frame || '","frame_hash":"' || fh || '","id":' || id || '}') AS hash, frame <> 'P' AS complete, true AS intact FROM g""",
    ),
    "s15_bundles": (
        lambda s, d: sessions.unbundle(sessions.bundles(talk(s, d), trajectories=talk(s, d).select("conv_id", F.col("turn").alias("at"), F.length("text").alias("size")))),
        "SELECT conv_id, turn, role, text FROM conversations",
    ),
    "s15_listing": (
        lambda s, d: sessions.listing(sessions.bundles(talk(s, d)), talk(s, d).groupBy("conv_id").agg(F.concat(F.lit("m"), F.max("turn")).alias("model"), F.sum(F.length("text")).alias("at")), k=5),
        """WITH b AS (SELECT conv_id, 'm' || max(turn) AS model, sum(length(text)) AS made, count(*) AS n FROM conversations GROUP BY 1), r AS (SELECT model, conv_id, n, row_number() OVER (PARTITION BY model ORDER BY made DESC, conv_id) AS place FROM b) SELECT * FROM r WHERE place <= 5""",
    ),
    "s15_stored_sessions": (stored_sessions, "SELECT conv_id, turn, role, text FROM conversations"),
    "x10_forget_stored": (
        forgotten,
        f"SELECT event_id, user_id AS session FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '{CUTOFF}')",
    ),
    "x1_messages": (
        lambda s, d: sessions.messages(talk(s, d), roles=["user"], k=2).select("conv_id", "turn", "place"),
        "SELECT * FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'user') WHERE place <= 2",
    ),
    "x2_trim": (
        lambda s, d: sessions.trim(talk(s, d), last=6, budget=150, pinned="user"),
        """WITH a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AND role = 'user' AS pin FROM conversations), b AS (SELECT *, CASE WHEN pin THEN 0 ELSE row_number() OVER (PARTITION BY conv_id, pin ORDER BY turn DESC) END AS back FROM a),
            c AS (SELECT conv_id, turn, role, back, sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id, pin ORDER BY turn DESC) AS chars FROM b WHERE back <= 6) SELECT conv_id, turn, role, back, chars::BIGINT AS chars FROM c WHERE chars // 4 <= 150 OR back <= 1""",
    ),
    "x3_keywords": (
        lambda s, d: sessions.keywords(texts(s, d)),
        f"WITH {KEYWORDS} SELECT id, place, word, score FROM kw WHERE place <= 5",
    ),
    "x4_context": (
        in_context,
        f"""WITH {KEYWORDS}, e AS (SELECT word, 'item ' || id AS target, score / 100 AS weight FROM kw WHERE place <= 10 AND score / 100 >= 0.1), n AS (SELECT kw.id, target, round(sum(weight), 4) AS weight FROM kw JOIN e USING (word) WHERE place <= 5 GROUP BY 1, 2)
            SELECT * FROM (SELECT id, target, weight, row_number() OVER (PARTITION BY id ORDER BY weight DESC, target) AS place FROM n) WHERE place <= 5""",
    ),
    "x5_recall": (
        lambda s, d: sessions.recall(memory(s, d), asked(s, d), last=400, least=0.1),
        """WITH q AS (SELECT label AS session, arg_min(embedding, vec_id) AS query, max(vec_id) AS now FROM embeddings GROUP BY 1), b AS (SELECT label AS session, vec_id AS turn, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS back FROM embeddings),
            j AS (SELECT b.session, turn, round(greatest(0, least(1, list_cosine_similarity(embedding::DOUBLE[], query::DOUBLE[]))) * greatest(0.5, 1 - 0.01 * (now - turn)), 4) AS score FROM b JOIN q USING (session) WHERE back <= 400)
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, turn DESC) AS place FROM j WHERE score >= 0.1) WHERE place <= 3""",
    ),
    "x6_memory_stats": (lambda s, d: sessions.memory_stats(talk(s, d)), "SELECT conv_id, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY 1"),
    "x7_turn_metrics": (lambda s, d: turns(s, d).select("event_id", "coherence", "pressure", "fit", "tension", "stability"), f"WITH {METRICS} SELECT event_id, coherence, pressure, fit, tension, stability FROM metrics"),
    "x7_session_metrics": (lambda s, d: sessions.metric_summary(turns(s, d), ["session"]), f"WITH {METRICS} SELECT session, {SUMMARY} GROUP BY 1"),
    "x7_daily_metrics": (lambda s, d: sessions.metric_summary(turns(s, d), ["day"]), f"WITH {METRICS} SELECT day, {SUMMARY} GROUP BY 1"),
    "x10_inactive": (
        lambda s, d: sessions.inactive(by_user(s, d), CUTOFF),
        f"SELECT user_id AS session, max(ts) AS last_at, count(*) AS events FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '{CUTOFF}'",
    ),
    "x10_retain": (
        lambda s, d: sessions.retain(by_user(s, d), CUTOFF).select("event_id", "session"),
        f"SELECT event_id, user_id AS session FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '{CUTOFF}')",
    ),
    "x10_forget_session": (
        lambda s, d: sessions.forget_session(I.deltas(s, d).withColumn("session", F.col("source")), by_user(s, d), CUTOFF).select("id", "session"),
        f"SELECT event_id AS id, CASE WHEN max(ts) OVER (PARTITION BY user_id) >= TIMESTAMP '{CUTOFF}' THEN user_id END AS session FROM events",
    ),
    "t1_session_activity": (lambda s, d: streams.session_activity(I.table(s, d, "events")), f"WITH {SESSIONS} SELECT * FROM ses"),
    "t1_session_activity_stream": (lambda s, d: streams.drain(streams.session_activity(stream_of(s, d, "events")), "t1"), f"WITH {SESSIONS} SELECT * FROM ses WHERE ended {CLOSED}"),
    "t1_inactivity": (lambda s, d: streams.inactivity(I.table(s, d, "events")), f"WITH {SESSIONS} SELECT user_id, ended - INTERVAL 2 HOUR AS last_at, {SO_FAR} AS events FROM ses"),
    "t1_inactivity_stream": (
        lambda s, d: streams.drain(streams.inactivity(stream_of(s, d, "events")), "t1"),
        f"WITH {SESSIONS} SELECT user_id, ended - INTERVAL 2 HOUR AS last_at, {SO_FAR} AS events FROM ses WHERE ended {CLOSED}",
    ),
    "t2_signed_degrees": (
        lambda s, d: streams.signed_degrees(I.deltas(s, d)),
        f"""WITH {I.DELTAS}, x AS (SELECT CASE operation WHEN 'add_edge' THEN 1 WHEN 'delete_edge' THEN -1 END AS g, source, target FROM deltas), y AS (SELECT source AS node, g FROM x UNION ALL SELECT target, g FROM x WHERE source <> target)
            SELECT node, sum(g)::BIGINT AS degree, count(*) AS changes FROM y WHERE g IS NOT NULL GROUP BY 1""",
    ),
    "t2_follow_deltas_stream": (lambda s, d: followed(s, d).edges().select("source", "target", F.round("weight", 4).alias("weight")), FOLLOWED.format(select="SELECT source, target, round(weight, 4) AS weight FROM after")),
    "t2_dirty_queue_stream": (lambda s, d: followed(s, d).dirty(), FOLLOWED.format(select=f", {DIRTY} SELECT source, target FROM after WHERE source IN (FROM dirty) OR target IN (FROM dirty)")),
    "t2_curvature_stream": (refreshed, FOLLOWED.format(select=f", edges AS (FROM after), {CURVED} SELECT * FROM curved")),
    "t3_event_rates": (
        lambda s, d: streams.event_rates(I.table(s, d, "events")),
        f"WITH {RATES} SELECT * FROM rates",
    ),
    "t3_event_rates_stream": (lambda s, d: streams.drain(streams.event_rates(stream_of(s, d, "events")), "t3"), f"WITH {RATES} SELECT * FROM rates WHERE began + INTERVAL 1 DAY {CLOSED}"),
    "t4_windowed_consensus": (
        lambda s, d: streams.windowed_consensus(votes_with_time(I.table(s, d, "lineitem")), I.models(s), width=T4_WIDTH, least_agreement=T4_LEAST),
        f"WITH {RUNS} SELECT * FROM claims",
    ),
    "t4_windowed_consensus_stream": (
        lambda s, d: streams.drain(streams.windowed_consensus(votes_with_time(stream_of(s, d, "lineitem")), I.models(s), width=T4_WIDTH, least_agreement=T4_LEAST), "t4"),
        f"WITH {RUNS} SELECT * FROM claims WHERE {T4_CLOSED}",
    ),
    "t4_weighted_consensus_stream": (
        lambda s, d: streams.drain(streams.windowed_consensus(votes_with_time(stream_of(s, d, "lineitem")), I.models(s), weighted=True, width=T4_WIDTH, least_agreement=T4_LEAST), "t4"),
        f"""WITH {RUNS}, l AS (SELECT began, run_id, claim_key, model, confidence, weight FROM (SELECT *, row_number() OVER (PARTITION BY began, run_id, claim_key, model ORDER BY ord DESC, confidence DESC) AS r FROM cast_) JOIN models USING (model) WHERE r = 1),
            g AS (SELECT began, run_id, claim_key, count(*) AS n_models, sum(weight) AS w, sum(weight * confidence) / sum(weight) AS a FROM l GROUP BY ALL), t AS (SELECT *, w / (SELECT sum(weight) FROM models) AS agr FROM g)
            SELECT began, run_id, claim_key, n_models, round(agr, 6) AS agreement, round(a, 6) AS avg_confidence, round(0.6 * agr + 0.4 * a, 6) AS score FROM t WHERE agr >= 0.3 AND {T4_CLOSED}""",
    ),
    "t5_rolling_calibration": (
        lambda s, d: streams.rolling_calibration(as_predictions(I.table(s, d, "events")), as_outcomes(I.table(s, d, "events"))).select("began", "model", "n", "avg_brier"),
        """WITH p AS (SELECT user_id AS claim, 'm' || (event_id % 3) AS model, value / 500 AS p, ts AS created_at FROM events WHERE event_type = 'view'),
            o AS (SELECT user_id AS claim, (value > 100)::INT AS outcome, ts AS resolved_at FROM events WHERE event_type = 'purchase')
            SELECT time_bucket(INTERVAL 10 DAY, created_at, TIMESTAMP '1970-01-01') - to_days((10 * k)::INT) AS began, model, count(*) AS n, round(avg(pow(p - outcome, 2)), 4) AS avg_brier
            FROM p JOIN o USING (claim), range(3) t(k) WHERE resolved_at BETWEEN created_at AND created_at + INTERVAL 90 DAY GROUP BY 1, 2""",
    ),
    "t5_rolling_calibration_stream": (
        lambda s, d: streams.drain(streams.rolling_calibration(as_predictions(stream_of(s, d, "events")), as_outcomes(stream_of(s, d, "events")), width="5 days", slide="5 days", patience="2 days"), "t5").select("began", "model", "n", "avg_brier"),
        None,
    ),
}
