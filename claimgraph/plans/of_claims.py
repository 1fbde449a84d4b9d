"""Queries of claims: cleaning, consensus, tiers, calibration and provenance over line items read as votes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimgraph.functions.storage import shared_dir
from claimgraph.operators import calibrate, similarity, text, votes
from claimgraph.plans import inputs as I
from claimgraph.plans.inputs import MODELS, PREDICTIONS, VOTES

SYNONYMS = {"promo": "offer", "anodized tin": "tinware"}
RELATIONS = {"a": "accepted", "r": "returned", "n": "none"}
FAMILIES = {"m": "mill"}

KEYED = f"""{VOTES}, {MODELS}, keyed AS (SELECT *, substr(sha256(lower(subject) || '|' || lower(relation) || '|' || lower(object)), 1, 16) AS claim_key FROM votes WHERE confidence >= 0.3)"""
CONSENSUS = f"""{KEYED}, g AS (SELECT claim_key, any_value(subject) AS subject, any_value(relation) AS relation, any_value(object) AS object, count(*) AS n_votes, min(ord) AS ord,
    avg(confidence) AS a, coalesce(stddev_samp(confidence), 0) AS s, list_sort(list(DISTINCT model)) AS ms FROM keyed GROUP BY claim_key),
    every AS (SELECT *, n_votes / (SELECT count(*) FROM models) AS agr FROM g),
    consensus AS (SELECT claim_key, subject, relation, object, n_votes, round(agr, 4) AS agreement, round(a, 4) AS avg_confidence, round(s, 4) AS std_confidence,
    round(0.6 * agr + 0.4 * a, 4) AS score, len(ms) AS n_models, array_to_string(ms, ',') AS models, ord FROM every WHERE agr >= 0.5)"""
TIER = """CASE WHEN score >= 0.85 AND n_models >= 3 AND families >= 2 AND {anchored} THEN 'verified' WHEN score >= 0.7 AND n_models >= 3 AND families >= 2 THEN 'validated'
    WHEN score >= 0.4 AND n_models >= 2 THEN 'proposition' ELSE 'sandbox' END"""
ATTESTED = f"""{CONSENSUS}, att AS (SELECT sha256(lower(subject) || '|' || lower(relation) || '|' || lower(object) || '|') AS claim_hash, subject, relation AS predicate, object, score,
    n_votes AS models_consulted, n_models, n_models AS agreeing, 1 AS families FROM consensus WHERE score >= 0.4)"""


def consensus(s, d, **options):
    return votes.exact_consensus(I.votes(s, d), I.models(s), **options)


def attested(s, d):
    return votes.crystallise(consensus(s, d), families=FAMILIES)


def verdicts(s, d):
    """Line items as verdicts on orders: the flag is the verdict."""
    rows = I.table(s, d, "lineitem")
    return rows.select(F.col("l_orderkey").alias("claim"), F.concat(F.lit("m"), F.col("l_suppkey") % 5).alias("model"), F.col("l_returnflag").alias("verdict"), (F.col("l_quantity") / 50.0).alias("confidence"), F.struct(*I.ORDER).alias("ord"))


VERDICTS = f"""verdicts AS (SELECT l_orderkey AS claim, 'm' || (l_suppkey % 5) AS model, l_returnflag AS verdict, l_quantity / 50.0 AS confidence,
    row_number() OVER (ORDER BY {', '.join(I.ORDER)}) AS ord FROM lineitem)"""


def run_attestations(s, d, run):
    rows = I.votes(s, d).filter(F.col("run_id") == run)
    return votes.crystallise(votes.exact_consensus(rows, I.models(s)), families=FAMILIES).select("claim_hash", "tier", "score")


def _run_sql(run: int) -> str:
    return f"""run{run} AS (WITH g AS (SELECT subject, relation, object, count(*) / 6 AS agr, avg(confidence) AS a, count(DISTINCT model) AS n_models, 1 AS families FROM votes
        WHERE confidence >= 0.3 AND run_id = {run} GROUP BY ALL), c AS (SELECT *, round(0.6 * agr + 0.4 * a, 4) AS score FROM g WHERE agr >= 0.5)
        SELECT sha256(lower(subject) || '|' || lower(relation) || '|' || lower(object) || '|') AS claim_hash, score, {TIER.format(anchored='false')} AS tier FROM c WHERE score >= 0.4)"""


def resolved(s, d):
    return calibrate.resolve(I.predictions(s, d))


RESOLVED = f"{PREDICTIONS}, resolved AS (SELECT *, round(pow(CASE WHEN agreed THEN confidence ELSE 1 - confidence END - outcome, 2), 6) AS brier FROM predictions WHERE outcome IS NOT NULL)"


def order_history(s, d):
    """Orders as attestations of customers in time: the price is the score, the status the tier."""
    rows = I.table(s, d, "orders")
    tier = F.when(F.col("o_totalprice") > 300000, "verified").when(F.col("o_totalprice") > 200000, "validated").when(F.col("o_totalprice") > 100000, "proposition").otherwise("sandbox")
    return rows.select(F.col("o_custkey").alias("question"), F.col("o_orderkey").alias("claim_hash"), tier.alias("tier"), F.round(F.col("o_totalprice") / 500000, 4).alias("score"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("frame"))


HISTORY = """hist AS (SELECT o_custkey AS question, o_orderkey AS claim_hash, CASE WHEN o_totalprice > 300000 THEN 'verified' WHEN o_totalprice > 200000 THEN 'validated' WHEN o_totalprice > 100000 THEN 'proposition' ELSE 'sandbox' END AS tier,
    round(o_totalprice / 500000, 4) AS score, o_orderdate AS made, o_orderpriority AS frame FROM orders)"""


def claims(s, d):
    """Orders as scored claims by priority (difficulty) and status (ambiguity)."""
    rows = I.table(s, d, "orders")
    return rows.select(F.col("o_orderkey").alias("claim"), F.col("o_orderpriority").alias("difficulty"), F.col("o_orderstatus").alias("ambiguity"), F.round(F.col("o_totalprice") / 500000, 2).alias("score"), F.when(F.col("o_totalprice") > 250000, "supported").otherwise("contested").alias("verdict"), F.col("o_orderpriority").startswith("3").alias("dissent"), F.when(F.col("o_totalprice") < 20000, "timeout").alias("error"))


CLAIMS = "claims AS (SELECT o_orderkey AS claim, o_orderpriority AS difficulty, o_orderstatus AS ambiguity, round(o_totalprice / 500000, 2) AS score, CASE WHEN o_totalprice > 250000 THEN 'supported' ELSE 'contested' END AS verdict, o_orderpriority LIKE '3%' AS dissent, CASE WHEN o_totalprice < 20000 THEN 'timeout' END AS error FROM orders)"


def events_raw(s, d):
    e = I.table(s, d, "events")
    return e.select(F.concat(F.lit("u"), F.col("user_id")).alias("source_id"), F.sha2(F.col("event_type"), 256).alias("query_hash"), F.to_date("ts").cast("string").alias("source_version"), F.col("props").alias("raw_response"), F.col("ts").alias("fetched_at"))


SNAPSHOTS = "snaps AS (SELECT 'u' || user_id AS source_id, sha256(event_type) AS query_hash, CAST(ts AS DATE)::VARCHAR AS source_version, props AS raw_response, ts AS fetched_at FROM events)"


def entity_names(s, d):
    names = I.table(s, d, "customer").select(F.concat(F.lower("c_mktsegment"), F.lit(" "), F.col("c_nationkey")).alias("name"))
    return names.unionByName(I.table(s, d, "nation").select(F.lower("n_name").alias("name"))).unionByName(I.table(s, d, "region").select(F.col("r_name").alias("name")))


def resolve_names(s, d):
    nation, region = I.table(s, d, "nation"), I.table(s, d, "region")
    aliases = nation.select(F.lower("n_name").alias("alias"), F.col("n_name").alias("concept"))
    concepts = region.select(F.col("r_name").alias("concept"))
    similar = I.table(s, d, "customer").groupBy(F.concat(F.lower("c_mktsegment"), F.lit(" "), F.col("c_nationkey")).alias("name")).agg(F.round(F.avg(F.abs("c_acctbal")) / 10000 + 0.45, 2).alias("similarity")).withColumn("concept", F.col("name"))
    return similarity.resolve_entities(entity_names(s, d), aliases, concepts, similar)


def named(s, d):
    return I.vectors(s, d).withColumn("name", F.concat(F.lit("v "), "id"))


def migrated(s, d, model):
    return I.vectors(s, d).select("id", "embedding", F.lit(model).alias("model_id"))


def flawed_votes(s, d):
    """Orders as votes with every flaw that C7 looks for."""
    return I.table(s, d, "orders").select("o_orderkey", *(F.expr(e).alias(c) for c, e in FLAWED.items()))


#: The same expressions in both engines.
FLAWED = {
    "subject": """CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'It' WHEN 3 THEN '12-34' WHEN 4 THEN concat('order [', o_orderkey, ']') WHEN 5 THEN concat('"order ', o_orderkey, '"')
        WHEN 6 THEN repeat('x', 101) WHEN 7 THEN concat('  order', chr(9), o_orderkey, ' ') WHEN 8 THEN o_orderstatus ELSE concat('order ', o_orderkey) END""",
    "relation": "CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE 'of' END",
    "object": "CASE o_custkey % 5 WHEN 0 THEN concat('customer ', o_custkey) WHEN 1 THEN concat('Order ', o_orderkey) WHEN 2 THEN 'the' WHEN 3 THEN '<b>' ELSE o_orderpriority END",
    "confidence": "CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'sure' WHEN 2 THEN '1.5' WHEN 3 THEN '-0.25' WHEN 4 THEN '0.25' ELSE '0.875' END",
}


def _flaws_sql() -> str:
    clean = lambda c: f"""regexp_replace(trim(regexp_replace({c}, '[\\x00-\\x1F\\x7F]', ' ', 'g')), '^["'']+|["'']+$', '', 'g')"""
    stop = ", ".join(f"'{t}'" for t in text.STOP_TERMS)
    wrong = lambda c: f"""CASE WHEN {c} IS NULL OR {c} = '' THEN '{c} is missing' END, CASE WHEN length({c}) < 2 OR length({c}) > 100 THEN '{c} has a bad length' END, CASE WHEN lower({c}) IN ({stop}) THEN '{c} has no content' END,
        CASE WHEN regexp_matches({c}, '^[\\W\\d_]+$') THEN '{c} has no letters' END, CASE WHEN regexp_matches({c}, '[\\[\\]{{}}<>]') THEN '{c} has brackets' END"""  # noqa: E731
    raw = ", ".join(f"{e} AS {c}" for c, e in FLAWED.items())
    return f"""WITH raw AS (SELECT o_orderkey, {raw} FROM orders), c AS (SELECT o_orderkey, {", ".join(f"{clean(c)} AS {c}" for c in ("subject", "relation", "object"))}, confidence AS given,
            least(1, greatest(0, CASE WHEN confidence IS NULL THEN 0.7 ELSE coalesce(TRY_CAST(confidence AS DOUBLE), 0.5) END))::DOUBLE AS confidence FROM raw),
        e AS (SELECT *, concat_ws('; ', {wrong("subject")}, {wrong("object")}, CASE WHEN relation IS NULL OR relation = '' THEN 'relation is missing' END, CASE WHEN lower(subject) = lower(object) THEN 'subject is object' END,
            CASE WHEN confidence < 0.3 THEN 'confidence is low' END) AS errors, concat_ws('; ', CASE WHEN given IS NULL THEN 'confidence was missing' END, CASE WHEN TRY_CAST(given AS DOUBLE) <> confidence THEN 'confidence was cut' END) AS warnings FROM c)
        SELECT o_orderkey, subject, relation, object, confidence, errors = '' AS valid, errors, warnings FROM e"""


def by_vector(s, d):
    """Names of every fiftieth vector resolved by the nearest other one, and how near that is."""
    every = named(s, d)
    near = similarity.closest_concepts(every.filter("id % 50 = 0"), every.select(F.col("name").alias("concept"), "embedding"), least=0.2, itself=False)
    aliases, concepts = I.table(s, d, "region").select(F.col("r_name").alias("alias"), F.col("r_name").alias("concept")), I.table(s, d, "nation").select(F.col("n_name").alias("concept"))
    return similarity.resolve_entities(every.filter("id % 50 = 0").select("name"), aliases, concepts, near, accept=0.3, review=0.25, create=True), near


NEAREST = """e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
    p AS (SELECT q.id, x.id AS c, round(list_dot_product(q.v, x.v), 4) AS s FROM e q JOIN e x ON x.id <> q.id WHERE q.id % 50 = 0), b AS (SELECT id, c, s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, 'v ' || c) AS r FROM p) WHERE r = 1)"""


def stored_snapshots(s, d):
    """Snapshots that land in two goes in a stored table."""
    raw, path = events_raw(s, d), f"{shared_dir(s)}/s12-{uuid.uuid4().hex}"
    middle = F.pmod(F.xxhash64("raw_response"), F.lit(2)) == 0
    calibrate.land_snapshots(raw.filter(middle), path)
    return calibrate.land_snapshots(raw.filter(~middle), path).read()


QUERIES = {
    "c1_normalise_text": (
        lambda s, d: I.table(s, d, "part").select("p_partkey", text.normalise(F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t x "))).alias("text")),
        r"SELECT p_partkey, trim(regexp_replace(lower('  ' || upper(p_name) || chr(9) || ' x '), '\s+', ' ', 'g')) AS text FROM part",
    ),
    "c2_normalise_entity": (
        lambda s, d: I.table(s, d, "part").select("p_partkey", text.normalise_entity(F.col("p_type"), SYNONYMS).alias("entity")),
        "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: CASE w WHEN 'promo' THEN 'offer' ELSE w END), ' ') AS entity FROM part",
    ),
    "c3_normalise_relation": (
        lambda s, d: I.table(s, d, "orders").select("o_orderkey", text.normalise_relation(F.col("o_orderpriority"), {"1-urgent": "urgent", "not_specified": "none"}).alias("by_hash"), text.normalise_relation(F.col("o_orderpriority"), {"1_urgent": "urgent"}, hyphens=True).alias("by_group")),
        """SELECT o_orderkey, CASE lower(o_orderpriority) WHEN '1-urgent' THEN 'urgent' ELSE lower(o_orderpriority) END AS by_hash,
            CASE regexp_replace(lower(o_orderpriority), '[- ]', '_', 'g') WHEN '1_urgent' THEN 'urgent' ELSE regexp_replace(lower(o_orderpriority), '[- ]', '_', 'g') END AS by_group FROM orders""",
    ),
    "c5_canonical_relations": (
        lambda s, d: text.canonical_relations(
            I.table(s, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("relation")),
            I.table(s, d, "orders").filter("o_orderpriority like '1%' or o_orderpriority like '2%'").select(F.lower("o_orderpriority").alias("canonical")).distinct().withColumns({"aliases": F.array(F.upper("canonical"), F.regexp_replace("canonical", "-", " ")), "inverse": F.concat(F.lit("not "), "canonical"), "symmetric": F.lit(False), "category": F.lit("priority")}),
        ).select("o_orderkey", "canonical", "inverse", "category"),
        """SELECT o_orderkey, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN lower(o_orderpriority) ELSE 'related_to' END AS canonical,
            CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'not ' || lower(o_orderpriority) END AS inverse, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'priority' END AS category FROM orders""",
    ),
    "c7_validate_votes": (
        lambda s, d: text.validate_votes(I.votes(s, d).drop("ord", "run_id")).groupBy("valid", F.array_join("errors", ";").alias("errors")).agg(F.count(F.lit(1)).alias("n")),
        f"""WITH {VOTES}, v AS (SELECT concat_ws(';', CASE WHEN length(object) < 2 THEN 'object has a bad length' END, CASE WHEN lower(object) IN ('a', 'it') THEN 'object has no content' END,
            CASE WHEN confidence < 0.3 THEN 'confidence is low' END) AS errors FROM votes) SELECT errors = '' AS valid, errors, count(*) AS n FROM v GROUP BY ALL""",
    ),
    "c7_validate_flawed": (
        lambda s, d: text.validate_votes(flawed_votes(s, d)).select("o_orderkey", "subject", "relation", "object", "confidence", "valid", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings")),
        _flaws_sql(),
    ),
    "c8_validation_counters": (
        lambda s, d: text.validation_counters(text.validate_votes(I.votes(s, d).withColumn("object", F.concat(F.lit("state "), "object")))),
        f"WITH {VOTES} SELECT count(*) AS processed, count(*) FILTER (confidence >= 0.3) AS valid, count(*) FILTER (confidence < 0.3) AS invalid, 0 AS corrected FROM votes",
    ),
    "c9_claim_hash": (
        lambda s, d: I.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.claim_hash(F.concat(F.lit("Part "), "l_partkey"), F.col("l_returnflag"), F.col("l_linestatus")).alias("hash")),
        "SELECT l_orderkey, l_linenumber, l_partkey, sha256('part ' || l_partkey || '|' || lower(l_returnflag) || '|' || lower(l_linestatus) || '|') AS hash FROM lineitem",
    ),
    "c11_json_hash": (
        lambda s, d: I.table(s, d, "nation").select("n_nationkey", text.canonical_json(["n_regionkey", "n_name"]).alias("json"), text.json_hash(["n_regionkey", "n_name"]).alias("hash")),
        """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json, sha256('{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') AS hash FROM nation""",
    ),
    "c12_family": (
        lambda s, d: I.table(s, d, "supplier").select("s_suppkey", text.family(F.concat(F.lit("host::"), F.lower("s_name")), {"supplier#": "maker", "supplier": "maker"}).alias("family")),
        "SELECT s_suppkey, CASE regexp_extract(lower(s_name), '^([^:\\-_./\\d]*)', 1) WHEN 'supplier#' THEN 'maker' WHEN 'supplier' THEN 'maker' ELSE 'unknown' END AS family FROM supplier",
    ),
    "c13_classify": (
        lambda s, d: I.table(s, d, "conversations").select("conv_id", "turn", text.classify(F.col("text"), ["^what", "^how"], ["^is", "^are", "true"]).alias("kind")),
        "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '^what|^how') THEN 'explore' WHEN regexp_matches(lower(text), '^is|^are|true') THEN 'verify' ELSE 'explore' END AS kind FROM conversations",
    ),
    "c14_seed_terms": (
        lambda s, d: I.table(s, d, "benchmark").select("item_id", F.array_join(text.seed_terms(F.col("text"), ["the", "of", "and"]), " ").alias("terms")),
        """WITH w AS (SELECT item_id, t.pos, t.word FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM benchmark), LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word) t
            WHERE length(word) >= 2 AND word NOT IN ('the', 'of', 'and')), f AS (SELECT item_id, word, min(pos) AS pos FROM w GROUP BY ALL)
            SELECT item_id, coalesce(string_agg(word, ' ' ORDER BY pos), '') AS terms FROM benchmark LEFT JOIN f USING (item_id) GROUP BY item_id""",
    ),
    "c15_tier": (
        lambda s, d: consensus(s, d).withColumn("families", F.col("n_models") - 1).select("claim_key", text.tier(F.col("score"), F.col("n_models"), F.col("families"), F.col("relation") == "A", F.lit(0)).alias("tier")),
        f"WITH {CONSENSUS}, c AS (SELECT *, n_models - 1 AS families FROM consensus) SELECT claim_key, {TIER.format(anchored="relation = 'A'")} AS tier FROM c",
    ),
    "c16_decidability": (
        lambda s, d: consensus(s, d).select("claim_key", text.decidability(F.col("score") + 0.00001, F.col("relation"), F.col("object"), {"A": 1.0, "R": 0.8}, {"F": 0.5}).alias("adjusted")),
        f"WITH {CONSENSUS} SELECT claim_key, round((score + 0.00001::DOUBLE) * CASE relation WHEN 'A' THEN 1.0::DOUBLE WHEN 'R' THEN 0.8 ELSE 0.65 END * CASE object WHEN 'F' THEN 0.5::DOUBLE ELSE 1.0 END, 4) AS adjusted FROM consensus",
    ),
    "a1_exact_consensus": (lambda s, d: consensus(s, d), f"WITH {CONSENSUS} SELECT * FROM consensus"),
    "a1_exact_consensus_distinct": (
        lambda s, d: consensus(s, d, distinct_models=True).select("claim_key", "agreement", "n_models"),
        f"WITH {KEYED} SELECT claim_key, round(count(DISTINCT model) / 6, 4) AS agreement, count(DISTINCT model) AS n_models FROM keyed GROUP BY 1 HAVING count(DISTINCT model) / 6 >= 0.5",
    ),
    "a2_weighted_consensus": (
        lambda s, d: votes.weighted_consensus(I.votes(s, d), I.models(s)),
        f"""WITH {KEYED}, l AS (SELECT claim_key, model, confidence, weight FROM (SELECT *, row_number() OVER (PARTITION BY claim_key, model ORDER BY ord DESC) AS r FROM keyed) JOIN models USING (model) WHERE r = 1),
            g AS (SELECT claim_key, count(*) AS n_models, sum(weight) AS w, sum(weight * confidence) / sum(weight) AS a FROM l GROUP BY 1), t AS (SELECT *, w / (SELECT sum(weight) FROM models) AS agr FROM g)
            SELECT claim_key, n_models, round(agr, 6) AS agreement, round(a, 6) AS avg_confidence, round(0.6 * agr + 0.4 * a, 6) AS score FROM t WHERE agr >= 0.5""",
    ),
    "a3_vote_entropy": (
        lambda s, d: votes.vote_entropy(I.votes(s, d), I.models(s)),
        f"""WITH {KEYED}, c AS (SELECT count(DISTINCT claim_key) AS claims, count(DISTINCT (claim_key, model)) AS filled FROM keyed), p AS (SELECT *, filled / (claims * 6) AS p FROM c)
            SELECT claims, filled, round(-(p * log2(p) + (1 - p) * log2(1 - p)), 6) AS vote_entropy FROM p""",
    ),
    "a6_controversial": (lambda s, d: votes.controversial(consensus(s, d)).select("claim_key", "std_confidence"), f"WITH {CONSENSUS} SELECT claim_key, std_confidence FROM consensus WHERE std_confidence >= 0.15"),
    "a6_high_agreement": (lambda s, d: votes.high_agreement(consensus(s, d)).select("claim_key", "agreement"), f"WITH {CONSENSUS} SELECT claim_key, agreement FROM consensus WHERE agreement >= 0.9"),
    "a7_verdict_vote": (
        lambda s, d: votes.verdict_vote(verdicts(s, d)),
        f"""WITH {VERDICTS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim, model ORDER BY ord) AS r FROM verdicts) WHERE r = 1),
            g AS (SELECT claim, verdict, sum(confidence) AS s, min(ord) AS o, count(*) AS agreeing FROM f GROUP BY 1, 2),
            b AS (SELECT *, sum(s) OVER (PARTITION BY claim) AS total, sum(agreeing) OVER (PARTITION BY claim) AS voters, row_number() OVER (PARTITION BY claim ORDER BY s DESC, o) AS r FROM g)
            SELECT claim, verdict, CASE WHEN total > 0 THEN round(round(s / total, 10), 4) ELSE 1 END AS share, agreeing, voters FROM b WHERE r = 1""",
    ),
    "a7_verdict_votes": (
        lambda s, d: votes.verdict_votes(verdicts(s, d), decided=I.table(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("claim")), anchored=I.table(s, d, "orders").filter("o_totalprice > 100000").select(F.col("o_orderkey").alias("claim"))),
        f"""WITH {VERDICTS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim, model ORDER BY ord) AS r FROM verdicts) JOIN orders ON o_orderkey = claim WHERE r = 1 AND o_orderstatus <> 'F' AND o_totalprice > 100000),
            g AS (SELECT claim, verdict, sum(confidence) AS s, min(ord) AS o FROM f GROUP BY 1, 2), b AS (SELECT claim, verdict AS won FROM (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY s DESC, o) AS r FROM g) WHERE r = 1)
            SELECT claim, model, verdict, confidence, verdict = won AS agreed FROM f JOIN b USING (claim)""",
    ),
    "a8_vote_signature": (
        lambda s, d: votes.vote_signature(consensus(s, d), F.lit(1)),
        f"WITH {CONSENSUS} SELECT claim_key, agreement, round(1 - std_confidence, 4) AS steadiness, 0.5::DOUBLE AS centrality, 0.5::DOUBLE AS stability, round(1 / n_votes, 4) AS diversity FROM consensus",
    ),
    "a9_crystallise": (lambda s, d: attested(s, d), f"WITH {ATTESTED} SELECT *, {TIER.format(anchored='false')} AS tier FROM att"),
    "a9_crystallise_verdicts": (
        lambda s, d: votes.crystallise(
            consensus(s, d).withColumns({"claim_type": F.col("object"), "object": F.col("relation"), "relation": F.lit("verdict"), "method": F.when(F.col("object") == "F", "deterministic").otherwise("voted"), "anchor": F.when(F.col("n_votes") > 4, F.col("claim_key"))}),
            families=FAMILIES, verdict_penalties={"A": 1.0, "R": 0.8, "N": 0.6667}, type_penalties={"O": 0.7713},
        ).select("claim_hash", "object", "score", "agreeing", "tier"),
        f"""WITH {CONSENSUS}, h AS (SELECT *, sha256(lower(subject) || '|verdict|' || lower(relation) || '|') AS claim_hash FROM consensus), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_hash ORDER BY ord) AS r FROM h) WHERE r = 1),
            k AS (SELECT claim_hash, relation AS object, n_models, n_models AS agreeing, 1 AS families, round(score * CASE relation WHEN 'A' THEN 1.0::DOUBLE WHEN 'R' THEN 0.8 ELSE 0.6667 END * CASE object WHEN 'O' THEN 0.7713::DOUBLE ELSE 1.0 END, 4) AS score
            FROM d WHERE score >= 0.4 AND (object <> 'F' OR n_votes > 4)) SELECT claim_hash, object, score, agreeing, {TIER.format(anchored='false')} AS tier FROM k""",
    ),
    "a10_verify_summary": (
        lambda s, d: votes.verify_summary(verdicts(s, d).withColumn("score", F.col("confidence") * F.when(F.col("verdict") == "N", 0.5).otherwise(1.0))),
        f"""WITH {VERDICTS}, v AS (SELECT *, confidence * CASE verdict WHEN 'N' THEN 0.5::DOUBLE ELSE 1.0 END AS score FROM verdicts),
            b AS (SELECT claim, verdict FROM (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY score DESC, ord DESC) AS r FROM v) WHERE r = 1)
            SELECT claim, any_value(b.verdict) AS verdict, round(max(score), 4) AS score, array_to_string(list_sort(list(DISTINCT model || '=' || v.verdict)), ',') AS by_model FROM v JOIN b USING (claim) GROUP BY claim""",
    ),
    "a11_below_threshold": (
        lambda s, d: votes.below_threshold(consensus(s, d, least_agreement=0.0).withColumn("ord", F.col("claim_key")), of=["relation"]).select("relation", "claim_key", "total", "place"),
        f"""WITH {CONSENSUS}, l AS (SELECT relation, claim_key, count(*) OVER (PARTITION BY relation) AS total, row_number() OVER (PARTITION BY relation ORDER BY claim_key) AS place FROM every WHERE round(agr, 4) < 0.5)
            SELECT * FROM l WHERE place <= 20""",
    ),
    "a12_diversity_bonus": (
        lambda s, d: votes.diversity_bonus(attested(s, d).withColumn("families", F.col("n_models") - 3)).select("claim_hash", "adjusted"),
        f"WITH {ATTESTED} SELECT claim_hash, round(least(1.0, score * CASE WHEN n_models - 3 >= 2 THEN 1.1::DOUBLE ELSE 1.0 END), 4) AS adjusted FROM att",
    ),
    "a15_worst_severity": (
        lambda s, d: votes.worst_severity(I.table(s, d, "orders").select(F.col("o_custkey").alias("contract"), F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("severity")), ["2-HIGH", "3-MEDIUM", "5-LOW", "informational"], fold={"1-URGENT": "2-HIGH"}),
        """SELECT o_custkey AS contract, CASE min(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 3 ELSE 4 END) WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '5-LOW' ELSE 'informational' END AS severity,
            count(*) AS findings FROM orders GROUP BY 1""",
    ),
    "a15_unit_order": (
        lambda s, d: votes.unit_order(I.table(s, d, "orders").select(F.col("o_custkey").alias("contract"), F.col("o_orderkey").alias("unit"), (F.col("o_orderstatus") == "P").cast("int").alias("external_calls"), (F.col("o_orderstatus") == "O").cast("int").alias("state_writes"))),
        "SELECT o_custkey AS contract, o_orderkey AS unit, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS place FROM orders",
    ),
    "b1_record_predictions": (
        lambda s, d: calibrate.record_predictions(I.votes(s, d).groupBy(text.claim_hash(F.col("subject"), F.col("relation"), F.col("object")).alias("claim_hash"), "run_id").agg(F.collect_list(F.struct(F.col("model").alias("model_id"))).alias("votes"))),
        f"WITH {VOTES} SELECT DISTINCT sha256(lower(subject) || '|' || lower(relation) || '|' || lower(object) || '|') AS claim_hash, run_id, model AS model_id FROM votes",
    ),
    "b2_resolve": (lambda s, d: resolved(s, d).select("claim", "model", "brier"), f"WITH {RESOLVED} SELECT claim, model, brier FROM resolved"),
    "b3_brier": (
        lambda s, d: calibrate.brier(resolved(s, d), "2024-05-01 00:00:00"),
        f"""WITH {RESOLVED} SELECT model, count(*) AS n, round(avg(brier), 4) AS avg_brier, min(brier) AS least, max(brier) AS most, round(greatest(0, 1 - avg(brier)), 4) AS weight FROM resolved
            WHERE created_at BETWEEN TIMESTAMP '2024-05-01' - INTERVAL 90 DAY AND TIMESTAMP '2024-05-01' GROUP BY 1""",
    ),
    "b3_rolling_brier": (
        lambda s, d: calibrate.rolling_brier(resolved(s, d), days=7),
        f"""WITH {RESOLVED}, y AS (SELECT model, CAST(created_at AS DATE) AS day, sum(brier) AS s, count(*) AS n FROM resolved GROUP BY 1, 2)
            SELECT model, day::VARCHAR AS day, round(sum(s) OVER w / sum(n) OVER w, 8) AS avg_brier, sum(n) OVER w AS n FROM y WINDOW w AS (PARTITION BY model ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)""",
    ),
    "b4_model_weights": (
        lambda s, d: calibrate.model_weights(I.models(s), calibrate.brier(resolved(s, d), "2024-05-01 00:00:00")),
        f"""WITH {RESOLVED}, {MODELS}, b AS (SELECT model, round(greatest(0, 1 - avg(brier)), 4) AS weight FROM resolved
            WHERE created_at BETWEEN TIMESTAMP '2024-05-01' - INTERVAL 90 DAY AND TIMESTAMP '2024-05-01' GROUP BY 1) SELECT model, coalesce(b.weight, 1) AS weight FROM models LEFT JOIN b USING (model)""",
    ),
    "b5_tier_transitions": (
        lambda s, d: calibrate.tier_transitions(order_history(s, d).select(F.col("question").alias("claim_hash"), "tier", F.struct("at", F.col("claim_hash").alias("o")).alias("at"))).select("claim_hash", "old_tier", "new_tier", F.col("at.o").alias("by_order")),
        f"""WITH {HISTORY}, l AS (SELECT question AS claim_hash, coalesce(lag(tier) OVER (PARTITION BY question ORDER BY made, claim_hash), 'sandbox') AS old_tier, tier AS new_tier, claim_hash AS by_order FROM hist)
            SELECT * FROM l WHERE old_tier <> new_tier""",
    ),
    "b6_newest_attestations": (
        lambda s, d: calibrate.history(order_history(s, d), "question").select("question", "claim_hash", "place"),
        f"WITH {HISTORY}, r AS (SELECT question, claim_hash, row_number() OVER (PARTITION BY question ORDER BY made DESC, claim_hash) AS place FROM hist) SELECT * FROM r WHERE place <= 3",
    ),
    "b6_best_attestations": (
        lambda s, d: calibrate.history(order_history(s, d), "frame", order="best", k=10).select("frame", "claim_hash", "place"),
        f"WITH {HISTORY}, r AS (SELECT frame, claim_hash, row_number() OVER (PARTITION BY frame ORDER BY score DESC, made DESC, claim_hash) AS place FROM hist) SELECT * FROM r WHERE place <= 10",
    ),
    "b6_oldest_attestations": (
        lambda s, d: calibrate.history(order_history(s, d), "question", order="oldest").select("question", "claim_hash", "place"),
        f"WITH {HISTORY}, r AS (SELECT question, claim_hash, row_number() OVER (PARTITION BY question ORDER BY made, claim_hash) AS place FROM hist) SELECT * FROM r WHERE place <= 3",
    ),
    "b7_compare_runs": (
        lambda s, d: calibrate.compare_runs(run_attestations(s, d, 0), run_attestations(s, d, 1)),
        f"""WITH {VOTES}, {_run_sql(0)}, {_run_sql(1)}, j AS (SELECT claim_hash, a.tier AS tier_before, b.tier AS tier_after, b.score - a.score AS x FROM run0 a FULL JOIN run1 b USING (claim_hash)),
            k AS (SELECT *, list_position(['sandbox', 'proposition', 'validated', 'verified'], tier_after) - list_position(['sandbox', 'proposition', 'validated', 'verified'], tier_before) AS up FROM j)
            SELECT claim_hash, tier_before, tier_after, round(x, 4) AS delta, CASE WHEN tier_before IS NULL THEN 'new' WHEN tier_after IS NULL THEN 'lost' WHEN up > 0 THEN 'improved' WHEN up < 0 THEN 'degraded' ELSE 'stable' END AS status FROM k""",
    ),
    "b8_pair_sensitivity": (
        lambda s, d: calibrate.pair_sensitivity(claims(s, d), claims(s, d).select("claim", (F.col("claim") + 1).alias("pair_with"))),
        f"WITH {CLAIMS} SELECT a.claim, b.claim AS pair_with, round(abs(a.score - b.score), 4) AS difference, round(abs(a.score - b.score), 4) >= 0.15 AS nuance FROM claims a JOIN claims b ON b.claim = a.claim + 1",
    ),
    "b9_uplift": (
        lambda s, d: calibrate.uplift(claims(s, d), claims(s, d).withColumn("score", F.round(F.col("score") * F.col("score"), 4))),
        f"WITH {CLAIMS} SELECT claim, round(score - round(score * score, 4), 4) AS uplift FROM claims",
    ),
    "b10_scorecard": (
        lambda s, d: calibrate.scorecard(claims(s, d)),
        f"""WITH {CLAIMS}, c AS (SELECT coalesce(difficulty, 'all') AS difficulty, coalesce(ambiguity, 'all') AS ambiguity, count(*) AS n, count(*) FILTER (error IS NULL) AS completed, count(error) AS errored, count(*) FILTER (error IS NULL AND verdict = 'supported') AS supported,
            count(*) FILTER (error IS NULL AND verdict = 'contested') AS contested, count(*) FILTER (error IS NULL AND dissent) AS split, round(avg(score) FILTER (error IS NULL), 4) AS avg_score FROM claims GROUP BY CUBE (difficulty, ambiguity))
            SELECT *, CASE WHEN completed > 0 THEN round(supported / completed, 4) END AS pass_rate FROM c""",
    ),
    "b11_run_stats": (
        lambda s, d: calibrate.run_stats(I.table(s, d, "events"), "user_id"),
        "SELECT user_id, round((epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts)))) / 60, 2) AS minutes, count(DISTINCT event_type) AS kinds, count(*) AS n FROM events GROUP BY 1",
    ),
    "b12_pending_triples": (
        lambda s, d: calibrate.pending(I.votes(s, d).withColumns({"injected": F.when(F.col("relation") != "A", F.col("relation") == "N"), "skip_reason": F.when((F.col("object") == "F") & (F.col("confidence") > 0.9), "exists")})).select("model", "subject", "relation", "object", "confidence", "ord"),
        f"WITH {VOTES} SELECT model, subject, relation, object, confidence, ord FROM votes WHERE confidence >= 0.5 AND relation <> 'N' AND NOT (object = 'F' AND confidence > 0.9)",
    ),
    "b14_aliases": (
        lambda s, d: calibrate.aliases_of(I.table(s, d, "part").select(F.col("p_brand").alias("concept"), F.col("p_type").alias("alias"))),
        "SELECT p_brand AS concept, count(*) AS n, array_to_string(list_sort(list(DISTINCT p_type)), ', ') AS aliases FROM part GROUP BY 1",
    ),
    "j1_resolve_entities": (
        resolve_names,
        """WITH names AS (SELECT DISTINCT lower(c_mktsegment) || ' ' || c_nationkey AS name FROM customer UNION SELECT lower(n_name) FROM nation UNION SELECT r_name FROM region),
            sim AS (SELECT lower(c_mktsegment) || ' ' || c_nationkey AS name, round(avg(abs(c_acctbal)) / 10000 + 0.45, 2) AS s FROM customer GROUP BY 1),
            j AS (SELECT name, n_name, r_name, s FROM names LEFT JOIN nation ON name = lower(n_name) LEFT JOIN region ON name = r_name LEFT JOIN sim USING (name))
            SELECT name, coalesce(n_name, r_name, CASE WHEN s >= 0.85 THEN name END) AS concept, CASE WHEN n_name IS NOT NULL THEN 'alias' WHEN r_name IS NOT NULL THEN 'exact' WHEN s >= 0.92 THEN 'embedding' WHEN s >= 0.85 THEN 'review' ELSE 'not_found' END AS method FROM j""",
    ),
    "j1_resolve_by_vector": (lambda s, d: by_vector(s, d)[0], f"WITH {NEAREST} SELECT 'v ' || id AS name, CASE WHEN s >= 0.25 THEN 'v ' || c ELSE 'v ' || id END AS concept, CASE WHEN s >= 0.3 THEN 'embedding' WHEN s >= 0.25 THEN 'review' ELSE 'new' END AS method FROM b"),
    "j1_new_aliases": (lambda s, d: similarity.new_aliases(*by_vector(s, d)), f"WITH {NEAREST} SELECT 'v ' || id AS alias, 'v ' || c AS concept, s AS similarity, 'embedding' AS method FROM b WHERE s >= 0.3"),
    "j12_anchors": (
        lambda s, d: calibrate.anchors(I.table(s, d, "events").select(F.col("user_id").alias("question"), F.when(F.col("event_type") == "purchase", "deterministic").otherwise("voted").alias("kind"), F.concat(F.lit('{"source": {"id": "s'), F.col("event_id") % 7, F.lit('"}}')).alias("consensus_meta"), "event_id"), I.table(s, d, "events").filter("value > 300").select(F.col("user_id").alias("question"))).select("event_id", "source_id", "version"),
        "SELECT event_id, 's' || (event_id % 7) AS source_id, '' AS version FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT user_id FROM events WHERE value > 300)",
    ),
    "j13_cache_lookup": (
        lambda s, d: calibrate.cached(order_history(s, d), I.table(s, d, "customer").select(F.col("c_custkey").alias("question")), "1998-01-01 00:00:00", hours=24 * 365).select("question", "claim_hash", "tier"),
        f"""WITH {HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY made DESC, claim_hash) AS place FROM hist WHERE question IN (SELECT c_custkey FROM customer) AND made > TIMESTAMP '1998-01-01' - INTERVAL 8760 HOUR AND made <= TIMESTAMP '1998-01-01'
            AND score >= 0.4 AND tier <> 'sandbox') SELECT question, claim_hash, tier FROM r WHERE place = 1""",
    ),
    "j13_cache_as_of": (
        lambda s, d: calibrate.cached_as_of(order_history(s, d), I.table(s, d, "orders").select(F.col("o_custkey").alias("question"), (F.col("o_orderdate") - F.expr("interval 1 hour")).alias("as_of")), hours=24 * 365).select("question", "as_of", "claim_hash", "tier"),
        f"""WITH {HISTORY}, q AS (SELECT row_number() OVER () AS nr, o_custkey AS question, o_orderdate - INTERVAL 1 HOUR AS as_of FROM orders),
            j AS (SELECT q.nr, claim_hash, tier, row_number() OVER (PARTITION BY q.nr ORDER BY made DESC, claim_hash) AS place FROM q JOIN hist h ON h.question = q.question AND made <= as_of AND made > as_of - INTERVAL 8760 HOUR AND score >= 0.4 AND tier <> 'sandbox')
            SELECT question, as_of, claim_hash, tier FROM q LEFT JOIN (SELECT * FROM j WHERE place = 1) USING (nr)""",
    ),
    "j14_stale_as_of": (
        lambda s, d: calibrate.stale_as_of(events_raw(s, d).select("source_id", "query_hash", F.col("fetched_at").alias("as_of")).withColumns({"ttl_hours": F.lit(24), "as_of": F.col("as_of") - F.expr("interval 1 minute")}), events_raw(s, d)),
        f"""WITH {SNAPSHOTS}, w AS (SELECT row_number() OVER () AS nr, source_id, query_hash, fetched_at - INTERVAL 1 MINUTE AS as_of FROM snaps), n AS (SELECT w.nr, max(fetched_at) AS fetched_at FROM w JOIN snaps s ON s.source_id = w.source_id AND s.query_hash = w.query_hash AND s.fetched_at <= as_of GROUP BY 1)
            SELECT source_id, query_hash, as_of, fetched_at FROM w LEFT JOIN n USING (nr) WHERE fetched_at IS NULL OR epoch(date_trunc('second', as_of)) - epoch(date_trunc('second', fetched_at)) > 24 * 3600""",
    ),
    "j14_stale_snapshots": (
        lambda s, d: calibrate.stale(events_raw(s, d).select("source_id", "query_hash").distinct().withColumn("ttl_hours", F.lit(24)), events_raw(s, d), "2024-01-31 00:00:00").select("source_id", "query_hash"),
        f"WITH {SNAPSHOTS} SELECT source_id, query_hash FROM snaps GROUP BY 1, 2 HAVING epoch(TIMESTAMP '2024-01-31') - epoch(date_trunc('second', max(fetched_at))) > 24 * 3600",
    ),
    "j15_verify_commits": (
        lambda s, d: calibrate.verify_commits(I.table(s, d, "conversations").select(F.col("conv_id").alias("run_id"), F.col("role").alias("model"), F.col("turn").alias("phase"), F.col("text").alias("response")), I.table(s, d, "conversations").filter("role != 'system'").select(F.col("conv_id").alias("run_id"), F.col("role").alias("model"), F.col("turn").alias("phase"), F.when(F.col("turn") == 1, F.sha2("role", 256)).otherwise(F.sha2("text", 256)).alias("response_hash")).distinct()),
        """WITH c AS (SELECT DISTINCT conv_id, role, turn, CASE WHEN turn = 1 THEN sha256(role) ELSE sha256(text) END AS h FROM conversations WHERE role <> 'system')
            SELECT v.conv_id AS run_id, v.role AS model, v.turn AS phase, coalesce(sha256(v.text) = c.h, false) AS verified FROM conversations v LEFT JOIN c ON v.conv_id = c.conv_id AND v.role = c.role AND v.turn = c.turn""",
    ),
    "j16_embedding_backlog": (
        lambda s, d: calibrate.embedding_backlog(I.concepts(s, d), I.vectors(s, d).withColumn("model_id", F.when(F.col("label") < 5, "old").otherwise("new")), "new").select("id"),
        "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings WHERE label >= 5)",
    ),
    "j16_finalise_migration": (
        lambda s, d: calibrate.finalise_migration(migrated(s, d, "old"), migrated(s, d, "new").filter("id < 300"), 64).groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")),
        "SELECT CASE WHEN vec_id < 300 THEN 'new' ELSE 'old' END AS model_id, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings GROUP BY 1",
    ),
    "j16_failed_migration": (
        lambda s, d: calibrate.finalise_migration(migrated(s, d, "old"), migrated(s, d, "new").withColumn("embedding", F.when(F.col("id") != 7, F.col("embedding"))), 64).groupBy("model_id").agg(F.count(F.lit(1)).alias("n")),
        "SELECT 'old' AS model_id, count(*) AS n FROM embeddings",
    ),
    "j16_roll_back_migration": (
        lambda s, d: calibrate.roll_back_migration(migrated(s, d, "old").filter("id >= 300").unionByName(migrated(s, d, "new").filter("id < 300")), "new").select("id", "model_id"),
        "SELECT vec_id AS id, 'old' AS model_id FROM embeddings WHERE vec_id >= 300",
    ),
    "j17_latest_published": (
        lambda s, d: calibrate.latest_published(I.table(s, d, "customer").select(F.col("c_custkey").alias("question")), I.table(s, d, "orders").select(F.col("o_custkey").alias("question"), (F.col("o_orderstatus") == "F").alias("ok"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("signature"))),
        """WITH l AS (SELECT o_custkey AS question, o_orderkey AS signature, o_orderdate AS published_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus = 'F')
            SELECT c_custkey AS question, signature, published_at FROM customer LEFT JOIN l ON question = c_custkey AND r = 1""",
    ),
    "s12_store_snapshots": (
        lambda s, d: calibrate.store_snapshots(events_raw(s, d)),
        f"WITH {SNAPSHOTS}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id, query_hash, source_version ORDER BY fetched_at, raw_response) AS o FROM snaps) SELECT * EXCLUDE (o), sha256(raw_response) AS content_hash FROM r WHERE o = 1",
    ),
    "s12_stored_snapshots": (
        stored_snapshots,
        f"WITH {SNAPSHOTS}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id, query_hash, source_version ORDER BY fetched_at, raw_response) AS o FROM snaps) SELECT * EXCLUDE (o), sha256(raw_response) AS content_hash FROM r WHERE o = 1",
    ),
    "s17_publish_candidates": (
        lambda s, d: calibrate.publish_candidates(order_history(s, d), order_history(s, d).filter("score >= 0.8"), least_score=0.5, k=20).select("frame", "claim_hash", "place"),
        f"WITH {HISTORY}, r AS (SELECT frame, claim_hash, row_number() OVER (PARTITION BY frame ORDER BY score DESC, made DESC, claim_hash) AS place FROM hist WHERE score >= 0.5 AND score < 0.8) SELECT * FROM r WHERE place <= 20",
    ),
}
