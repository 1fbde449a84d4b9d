"""From landed text and JSON to tables, and back.

Every normaliser gives (source_id, query_hash, status, score) from landed snapshots, so that A14 is one select.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.operators.text import canonical_json, normalise

VERDICTS = ["SUPPORTED", "CONTESTED", "INSUFFICIENT_EVIDENCE"]
CLAIM_TYPES = ["empirical", "normative", "predictive", "definitional"]
TRIPLES = "array<struct<subject:string,relation:string,object:string,confidence:string>>"


def concept_list(lines: DataFrame) -> DataFrame:
    """S1 of (value): one concept a line; comments and numbers go, at most 100 characters cut at a space, each once."""
    text = F.regexp_replace(normalise(F.col("value")), r"[^\p{L}\p{N} _'-]", "")
    text = F.trim(F.regexp_replace(text, " +", " "))
    cut = F.when(F.length(text) > 100, F.regexp_extract(F.substring(text, 1, 100), r"^(.*)\s", 1)).otherwise(text)
    kept = lines.filter(~F.col("value").rlike(r"^\s*(#|\d+[.)])")).select(cut.alias("concept"))
    return kept.filter(F.length("concept") >= 2).distinct()


def parse_triples(responses: DataFrame) -> DataFrame:
    """S2 of (id, text): triples out of a fenced block, an array, lines or one object; a text with none is one reject."""
    body = F.regexp_replace("text", r"(?s)<think(?:ing)?>.*?</think(?:ing)?>", "")
    fenced = F.regexp_extract(body, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(body)
    array = F.from_json(F.regexp_extract(body, r"(?s)(\[.*\])", 1), TRIPLES)
    one = TRIPLES.removeprefix("array<").removesuffix(">")
    lines = F.filter(F.transform(F.split(body, r"\n"), lambda x: F.from_json(F.regexp_extract(x, r"(\{.*\})", 1), one)), lambda x: x["subject"].isNotNull() | x["object"].isNotNull())
    single = F.array(F.from_json(F.regexp_extract(body, r"(?s)(\{.*\})", 1), one))
    usable = lambda a: F.when((F.size(a) > 0) & F.exists(a, lambda x: x["subject"].isNotNull()), a)
    rows = responses.select("id", F.coalesce(usable(array), usable(lines), usable(single)).alias("t")).select("id", F.posexplode_outer("t").alias("pos", "t"))
    return rows.select("id", "pos", "t.*", F.col("t").isNull().alias("rejected"))


def parse_verdicts(responses: DataFrame) -> DataFrame:
    """S3, S4 of (id, text): verdict, claim type, confidence and the triples that they become."""
    schema = "verdict string, claim_type string, confidence double, reasoning string, evidence array<struct<subject:string,relation:string,object:string>>"
    rows = responses.select("id", F.from_json(F.regexp_extract("text", r"(?s)(\{.*\})", 1), schema).alias("j"))
    verdict = F.when(F.upper("j.verdict").isin(VERDICTS), F.upper("j.verdict")).otherwise(VERDICTS[-1])
    kind = F.when(F.lower("j.claim_type").isin(CLAIM_TYPES), F.lower("j.claim_type")).otherwise(CLAIM_TYPES[0])
    return rows.select("id", verdict.alias("verdict"), kind.alias("claim_type"), F.coalesce("j.confidence", F.lit(0.0)).alias("confidence"), F.col("j.reasoning").alias("reasoning"), F.col("j.evidence").alias("evidence"))


def verdict_triples(verdicts: DataFrame, claim: Column) -> DataFrame:
    """The verdict, each complete piece of evidence and the reasoning, as triples."""
    subject = F.substring(claim, 1, 64)
    t = lambda s, r, o: F.struct(s.alias("subject"), r.alias("relation"), o.alias("object"))
    complete = F.filter("evidence", lambda e: e["subject"].isNotNull() & e["object"].isNotNull())
    evidence = F.transform(complete, lambda e: t(e["subject"], F.coalesce(e["relation"], F.lit("evidence")), e["object"]))
    none = F.array().cast("array<struct<subject:string,relation:string,object:string>>")
    reasoning = F.when(F.col("reasoning").isNotNull(), F.array(t(subject, F.lit("reasoning"), F.substring("reasoning", 1, 500)))).otherwise(none)
    every = F.concat(F.array(t(subject, F.lit("verdict"), F.col("verdict"))), F.coalesce(evidence, none), reasoning)
    return verdicts.select("id", "confidence", F.posexplode(every).alias("pos", "t")).select("id", "pos", "t.*", "confidence")


def explode_cycles(cycles: DataFrame) -> DataFrame:
    """S5 of (run_id, cycle, responses JSON): a row for each model's text."""
    return cycles.select("run_id", "cycle", F.explode(F.from_json("responses", "map<string,string>")).alias("model", "text"))


def conflict_status(ratio: Column) -> Column:
    return F.when(ratio > 2, "escalation").when(ratio < 0.5, "de-escalation").otherwise("stable")


def conflict_events(events: DataFrame, by: list[str], *, baseline: float = 500.0) -> DataFrame:
    """S6 of (by, event_type, fatalities as text): counts, fatalities that are numbers, ratio to the baseline, score, status."""
    total = events.groupBy(*by).agg(F.count("event_type").alias("event_count"), F.coalesce(F.sum(F.expr("try_cast(fatalities as bigint)")), F.lit(0)).alias("fatalities"))
    types = events.groupBy(*by, "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "event_type", "n"))), ",").alias("by_type"))
    ratio = F.col("event_count") / baseline
    status = F.when(F.col("event_count") == 0, "no_data").otherwise(conflict_status(ratio))
    return total.join(types, by).select(*by, "event_count", "fatalities", "by_type", F.round(ratio, 4).alias("ratio"), F.round(F.least(F.lit(1.0), ratio), 4).alias("score"), status.alias("status"))


def conflict_forecast(snapshots: DataFrame) -> DataFrame:
    """S7 of (…, raw JSON with predictions[].probability)."""
    p = F.from_json(F.get_json_object("raw", "$.predictions"), "array<struct<probability:double>>")
    n = F.coalesce(F.size(p), F.lit(0))
    return snapshots.select("source_id", "query_hash", F.greatest(n, F.lit(0)).alias("periods"), F.when(n > 0, F.element_at(p, 1)["probability"]).alias("score"), F.when(n > 0, "forecast").otherwise("no_data").alias("status"))


def screening(snapshots: DataFrame, scales: dict[str, float], *, least: float = 0.85) -> DataFrame:
    """S8 of (source_id, query_hash, raw JSON with results[]): the best match over a source's scale, match or clear."""
    found = F.from_json(F.get_json_object("raw", "$.results"), "array<struct<score:double,similarity:double>>")
    scale = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in scales.items() for x in kv]), F.col("source_id")), F.lit(1.0))
    best = F.coalesce(F.array_max(F.transform(found, lambda x: F.coalesce(x["score"], x["similarity"], F.lit(0.9)))) / scale, F.lit(0.0))
    return snapshots.select("source_id", "query_hash", F.round(best, 4).alias("score"), F.when(best >= least, "match").otherwise("clear").alias("status"))


def registry(snapshots: DataFrame, code: str) -> DataFrame:
    """S9 of (…, raw JSON with attributes[] and documents[]): the status an attribute gives and the version's date."""
    attributes = F.from_json(F.get_json_object("raw", "$.attributes"), "array<struct<code:string,value:string>>")
    value = F.lower(F.try_element_at(F.filter(attributes, lambda x: x["code"] == code), F.lit(1))["value"])
    uploads = F.from_json(F.get_json_object("raw", "$.documents"), "array<struct<uploaded:string>>")
    version = F.coalesce(F.get_json_object("raw", "$.registered"), F.try_element_at(uploads, F.lit(1))["uploaded"])
    return snapshots.select("source_id", "query_hash", F.coalesce(value, F.lit("unknown")).alias("status"), F.when(value.isin("registered", "active"), 1.0).otherwise(0.5).alias("score"), version.alias("version"))


def bindings(snapshots: DataFrame, *, most: float = 0.85) -> DataFrame:
    """S10 of (…, raw JSON with bindings[]): found ones score at most 0.85."""
    n = F.coalesce(F.size(F.from_json(F.get_json_object("raw", "$.bindings"), "array<map<string,string>>")), F.lit(0))
    return snapshots.select("source_id", "query_hash", F.greatest(n, F.lit(0)).alias("n"), F.when(n > 0, F.least(F.lit(most), 0.5 + 0.1 * n)).otherwise(0.0).alias("score"), F.when(n > 0, "found").otherwise("none").alias("status"))


def deterministic(normalised: DataFrame, claim: Column) -> DataFrame:
    """Snapshots as attestations without votes: the object is the status, the signature neutral."""
    rows = normalised.select(claim.alias("subject"), F.lit("has_status").alias("predicate"), F.col("status").alias("object"), "score", "source_id", "query_hash")
    return rows.withColumn("kind", F.lit("deterministic")).withColumn("anchor_hash", F.sha2(canonical_json(["source_id", "query_hash", "object"]), 256))


def verify_evidence(declared: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """S13 of declared (location, sha256) and files as Spark's binaryFile reader gives them (path, content).

    A location is a path from root, with ``.`` and ``..`` taken out; one that leads out of it is outside. Evidence
    behind https is declared only. Files are told apart by their whole path, so equal names in two folders are two.
    """
    scheme = lambda c: F.regexp_replace(c, r"^[a-z]+:/+", "/")
    there = files.select(scheme(F.col("path")).alias("_path"), F.sha2("content", 256).alias("_hash"))
    steps = F.filter(F.split("location", "/"), lambda s: ~s.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("way"), F.lit(False).alias("out"))

    def walk(at: Column, step: Column) -> Column:
        up = step == ".."
        way = F.when(up, F.slice(at["way"], F.lit(1), F.greatest(F.lit(0), F.size(at["way"]) - 1))).otherwise(F.array_append(at["way"], step))
        return F.struct(way.alias("way"), (at["out"] | (up & (F.size(at["way"]) == 0))).alias("out"))

    rows = declared.withColumn("_at", F.aggregate(steps, start, walk)).withColumn("_path", F.concat(scheme(F.lit(root.rstrip("/"))), F.lit("/"), F.array_join("_at.way", "/")))
    outside = F.col("_at.out") | F.col("location").startswith("/")
    state = F.when(F.col("location").startswith("https://"), "declared").when(outside, "outside").when(F.col("_hash").isNull(), "missing").when(F.col("_hash") == F.col("sha256"), "verified").otherwise("different")
    return rows.join(there, "_path", "left").select("location", state.alias("state"))


def evidence_totals(verified: DataFrame) -> DataFrame:
    """How many pieces of evidence are in each state, and in all."""
    return verified.rollup("state").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("state", F.lit("all")).alias("state"), "n")


def proposals(items: DataFrame) -> DataFrame:
    """S14 of (id, frame, frame_hash, evidence array<struct<kind,location,sha256,description>>): canonical JSON and its hash.

    A framed proposal needs its frame's hash; one without is not complete.
    """
    rows = items.withColumn("evidence", F.array_sort("evidence")).withColumn("decision", F.lit("proposed"))
    rows = rows.withColumn("complete", F.col("frame").isNull() | F.coalesce(F.col("frame_hash") != "", F.lit(False)))
    return rows.withColumn("artifact", canonical_json(["id", "frame", "frame_hash", "evidence", "decision"])).withColumn("hash", F.sha2("artifact", 256))


def verify_proposals(built: DataFrame) -> DataFrame:
    """Whether each hash is that of its artifact."""
    return built.withColumn("intact", F.sha2("artifact", 256) == F.col("hash"))
