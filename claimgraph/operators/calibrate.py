"""How well sources foresaw, how claims moved, and what is still fresh or to be done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.versioned import VersionedTable
from claimgraph.operators.asof import latest_before

TIERS = ["sandbox", "proposition", "validated", "verified"]


def tier_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), c)


def record_predictions(attestations: DataFrame) -> DataFrame:
    """B1 of (claim_hash, run_id, votes array): one row a vote; retries of (model, claim, run) are one."""
    each = attestations.select("claim_hash", "run_id", F.explode("votes").alias("v")).select("claim_hash", "run_id", "v.*")
    return each.dropDuplicates(["model_id", "claim_hash", "run_id"])


def resolve(predictions: DataFrame) -> DataFrame:
    """B2: Brier score of each prediction (confidence, agreed) whose outcome is known."""
    p = F.when(F.col("agreed"), F.col("confidence")).otherwise(1 - F.col("confidence"))
    return predictions.filter("outcome is not null").withColumn("brier", F.round(F.pow(p - F.col("outcome"), 2), 6))


def brier(resolved: DataFrame, as_of: str, *, days: int = 90) -> DataFrame:
    """By model, over predictions made in the window before as_of; weight = max(0, 1 - mean)."""
    end = F.lit(as_of).cast("timestamp")
    rows = resolved.filter((F.col("created_at") >= end - F.expr(f"interval {days} days")) & (F.col("created_at") <= end))
    stats = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("brier").alias("_b"), F.min("brier").alias("least"), F.max("brier").alias("most"))
    return stats.select("model", "n", F.round("_b", 4).alias("avg_brier"), "least", "most", F.round(F.greatest(F.lit(0.0), 1 - F.col("_b")), 4).alias("weight"))


def rolling_brier(resolved: DataFrame, *, days: int = 90) -> DataFrame:
    """After each day, each model's mean over the days before; days are summed up first, so a model's history is short."""
    daily = resolved.groupBy("model", F.to_date("created_at").alias("day")).agg(F.sum("brier").alias("s"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("model").orderBy(F.unix_date("day")).rangeBetween(-days, 0)
    return daily.select("model", F.col("day").cast("string").alias("day"), F.round(F.sum("s").over(w) / F.sum("n").over(w), 8).alias("avg_brier"), F.sum("n").over(w).alias("n"))


def model_weights(models: DataFrame, scores: DataFrame) -> DataFrame:
    """1 for models without a score."""
    return models.select("model").join(scores.select("model", "weight"), "model", "left").select("model", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def tier_transitions(attestations: DataFrame) -> DataFrame:
    """B5 of (claim_hash, tier, at): changes of tier in time, from sandbox."""
    old = F.coalesce(F.lag("tier").over(Window.partitionBy("claim_hash").orderBy("at")), F.lit(TIERS[0]))
    return attestations.withColumn("old_tier", old).filter(F.col("old_tier") != F.col("tier")).select("claim_hash", "old_tier", F.col("tier").alias("new_tier"), "at")


def history(attestations: DataFrame, by: str, *, order: str = "newest", k: int = 3) -> DataFrame:
    """The k newest, best or oldest attestations of each subject, question or hash."""
    keys = {"newest": [F.desc("at"), "claim_hash"], "best": [F.desc("score"), F.desc("at"), "claim_hash"], "oldest": ["at", "claim_hash"]}[order]
    return attestations.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*keys))).filter(F.col("place") <= k)


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """B7 of (claim_hash, tier, score): what became of each claim between two runs."""
    b = before.select("claim_hash", F.col("tier").alias("tier_before"), F.col("score").alias("score_before"))
    a = after.select("claim_hash", F.col("tier").alias("tier_after"), F.col("score").alias("score_after"))
    up = tier_rank(F.col("tier_after")) - tier_rank(F.col("tier_before"))
    status = F.when(F.col("tier_before").isNull(), "new").when(F.col("tier_after").isNull(), "lost").when(up > 0, "improved").when(up < 0, "degraded").otherwise("stable")
    return b.join(a, "claim_hash", "full").select("claim_hash", "tier_before", "tier_after", F.round(F.col("score_after") - F.col("score_before"), 4).alias("delta"), status.alias("status"))


def pair_sensitivity(scores: DataFrame, pairs: DataFrame, least: float = 0.15) -> DataFrame:
    """B8 of scores (claim, score) and pairs (claim, pair_with): the absolute difference, and whether it is a nuance."""
    other = scores.select(F.col("claim").alias("pair_with"), F.col("score").alias("other"))
    rows = pairs.join(scores, "claim").join(other, "pair_with").withColumn("difference", F.round(F.abs(F.col("score") - F.col("other")), 4))
    return rows.select("claim", "pair_with", "difference", (F.col("difference") >= least).alias("nuance"))


def uplift(run: DataFrame, baseline: DataFrame) -> DataFrame:
    """B9 of (claim, score)."""
    return run.join(baseline.select("claim", F.col("score").alias("base")), "claim").select("claim", F.round(F.col("score") - F.col("base"), 4).alias("uplift"))


def scorecard(claims: DataFrame) -> DataFrame:
    """B10 of (difficulty, ambiguity, score, verdict, dissent, error): counts, means and rates by both and their totals.

    A claim with an error isn't completed and has no verdict; split claims have dissent; the pass rate is the share of
    completed claims that are supported.
    """
    done = F.col("error").isNull()
    n = lambda test: F.count_if(done & test)
    rows = claims.cube("difficulty", "ambiguity").agg(
        F.count(F.lit(1)).alias("n"), n(F.lit(True)).alias("completed"), F.count_if(~done).alias("errored"), n(F.col("verdict") == "supported").alias("supported"),
        n(F.col("verdict") == "contested").alias("contested"), n(F.col("dissent")).alias("split"), F.round(F.avg(F.when(done, F.col("score"))), 4).alias("avg_score"),
    )
    rate = F.when(F.col("completed") > 0, F.round(F.col("supported") / F.col("completed"), 4))
    return rows.select(F.coalesce("difficulty", F.lit("all")).alias("difficulty"), F.coalesce("ambiguity", F.lit("all")).alias("ambiguity"), "n", "completed", "errored", "supported", "contested", "split", "avg_score", rate.alias("pass_rate"))


def pending(extractions: DataFrame, *, least: float = 0.5) -> DataFrame:
    """B12 of (…, confidence, injected, skip_reason): what is sure enough and neither injected nor skipped."""
    return extractions.filter(~F.coalesce("injected", F.lit(False)) & F.col("skip_reason").isNull() & (F.col("confidence") >= least))


def run_stats(events: DataFrame, by: str) -> DataFrame:
    """B11 of (by, ts, kind): minutes from first to last, distinct kinds and events."""
    return events.groupBy(by).agg(F.round((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 60, 2).alias("minutes"), F.countDistinct("event_type").alias("kinds"), F.count(F.lit(1)).alias("n"))


def aliases_of(aliases: DataFrame) -> DataFrame:
    """B14 of (concept, alias)."""
    return aliases.groupBy("concept").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("alias")), ", ").alias("aliases"))


def cached(attestations: DataFrame, questions: DataFrame, as_of: str, *, hours: int = 168, least_score: float = 0.4) -> DataFrame:
    """J13 of attestations (question, score, tier, at): each question's newest answer that is good and young enough."""
    end = F.lit(as_of).cast("timestamp")
    young = attestations.filter((F.col("at") > end - F.expr(f"interval {hours} hours")) & (F.col("at") <= end) & (F.col("score") >= least_score) & (tier_rank(F.col("tier")) >= 2))
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("at"), "claim_hash"))
    return young.join(questions.select("question").distinct(), "question", "left_semi").withColumn("place", place).filter("place = 1").drop("place")


def cached_as_of(attestations: DataFrame, questions: DataFrame, *, hours: int = 168, least_score: float = 0.4) -> DataFrame:
    """J13 of attestations (question, claim_hash, score, tier, at) and questions (question, as_of): each asked for its own time.

    Every question comes back, with the newest answer that is good and, at its time, young enough, or with nulls.
    """
    good = attestations.filter((F.col("score") >= least_score) & (tier_rank(F.col("tier")) >= 2))
    rows = latest_before(questions.select("question", "as_of"), good, ["question"], tie=["claim_hash"])
    young = F.col("found.at") > F.col("as_of") - F.expr(f"interval {hours} hours")
    answer = F.when(young, F.col("found"))
    return rows.select("question", "as_of", *[answer[c].alias(c) for c in good.columns if c != "question"])


def stale_as_of(wanted: DataFrame, snapshots: DataFrame) -> DataFrame:
    """J14 of wanted (source_id, query_hash, ttl_hours, as_of): what has no snapshot that is young enough at its own time."""
    keys = ["source_id", "query_hash"]
    rows = latest_before(wanted, snapshots.select(*keys, "fetched_at").distinct(), keys, at="fetched_at")
    age = F.unix_timestamp("as_of") - F.unix_timestamp("found.fetched_at")
    return rows.filter(F.col("found").isNull() | (age > F.col("ttl_hours") * 3600)).select(*keys, "as_of", F.col("found.fetched_at").alias("fetched_at"))


def anchors(attestations: DataFrame, questions: DataFrame) -> DataFrame:
    """Deterministic attestations of the questions, with their source's id and version out of JSON."""
    meta = F.col("consensus_meta")
    found = attestations.filter(F.col("kind") == "deterministic").join(questions.select("question").distinct(), "question", "left_semi")
    return found.withColumn("source_id", F.coalesce(F.get_json_object(meta, "$.source.id"), F.get_json_object(meta, "$.source_id"), F.lit("unknown"))).withColumn("version", F.coalesce(F.get_json_object(meta, "$.source.version"), F.lit("")))


def stale(wanted: DataFrame, snapshots: DataFrame, as_of: str) -> DataFrame:
    """J14 of wanted (source_id, query_hash, ttl_hours) and snapshots (source_id, query_hash, fetched_at): what to fetch."""
    end = F.lit(as_of).cast("timestamp")
    newest = snapshots.groupBy("source_id", "query_hash").agg(F.max("fetched_at").alias("fetched_at"))
    rows = wanted.join(newest, ["source_id", "query_hash"], "left")
    return rows.filter(F.col("fetched_at").isNull() | (F.unix_timestamp(end) - F.unix_timestamp("fetched_at") > F.col("ttl_hours") * 3600)).select("source_id", "query_hash", "fetched_at")


def verify_commits(revealed: DataFrame, commits: DataFrame) -> DataFrame:
    """J15 of revealed (run_id, model, phase, response) and commits (…, response_hash): a missing commit is false."""
    keys = ["run_id", "model", "phase"]
    rows = revealed.join(commits.select(*keys, "response_hash"), keys, "left")
    return rows.select(*keys, F.coalesce(F.sha2("response", 256) == F.col("response_hash"), F.lit(False)).alias("verified"))


def embedding_backlog(concepts: DataFrame, embedded: DataFrame, model: str) -> DataFrame:
    """Concepts without a vector of the model."""
    return concepts.join(embedded.filter(F.col("model_id") == model).select("id").distinct(), "id", "left_anti")


def finalise_migration(current: DataFrame, staged: DataFrame, dimension: int) -> DataFrame:
    """(id, embedding, model_id) after a migration: the staged vectors only if not one of them has a bad dimension."""
    failed = staged.agg(F.count_if(F.coalesce(F.size("embedding"), F.lit(-1)) != dimension).alias("failures"))
    new = staged.crossJoin(F.broadcast(failed)).filter("failures = 0").drop("failures")
    return current.join(new.select("id"), "id", "left_anti").unionByName(new)


def roll_back_migration(vectors: DataFrame, model: str) -> DataFrame:
    """Vectors without those of the model that a migration led to."""
    return vectors.filter(~F.col("model_id").eqNullSafe(F.lit(model)))


def latest_published(claims: DataFrame, pushes: DataFrame) -> DataFrame:
    """J17 of pushes (question, ok, at, signature): claims with their latest successful publication."""
    last = pushes.filter("ok").groupBy("question").agg(F.max_by("signature", F.struct("at", "signature")).alias("signature"), F.max("at").alias("published_at"))
    return claims.join(last, "question", "left")


def publish_candidates(attestations: DataFrame, published: DataFrame, *, least_score: float, k: int) -> DataFrame:
    """S17 of (frame, claim_hash, score, at): the k best of each frame that aren't published, one for each hash."""
    fresh = attestations.filter(F.col("score") >= least_score).join(published.select("claim_hash").distinct(), "claim_hash", "left_anti")
    once = F.row_number().over(Window.partitionBy("frame", "claim_hash").orderBy(F.desc("score"), F.desc("at")))
    place = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("score"), F.desc("at"), "claim_hash"))
    return fresh.withColumn("o", once).filter("o = 1").drop("o").withColumn("place", place).filter(F.col("place") <= k)


def store_snapshots(landed: DataFrame) -> DataFrame:
    """One snapshot of each (source_id, query_hash, source_version), the first fetched, with its content's hash."""
    first = F.row_number().over(Window.partitionBy("source_id", "query_hash", "source_version").orderBy("fetched_at", "raw_response"))
    return landed.withColumn("o", first).filter("o = 1").drop("o").withColumn("content_hash", F.sha2("raw_response", 256))


def land_snapshots(landed: DataFrame, path: str, *, buckets: int = 64) -> VersionedTable:
    """Snapshots kept in a stored table: of those there and those that come the first fetched stays.

    Only the buckets of what comes are rewritten.
    """
    keys, table = ["source_id", "query_hash", "source_version"], VersionedTable(landed.sparkSession, path)
    if not table.versions():
        return VersionedTable.create(path, store_snapshots(landed), keys, buckets=buckets)
    table.update(landed.select(*keys), lambda now: store_snapshots(now.drop("content_hash").unionByName(landed)))
    return table
