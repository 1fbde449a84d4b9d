"""Consensus of many sources on the same claim.

Votes are (model, subject, relation, object, confidence, ord); ord is any orderable column that fixes the order of
votes. Models are (model, weight) and include those that cast no vote. Equal triples are summed up as they are written
before their claim's key is computed, so normalising and hashing run once for each distinct triple, not for each vote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimgraph.operators import text

LEAST_CONFIDENCE, LEAST_AGREEMENT = 0.3, 0.5


def model_table(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(weights.items()), "model string, weight double")


TRIPLE = ["subject", "relation", "object"]


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("claim_key", text.triple_hash(F.col("subject"), F.col("relation"), F.col("object")))


def _counted(votes: DataFrame, least_confidence: float, *of: str) -> DataFrame:
    """Votes that count, summed up by triple as written (and ``of``), with the claim's key."""
    rows = votes.filter(F.col("confidence") >= least_confidence)
    c = F.col("confidence")
    sums = [F.count(F.lit(1)).alias("_n"), F.sum(c).alias("_s"), F.sum(c * c).alias("_s2"), F.min("ord").alias("_ord"), F.max("ord").alias("_end"), F.max_by("confidence", "ord").alias("_last")]
    return _keyed(rows.groupBy(*TRIPLE, *of).agg(*sums, *([] if of else [F.collect_set("model").alias("_models")])))


def exact_consensus(votes: DataFrame, models: DataFrame, *, least_confidence: float = LEAST_CONFIDENCE, least_agreement: float = LEAST_AGREEMENT, distinct_models: bool = False, by: list[str] | None = None) -> DataFrame:
    """A1: claims with at least the agreement asked for. Agreement counts votes; with distinct_models, models.

    With ``by``, claims of each value of these columns. votes may be a stream.
    """
    by = by or []
    total = models.agg(F.count(F.lit(1)).alias("n_models"))
    if by:  # few votes share a triple there: summing them up first would be one more shuffle, or state, of nearly all rows
        c = F.col("confidence")
        groups = _keyed(votes.filter(c >= least_confidence)).groupBy("claim_key", *by).agg(
            F.count(F.lit(1)).alias("n_votes"), F.sum(c).alias("_s"), F.sum(c * c).alias("_s2"), F.min_by(F.struct(*TRIPLE), "ord").alias("first"), F.min("ord").alias("ord"),
            F.array_sort(F.collect_set("model")).alias("models"),
        )
    else:
        groups = _counted(votes, least_confidence).groupBy("claim_key").agg(
            F.sum("_n").alias("n_votes"), F.sum("_s").alias("_s"), F.sum("_s2").alias("_s2"), F.min_by(F.struct(*TRIPLE), "_ord").alias("first"), F.min("_ord").alias("ord"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("_models")))).alias("models"),
        )
    n = F.col("n_votes")
    avg = F.col("_s") / n
    std = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("_s2") - n * avg * avg) / (n - 1))).otherwise(0.0)
    shared = (F.size("models") if distinct_models else n) / F.col("n_models")
    kept = groups.crossJoin(F.broadcast(total)).withColumns({"_agreement": shared, "_avg": avg, "_std": std}).filter(F.col("_agreement") >= least_agreement)
    return kept.select(
        *by, "claim_key", "first.*", "n_votes", F.round("_agreement", 4).alias("agreement"), F.round("_avg", 4).alias("avg_confidence"), F.round("_std", 4).alias("std_confidence"),
        F.round(0.6 * F.col("_agreement") + 0.4 * F.col("_avg"), 4).alias("score"), F.size("models").alias("n_models"), F.array_join("models", ",").alias("models"), "ord",
    )


def weighted_consensus(votes: DataFrame, models: DataFrame, *, least_confidence: float = LEAST_CONFIDENCE, least_agreement: float = LEAST_AGREEMENT, by: list[str] | None = None) -> DataFrame:
    """A2: each model's last confidence, weighted; a model that the table doesn't name weighs 1.

    With ``by``, claims of each value of these columns. votes may be a stream.
    """
    by = by or []
    total = models.agg(F.sum("weight").alias("_all"))
    if by:
        last = _keyed(votes.filter(F.col("confidence") >= least_confidence)).groupBy("claim_key", "model", *by).agg(F.max_by("confidence", "ord").alias("confidence"))
    else:
        last = _counted(votes, least_confidence, "model").groupBy("claim_key", "model").agg(F.max_by("_last", "_end").alias("confidence"))
    weighed = last.join(models, "model", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    sums = weighed.groupBy("claim_key", *by).agg(F.sum("weight").alias("_w"), F.sum(F.col("weight") * F.col("confidence")).alias("_wc"), F.avg("confidence").alias("_plain"), F.count(F.lit(1)).alias("n_models"))
    mean = F.when(F.col("_w") > 0, F.col("_wc") / F.col("_w")).otherwise(F.col("_plain"))
    rows = sums.crossJoin(F.broadcast(total)).withColumn("_agreement", F.col("_w") / F.col("_all")).filter(F.col("_agreement") >= least_agreement)
    return rows.select(*by, "claim_key", "n_models", F.round("_agreement", 6).alias("agreement"), F.round(mean, 6).alias("avg_confidence"), F.round(0.6 * F.col("_agreement") + 0.4 * mean, 6).alias("score"))


def vote_entropy(votes: DataFrame, models: DataFrame, *, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """A3: binary entropy, in bits, of how full the table of claims by models is."""
    cast = _keyed(votes.filter(F.col("confidence") >= least_confidence).select(*TRIPLE, "model").distinct())
    cells = cast.select("claim_key", "model").distinct().groupBy("claim_key").agg(F.count(F.lit(1)).alias("n"))
    filled = cells.agg(F.sum("n").alias("filled"), F.count(F.lit(1)).alias("claims")).crossJoin(F.broadcast(models.agg(F.count(F.lit(1)).alias("n_models"))))
    p = F.col("filled") / (F.col("claims") * F.col("n_models"))
    entropy = F.when((p <= 0) | (p >= 1) | p.isNull(), 0.0).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))
    return filled.select("claims", "filled", F.round(entropy, 6).alias("vote_entropy"))


def controversial(consensus: DataFrame, least_std: float = 0.15) -> DataFrame:
    """A6."""
    return consensus.filter(F.col("std_confidence") >= least_std)


def high_agreement(consensus: DataFrame, least: float = 0.9) -> DataFrame:
    """A6."""
    return consensus.filter(F.col("agreement") >= least)


def _first_verdicts(verdicts: DataFrame, decided: DataFrame | None, anchored: DataFrame | None) -> DataFrame:
    rows = verdicts.join(decided.select("claim").distinct(), "claim", "left_anti") if decided is not None else verdicts
    rows = rows.join(anchored.select("claim").distinct(), "claim", "left_semi") if anchored is not None else rows
    return rows.groupBy("claim", "model").agg(F.min_by(F.struct("verdict", "confidence"), "ord").alias("v"), F.min("ord").alias("ord")).select("claim", "model", "v.*", "ord")


def verdict_vote(verdicts: DataFrame, *, decided: DataFrame | None = None, anchored: DataFrame | None = None) -> DataFrame:
    """A7 of (claim, model, verdict, confidence, ord): the verdict with the largest sum over each model's first vote.

    Only claims that no verdict has reached consensus on (decided) and that had anchors (anchored) are voted on.
    """
    sums = _first_verdicts(verdicts, decided, anchored).groupBy("claim", "verdict").agg(F.sum("confidence").alias("s"), F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("agreeing"))
    of_claim = Window.partitionBy("claim")
    best = sums.withColumn("total", F.sum("s").over(of_claim)).withColumn("voters", F.sum("agreeing").over(of_claim)).withColumn("place", F.row_number().over(of_claim.orderBy(F.desc("s"), "first_ord")))
    share = F.when(F.col("total") > 0, F.round(F.round(F.col("s") / F.col("total"), 10), 4)).otherwise(1.0)
    return best.filter("place = 1").select("claim", "verdict", share.alias("share"), "agreeing", "voters")


def verdict_votes(verdicts: DataFrame, *, decided: DataFrame | None = None, anchored: DataFrame | None = None) -> DataFrame:
    """Each model's vote (claim, model, verdict, confidence) and whether it agreed with what won."""
    won = verdict_vote(verdicts, decided=decided, anchored=anchored).select("claim", F.col("verdict").alias("_won"))
    rows = _first_verdicts(verdicts, decided, anchored).join(won, "claim")
    return rows.select("claim", "model", "verdict", "confidence", (F.col("verdict") == F.col("_won")).alias("agreed"))


def vote_signature(consensus: DataFrame, families: Column) -> DataFrame:
    """Agreement, steadiness, two neutral values and diversity of families."""
    return consensus.select("claim_key", F.col("agreement"), F.round(1 - F.col("std_confidence"), 4).alias("steadiness"), F.lit(0.5).alias("centrality"), F.lit(0.5).alias("stability"), F.round(families / F.col("n_votes"), 4).alias("diversity"))


def crystallise(claims: DataFrame, *, families: dict[str, str], least_score: float = 0.4, anchored: bool = False, validations: int = 0, verdict_penalties: dict[str, float] | None = None, type_penalties: dict[str, float] | None = None) -> DataFrame:
    """Attestations of claims in consensus (subject, relation, object, score, n_votes, models, ord).

    Of claims with one hash the first in order counts, before scores are looked at. Where penalties are given, verdicts
    are scored down by their object and their claim's type (claim_type). agreeing is how many models stand behind a
    claim, or the column of that name. A claim of method ``deterministic`` needs an anchor; without one it is no
    attestation.
    """
    rows = claims.withColumn("claim_hash", text.claim_hash(F.col("subject"), F.col("relation"), F.col("object")))
    first = rows.groupBy("claim_hash").agg(F.min_by(F.struct(*claims.columns), "ord").alias("c")).select("claim_hash", "c.*").filter(F.col("score") >= least_score)
    if "method" in claims.columns:
        first = first.filter((F.col("method") != "deterministic") | F.col("anchor").isNotNull())
    models = F.filter(F.split("models", ","), lambda m: m != "")
    kinds = F.array_distinct(F.transform(models, lambda m: text.family(m, families)))
    score = F.col("score")
    if verdict_penalties is not None:
        score = F.when(F.col("relation") == "verdict", text.decidability(score, F.col("object"), F.col("claim_type"), verdict_penalties, type_penalties or {})).otherwise(score)
    agreeing = F.col("agreeing") if "agreeing" in claims.columns else F.size(models)
    first = first.withColumns({"_score": score, "_agreeing": agreeing, "_models": F.size(models), "_families": F.size(kinds)})
    tier = text.tier(F.col("_score"), F.col("_models"), F.col("_families"), F.lit(anchored), F.lit(validations))
    return first.select("claim_hash", "subject", F.col("relation").alias("predicate"), "object", F.col("_score").alias("score"), F.col("n_votes").alias("models_consulted"), F.col("_models").alias("n_models"), F.col("_agreeing").alias("agreeing"), F.col("_families").alias("families"), tier.alias("tier"))


def verify_summary(verdicts: DataFrame) -> DataFrame:
    """A10 of (claim, model, verdict, confidence, ord, score): the verdict of the best score and every model's own."""
    return verdicts.groupBy("claim").agg(F.max_by("verdict", F.struct("score", F.col("ord"))).alias("verdict"), F.round(F.max("score"), 4).alias("score"), F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "model", "verdict"))), ",").alias("by_model"))


def below_threshold(consensus_all: DataFrame, *, least_agreement: float = LEAST_AGREEMENT, keep: int = 20, of: list[str] | None = None) -> DataFrame:
    """Rows below the threshold, the first ``keep`` of each group in order of ord, and how many there are."""
    low = consensus_all.filter(F.col("agreement") < least_agreement)
    if not of:
        return low.orderBy("ord").limit(keep).crossJoin(low.agg(F.count(F.lit(1)).alias("total")))
    first = low.withColumn("place", F.row_number().over(Window.partitionBy(*of).orderBy("ord"))).filter(F.col("place") <= keep)
    return first.join(low.groupBy(*of).agg(F.count(F.lit(1)).alias("total")), of)


def diversity_bonus(attestations: DataFrame, factor: float = 1.1) -> DataFrame:
    """A12."""
    return attestations.withColumn("adjusted", F.round(F.least(F.lit(1.0), F.col("score") * F.when(F.col("families") >= 2, factor).otherwise(1.0)), 4))


def worst_severity(findings: DataFrame, levels: list[str], *, fold: dict[str, str] | None = None) -> DataFrame:
    """A15 of (contract, unit, severity): the worst level of a contract; levels run from worst to least, the last is the default.

    fold names levels that count as others. Where findings tell external_calls and state_writes of their units, the
    contract's units are also listed as they are looked at: those with external calls, those that write, the others.
    """
    severity = F.col("severity")
    for name, other in (fold or {}).items():
        severity = F.when(severity == name, other).otherwise(severity)
    rank = F.array_position(F.array(*map(F.lit, levels)), severity)
    rank = F.when(rank > 0, rank).otherwise(len(levels))
    aggregates = [F.element_at(F.array(*map(F.lit, levels)), F.min(rank).cast("int")).alias("severity"), F.count(F.lit(1)).alias("findings")]
    if {"external_calls", "state_writes"} <= set(findings.columns):
        stage = F.when(F.col("external_calls") > 0, 0).when(F.col("state_writes") > 0, 1).otherwise(2)
        aggregates.append(F.min_by("unit", F.struct(stage.alias("stage"), F.col("unit"))).alias("first_unit"))
    return findings.groupBy("contract").agg(*aggregates)


def unit_order(units: DataFrame) -> DataFrame:
    """A15 of (contract, unit, external_calls, state_writes): each unit's place: external calls, then writes, then the rest."""
    stage = F.when(F.col("external_calls") > 0, 0).when(F.col("state_writes") > 0, 1).otherwise(2)
    return units.withColumn("place", F.row_number().over(Window.partitionBy("contract").orderBy(stage, "unit"))).select("contract", "unit", "place")
