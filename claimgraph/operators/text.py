"""Cleaning, canonicalising, hashing and labelling, as column expressions and one-scan jobs.

Vocabularies are arguments: small dictionaries become map literals, catalogues are joined as dimension tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]) if pairs else F.create_map().cast("map<string,string>")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalise(c: Column) -> Column:
    """Lower case, outer whitespace removed, inner runs collapsed."""
    return F.regexp_replace(strip(F.lower(c)), r"(?U)\s+", " ")


def normalise_entity(c: Column, synonyms: dict[str, str]) -> Column:
    """The whole text's synonym, else each word's."""
    text, known = F.regexp_replace(normalise(c), "_", " "), _map(synonyms)
    words = F.transform(F.split(text, " "), lambda w: F.coalesce(F.try_element_at(known, w), w))
    return F.coalesce(F.try_element_at(known, text), F.array_join(words, " "))


def normalise_relation(c: Column, vocabulary: dict[str, str], *, hyphens: bool = False) -> Column:
    """C3 and, with hyphens, C4: looked up with underscores; unknown text is kept as it is."""
    text = normalise(c)
    key = F.regexp_replace(text, "[- ]" if hyphens else " ", "_")
    return F.coalesce(F.try_element_at(_map(vocabulary), key), key if hyphens else text)


def canonical_relations(rows: DataFrame, catalogue: DataFrame, *, column: str = "relation", unknown: str | None = "related_to") -> DataFrame:
    """Canonical relation, inverse, symmetric and category from catalogue(canonical, aliases, inverse, symmetric, category)."""
    names = catalogue.select("*", F.explode(F.array_distinct(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("_name")).drop("aliases")
    names = names.withColumn("_name", F.regexp_replace(normalise(F.col("_name")), "[- ]", "_")).dropDuplicates(["_name"])
    keyed = rows.withColumn("_name", F.regexp_replace(normalise(F.col(column)), "[- ]", "_"))
    return keyed.join(names, "_name", "left").withColumn("canonical", F.coalesce("canonical", F.lit(unknown))).drop("_name")


#: What no subject or object may be: pronouns and words without content (our own list).
STOP_TERMS = ["it", "he", "she", "they", "this", "that", "these", "those", "thing", "things", "something", "one", "the", "a", "an"]


def validate_votes(votes: DataFrame, *, least_confidence: float = 0.3, stop_terms: list[str] = STOP_TERMS) -> DataFrame:
    """Cleaned subject, relation, object and confidence, with valid, errors and warnings; rejected rows stay marked.

    A missing confidence is 0.7, one that is no number 0.5; others are cut to [0, 1].
    """
    clean = lambda c: F.regexp_replace(strip(F.regexp_replace(c, r"[\x00-\x1F\x7F]", " ")), "^[\"']+|[\"']+$", "")
    raw = F.col("confidence").cast("string")
    value = F.when(raw.isNull(), 0.7).otherwise(F.coalesce(F.expr("try_cast(confidence as double)"), F.lit(0.5)))
    rows = votes.withColumns({c: clean(F.col(c)) for c in ("subject", "relation", "object")}).withColumn("_given", raw).withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))

    def wrong(c: str) -> list[Column]:
        t, low = F.col(c), F.lower(F.col(c))
        return [
            F.when(t.isNull() | (t == ""), f"{c} is missing"), F.when((F.length(t) < 2) | (F.length(t) > 100), f"{c} has a bad length"), F.when(low.isin(stop_terms), f"{c} has no content"),
            F.when(t.rlike(r"^[\W\d_]+$"), f"{c} has no letters"), F.when(t.rlike(r"[\[\]{}<>]"), f"{c} has brackets"),
        ]

    errors = [*wrong("subject"), *wrong("object"), F.when(F.col("relation").isNull() | (F.col("relation") == ""), "relation is missing")]
    errors += [F.when(F.lower("subject") == F.lower("object"), "subject is object"), F.when(F.col("confidence") < least_confidence, "confidence is low")]
    warned = [F.when(F.col("_given").isNull(), "confidence was missing"), F.when(F.expr("try_cast(_given as double)") != F.col("confidence"), "confidence was cut")]
    rows = rows.withColumn("errors", F.array_compact(F.array(*errors))).withColumn("warnings", F.array_compact(F.array(*warned)))
    return rows.withColumn("valid", F.size("errors") == 0).drop("_given")


def validation_counters(validated: DataFrame) -> DataFrame:
    """C8."""
    return validated.agg(F.count(F.lit(1)).alias("processed"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(F.col("valid") & (F.size("warnings") > 0)).alias("corrected"))


def claim_hash(subject: Column, predicate: Column, obj: Column, frame: Column | None = None) -> Column:
    """A null frame counts as empty."""
    parts = [strip(F.lower(F.coalesce(c, F.lit("")))) for c in (subject, predicate, obj, frame if frame is not None else F.lit(""))]
    return F.sha2(F.concat_ws("|", *parts), 256)


def triple_hash(subject: Column, relation: Column, obj: Column, *, synonyms: dict[str, str] | None = None, vocabulary: dict[str, str] | None = None) -> Column:
    """C10."""
    parts = [normalise_entity(subject, synonyms or {}), normalise_relation(relation, vocabulary or {}), normalise_entity(obj, synonyms or {})]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def canonical_json(columns: list[str]) -> Column:
    """Fields in order of name, nulls written out."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def json_hash(columns: list[str]) -> Column:
    """C11."""
    return F.sha2(canonical_json(columns), 256)


def family(model: Column, families: dict[str, str]) -> Column:
    """The first token of a model's name after its provider, looked up."""
    token = F.regexp_extract(F.lower(F.regexp_replace(model, r"^.*::", "")), r"^([^:\-_./\d]*)", 1)
    return F.coalesce(F.try_element_at(_map(families), token), F.lit("unknown"))


def classify(question: Column, explore: list[str], verify: list[str]) -> Column:
    """Explore patterns go first; explore too where none fits."""
    either = lambda patterns: F.lower(question).rlike("|".join(f"(?:{p})" for p in patterns))
    return F.when(either(explore), "explore").when(either(verify), "verify").otherwise("explore")


def seed_terms(text: Column, stop_words: list[str]) -> Column:
    """C14: distinct words of two letters and more in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(stop_words)))


def tier(score: Column, models: Column, families: Column, anchored: Column, validations: Column) -> Column:
    """C15."""
    return (
        F.when((score >= 0.85) & (models >= 3) & (families >= 2) & (anchored | (validations >= 3)), "verified")
        .when((score >= 0.70) & (models >= 3) & (families >= 2), "validated").when((score >= 0.40) & (models >= 2), "proposition").otherwise("sandbox")
    )


def decidability(score: Column, verdict: Column, claim_type: Column, verdict_penalty: dict[str, float], type_penalty: dict[str, float]) -> Column:
    """Unknown verdicts keep 0.65 of the score, unknown claim types all of it."""
    return F.round(score * F.coalesce(F.try_element_at(_map(verdict_penalty), verdict), F.lit(0.65)) * F.coalesce(F.try_element_at(_map(type_penalty), claim_type), F.lit(1.0)), 4)
