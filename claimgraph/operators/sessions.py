"""Session logs, token budgets, keywords, memory and retention."""

from __future__ import annotations

import functools
import heapq
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgraph.functions.quantiles import exact_percentile
from claimgraph.functions.storage import materialise
from claimgraph.functions.versioned import VersionedTable

#: Words without content in the four languages of our tests (our own list).
STOP_WORDS = ["with", "from", "that", "this", "have", "they", "what", "pour", "dans", "avec", "sont", "nous", "vous", "para", "como", "esta", "pero", "nicht", "eine", "einer", "sich", "auch"]
WORD = "[a-zà-öø-ÿ]{4,}"


def messages(log: DataFrame, *, roles: list[str] | None = None, k: int = 50) -> DataFrame:
    """X1 of (conv_id, turn, role, text): each session's first k messages of the roles, in order."""
    rows = log if roles is None else log.filter(F.col("role").isin(roles))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).filter(F.col("place") <= k)


def trim(log: DataFrame, *, last: int = 20, budget: int = 300, pinned: str = "system") -> DataFrame:
    """Of the last messages of each session, the newest whose characters, a quarter each, fit the budget; one at least.

    A session's first row stays, whatever its size, if it has the role ``pinned``; it counts neither as one of the last
    nor in the budget. Its place from the back is 0.
    """
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = log.withColumn("_pin", (first == 1) & F.coalesce(F.col("role") == pinned, F.lit(False)))
    back = Window.partitionBy("conv_id", "_pin").orderBy(F.desc("turn"))
    rows = rows.withColumn("back", F.when(F.col("_pin"), 0).otherwise(F.row_number().over(back))).filter(F.col("back") <= last)
    upto = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("chars", upto).filter((F.expr("chars div 4") <= budget) | (F.col("back") <= 1)).select("conv_id", "turn", "role", "back", "chars")


def _repeated_keywords(texts: DataFrame, k: int, stop_words: list[str]) -> DataFrame:
    """Keywords of ids that several rows share: their words are counted together."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    each = texts.select("id", F.posexplode(words).alias("pos", "word")).filter(~F.col("word").isin(stop_words))
    scored = each.groupBy("id", "word").agg((F.count(F.lit(1)) * F.length("word")).alias("score"), F.min("pos").alias("first"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "first"))
    return scored.withColumn("place", place).filter(F.col("place") <= k).select("id", "place", "word", "score")


def keywords(texts: DataFrame, *, k: int = 5, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """X3 of (id, text): each text's best words of four letters and more by times x length; ties by first place.

    Texts are scanned where they lie and only their ids are counted; words move for ids that several rows share.
    """
    stop, word, out = frozenset(stop_words), re.compile(WORD), T.StructType([texts.schema["id"], T.StructField("place", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("score", T.LongType())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, place, words, scores = [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                # counted in order of first places, which nlargest keeps among equals
                counts = Counter(word.findall(text or ""))
                top = heapq.nlargest(k, ((n * len(w), w) for w, n in counts.items() if w not in stop), key=lambda x: x[0])
                at += [row] * len(top)
                place += range(1, len(top) + 1)
                words += [w for _, w in top]
                scores += [n for n, _ in top]
            columns = [batch.column("id").take(pa.array(at, pa.int64())), pa.array(place, pa.int32()), pa.array(words, pa.string()), pa.array(scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    found = texts.select("id", F.lower("text").alias("text")).mapInArrow(best, out)
    repeated = materialise(texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("_again")), "keywords-repeated")
    if repeated.isEmpty():
        return found
    again = F.col("id").eqNullSafe(F.col("_again"))
    return found.join(repeated, again, "left_anti").unionByName(_repeated_keywords(texts.join(repeated, again, "left_semi"), k, stop_words))


#: Words of a text and of a concept at most for which context forms sets of words, and concepts (of different weights) that
#: a word may have to be looked up one by one.
ASKED_WORDS, CONCEPT_WORDS, FEW = 5, 10, 16


def _word_sets(entries: Column, kind: str) -> Column:
    """All sets (words, weight, bound) of up to ASKED_WORDS of entries (source, weight, bound), in the entries' order."""
    start = F.array(F.struct(F.expr(f"cast(array() as array<{kind}>)").alias("words"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("bound")))
    more = lambda s, e: F.struct(F.concat(s["words"], F.array(e["source"])).alias("words"), (s["weight"] + e["weight"]).alias("weight"), F.greatest(s["bound"], e["bound"]).alias("bound"))
    made = F.aggregate(entries, start, lambda sets, e: F.concat(sets, F.transform(F.filter(sets, lambda s: F.size(s["words"]) < ASKED_WORDS), lambda s: more(s, e))))
    return F.filter(made, lambda s: (F.size(s["words"]) > 0) & (F.round(s["weight"], 4) >= s["bound"]))


def _shared_context(found: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """The k concepts (id, target, weight) of each text, without a row for each pair of a text and a concept.

    A concept among a text's best is among the best k of those that have all the words that the two share, by the sum
    over these words. So the best k are kept for each set of words. Concepts with equal words and weights are one but
    for the k first; sets that weigh less than the k-th best of one of their words alone aren't needed; words of few
    concepts are in no sets, their concepts are looked at one by one.
    """
    kind = edges.schema["source"].dataType.simpleString()
    entries = F.array_sort(F.collect_list(F.struct("source", "weight"))).alias("entries")
    alike = F.row_number().over(Window.partitionBy("entries").orderBy("target"))
    concepts = edges.groupBy("target").agg(entries).withColumn("place", alike).filter(F.col("place") <= k)
    concepts = concepts.groupBy("entries").agg(F.array_sort(F.collect_list("target")).alias("targets"))
    each = materialise(concepts.select("targets", F.explode("entries").alias("e")).select("targets", "e.*"), "context-words")

    numbers = each.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(FEW, k)).select("source")
    best = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("weight")))
    # each row has one concept at least, so the k-th row isn't above the k-th concept
    bounds = each.withColumn("place", best).filter(F.col("place") == k).select("source", F.round("weight", 4).alias("bound"))
    common = materialise(numbers.join(bounds, "source"), "context-common")
    concepts = each.join(common, "source", "left").groupBy("targets").agg(F.array_sort(F.collect_list(F.struct("source", "weight", "bound"))).alias("entries"))
    concepts = materialise(concepts, "context-concepts")

    asked = materialise(found.groupBy("id").agg(F.array_sort(F.collect_set("word")).alias("asked")), "context-asked")
    words = asked.select("asked").distinct().select("asked", F.explode("asked").alias("source"))
    rare = concepts.select("targets", "entries", F.explode(F.filter("entries", lambda e: e["bound"].isNull())).alias("e")).select("targets", "entries", "e.source")
    both = F.filter("entries", lambda e: F.array_contains("asked", e["source"]))
    one_by_one = words.join(rare, "source").select("asked", "targets", F.aggregate(both, F.lit(0.0), lambda s, e: s + e["weight"]).alias("weight"))

    sets = concepts.select("targets", F.explode(_word_sets(F.filter("entries", lambda e: e["bound"].isNotNull()), kind)).alias("s")).select("s.words", "s.weight", "targets")
    first = F.row_number().over(Window.partitionBy("words").orderBy(F.desc(F.round("weight", 4)), F.col("targets")[0]))
    sets = sets.withColumn("place", first).filter(F.col("place") <= k).drop("place")
    entry = F.struct("source", F.lit(0.0).alias("weight"), F.lit(0.0).alias("bound"))
    wanted = words.join(common.select("source"), "source", "left_semi").groupBy("asked").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    by_sets = wanted.select("asked", F.explode(_word_sets(F.col("entries"), kind)["words"]).alias("words")).join(sets, "words").select("asked", "targets", "weight")

    met = one_by_one.unionByName(by_sets).groupBy("asked", "targets").agg(F.round(F.max("weight"), 4).alias("weight"))
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("weight"), "target"))
    met = met.select("asked", F.explode("targets").alias("target"), "weight").withColumn("place", place).filter(F.col("place") <= k)
    return asked.join(met.drop("place"), "asked").select("id", "target", "weight")


def context(found: DataFrame, edges: DataFrame, *, least: float = 0.1, k: int = 5) -> DataFrame:
    """X4 of keywords (id, word) and edges (source, target, weight): the concepts next to a text's keywords, by weight.

    Texts of up to ASKED_WORDS words meet concepts of up to CONCEPT_WORDS by the sets of words that they share; others,
    and all where weights may be negative, meet concept by concept.
    """
    found = found.select("id", "word").filter("word is not null").distinct()
    near = edges.filter((F.col("weight") >= least) & F.col("source").isNotNull()).groupBy("source", "target").agg(F.sum("weight").alias("weight"))
    each = lambda f, e: f.withColumnRenamed("word", "source").join(e, "source").groupBy("id", "target").agg(F.round(F.sum("weight"), 4).alias("weight"))
    if least <= 0:
        met = each(found, near)
    else:
        found, near = materialise(found, "context-found"), materialise(near.select("source", "target", F.col("weight").cast("double")), "context-edges")
        many = lambda rows, key, most: materialise(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(F.col(key).alias("_many")), "context-many")
        texts, concepts = many(found, "id", ASKED_WORDS), many(near, "target", CONCEPT_WORDS)
        short, small, parts = found, near, []
        if not texts.isEmpty():
            same = F.col("id").eqNullSafe(F.col("_many"))
            short, parts = found.join(texts, same, "left_anti"), [each(found.join(texts, same, "left_semi"), near)]
        if not concepts.isEmpty():
            same = F.col("target").eqNullSafe(F.col("_many"))
            small, parts = near.join(concepts, same, "left_anti"), [*parts, each(short, near.join(concepts, same, "left_semi"))]
        met = functools.reduce(DataFrame.unionByName, parts, _shared_context(short, small, k))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "target"))
    return met.withColumn("place", place).filter(F.col("place") <= k)


def recall(memory: DataFrame, asked: DataFrame, *, last: int = 50, least: float = 0.6, k: int = 3) -> DataFrame:
    """X5 of memory (session, turn, embedding) and asked (session, now, query): what a session remembers of a query."""
    recent = memory.withColumn("back", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("turn")))).filter(F.col("back") <= last)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    a, b = F.col("embedding"), F.col("query")
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))))
    weight = F.greatest(F.lit(0.5), 1 - 0.01 * (F.col("now") - F.col("turn")))
    rows = recent.join(asked, "session").withColumn("score", F.round(cosine * weight, 4)).filter(F.col("score") >= least)
    place = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("score"), F.desc("turn")))
    return rows.withColumn("place", place).filter(F.col("place") <= k).select("session", "turn", "score", "place")


def memory_stats(log: DataFrame) -> DataFrame:
    """X6."""
    return log.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


def turn_metrics(turns: DataFrame) -> DataFrame:
    """X7 of (…, weight, concepts, tau, delta_r, rho, length): coherence, pressure, fit, tension and stability of a turn."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    coherence = F.when(F.col("concepts") > 0, unit(F.col("weight") / F.col("concepts") / 0.8)).otherwise(0.0)
    pressure = unit(0.3 * F.abs("delta_r") + 0.7 * F.col("tau") / (F.col("tau") + 1))
    expected = F.when(F.col("rho") > 0, 200 + 100 * F.col("rho")).when(F.col("rho") < 0, 150 + 50 * F.col("rho")).otherwise(150.0)
    fit = unit(1 - F.abs(F.col("length") - expected) / expected)
    rows = turns.withColumns({"_c": coherence, "_p": pressure, "_f": fit}).withColumn("_t", unit(0.4 * (1 - F.col("_c")) + 0.6 * F.col("_p")))
    stability = unit(0.5 * (F.col("_c") + F.col("_f")) - 0.5 * F.col("_t"))
    r = lambda c, name: F.round(c, 9).alias(name)
    return rows.select(*turns.columns, r(F.col("_c"), "coherence"), r(F.col("_p"), "pressure"), r(F.col("_f"), "fit"), r(F.col("_t"), "tension"), r(stability, "stability"))


def metric_summary(metrics: DataFrame, by: list[str], *, high_tension: float = 0.7, low_fit: float = 0.3) -> DataFrame:
    """Metrics of turns by session, or by day: means, the exact median of tension, and shares beyond bounds.

    The median needs no buffer of a group's values; a group without any tension has none.
    """
    share = lambda test, name: F.round(F.count_if(test) / F.count(F.lit(1)), 12).alias(name)
    means = [F.round(F.avg(c), 12).alias(f"avg_{c}") for c in ("coherence", "pressure", "fit", "tension", "stability")]
    sums = metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("turns"), *means, share(F.col("tension") > high_tension, "share_tense"), share(F.col("fit") < low_fit, "share_unfit"))
    median = exact_percentile(metrics, by, "tension", 0.5, "_median")
    return sums.join(median, by, "left").select(*sums.columns, F.round("_median", 12).alias("median_tension"))


def inactive(events: DataFrame, cutoff: str) -> DataFrame:
    """X10 of (session, ts): sessions whose last event is before the cutoff, and how many rows would go with them."""
    last = events.groupBy("session").agg(F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("events"))
    return last.filter(F.col("last_at") < F.lit(cutoff).cast("timestamp"))


def retain(events: DataFrame, cutoff: str, *, of: DataFrame | None = None) -> DataFrame:
    """Events, or other rows (of) with a session, of the sessions that stay. Rows without a session stay."""
    return (events if of is None else of).join(inactive(events, cutoff).select("session"), "session", "left_anti")


def forget_session(deltas: DataFrame, events: DataFrame, cutoff: str) -> DataFrame:
    """Deltas, all of them, without the name of a session that goes."""
    gone = inactive(events, cutoff).select("session", F.lit(True).alias("_gone"))
    rows = deltas.join(gone, "session", "left")
    return rows.withColumn("session", F.when(F.col("_gone").isNull(), F.col("session"))).select(*deltas.columns)


def bundles(log: DataFrame, *, trajectories: DataFrame | None = None, adjustments: DataFrame | None = None) -> DataFrame:
    """A session's messages in order as one JSON document; export_sessions writes them by session.

    trajectories and adjustments (conv_id, at, …), where given, are lists of their own in a session's document.
    """
    listed = lambda rows, *order: F.array_sort(F.collect_list(F.struct(*order, *[c for c in rows.columns if c not in ("conv_id", *order)])))
    found = log.groupBy("conv_id").agg(listed(log.select("conv_id", "turn", "role", "text"), "turn").alias("messages"), F.count(F.lit(1)).alias("n"))
    parts = ["messages"]
    for name, rows in (("trajectories", trajectories), ("adjustments", adjustments)):
        if rows is not None:
            found, parts = found.join(rows.groupBy("conv_id").agg(listed(rows, "at").alias(name)), "conv_id", "left"), [*parts, name]
    return found.select("conv_id", F.to_json(F.struct(*parts)).alias("bundle"), "n")


def unbundle(bundled: DataFrame) -> DataFrame:
    """The messages of bundles, back as rows."""
    rows = bundled.select("conv_id", F.explode(F.from_json("bundle", "messages array<struct<turn:bigint,role:string,text:string>>")["messages"]).alias("m"))
    return rows.select("conv_id", "m.*")


def listing(bundled: DataFrame, sessions: DataFrame, *, k: int = 100) -> DataFrame:
    """S15 of sessions (conv_id, model, at): the newest bundles of each model."""
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("at"), "conv_id"))
    return bundled.join(sessions, "conv_id").withColumn("place", place).filter(F.col("place") <= k).select("model", "conv_id", "n", "place")


def export_sessions(log: DataFrame, path: str, *, buckets: int = 64, **parts) -> VersionedTable:
    """The sessions of log as bundles in a stored table; sessions that are there already are replaced.

    Only the buckets of these sessions are written; versions before stay readable.
    """
    made, table = bundles(log, **parts), VersionedTable(log.sparkSession, path)
    if not table.versions():
        return VersionedTable.create(path, made, ["conv_id"], buckets=buckets)
    keys = log.select("conv_id").distinct()
    table.update(keys, lambda now: now.join(keys, "conv_id", "left_anti").unionByName(made))
    return table


def import_sessions(table: VersionedTable, of: DataFrame | None = None, *, version: int | None = None) -> DataFrame:
    """The messages of stored sessions, of all or of those (conv_id) asked for, whose buckets alone are read."""
    if of is None:
        return unbundle(table.read(version=version))
    return unbundle(table.read(version=version, buckets=table.touched(of)).join(of.select("conv_id").distinct(), "conv_id", "left_semi"))


def forget_stored(table: VersionedTable, events: DataFrame, cutoff: str, *, key: str = "conv_id") -> None:
    """Stored rows of sessions that are inactive go; only their buckets are rewritten."""
    gone = inactive(events, cutoff).select(F.col("session").alias(key))
    table.update(gone, lambda now: now.join(gone, key, "left_anti"))
