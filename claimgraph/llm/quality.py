"""Quality classifier: a sparse ensemble of rules over statistics of the whole text.

Small boosted trees are grown on labelled rows; every path from a root to a node is a rule, a conjunction of bounds on
statistics. A logistic model with an L1 penalty over all rules keeps a few. The kept rules are compiled into one Spark
column expression over the statistics, so that scoring is a scan. Statistics come from the UTF-8 bytes of whole
Arrow batches. Only the fit sees a sample: about ``most_rows`` labelled rows at most, chosen by a hash of their id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgraph.functions.storage import materialise
from claimgraph.llm.columns import WordHasher, chunks, named, text_bytes, word_spans


def _bytes(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_CLASSES = {
    "upper": _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "lower": _bytes("abcdefghijklmnopqrstuvwxyz"), "digit": _bytes("0123456789"), "stop": _bytes(".?"), "comma": _bytes(",;:"),
    "shout": _bytes("!"), "symbol": _bytes("#$%&*+=<>@^_~\\/"), "bar": _bytes("|"), "quote": _bytes("\"'`()[]{}"), "space": _bytes(" \t"), "line": _bytes("\n"),
}
_BLANK = _bytes(" \t\n\x0b\x0c\r")
_SHARES = [f"share_{c}" for c in _CLASSES]
STATISTICS = ["log_bytes", "log_words", "log_lines", "mean_word", "longest_word", *_SHARES, "share_high", "distinct_words", "top_word", "repeats", "distinct_pairs", "distinct_lines"]
PREFIX = "_stat_"


def _per_text(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (sums[at[1:]] - sums[at[:-1]]).astype(float)


def statistics(column: pa.Array, hasher: WordHasher) -> np.ndarray:
    """A row of STATISTICS for each text; shares are of bytes, words or lines, and 0 for an empty text."""
    data, at = text_bytes(column)
    out = []
    for _, _, part, off in chunks(data, at):
        size = np.diff(off).astype(float)
        whole = np.maximum(size, 1)
        shares = [_per_text(table[part], off) / whole for table in _CLASSES.values()]
        lines = shares[-1] * whole + (size > 0)
        high = _per_text(part >= 0x80, off) / whole
        starts, ends, first = word_spans(part, off)
        hashes, length = hasher(part, starts, ends), ends - starts
        words = np.diff(first).astype(float)
        of_words = np.zeros((len(size), 6))
        for i in range(len(size)):
            a, b = first[i], first[i + 1]
            if a == b:
                continue
            h = hashes[a:b]
            _, times = np.unique(h, return_counts=True)
            pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
            text = part[off[i] : off[i + 1]].tobytes()
            lines_here = text.split(b"\n")
            of_words[i] = (
                length[a:b].max(), len(times) / (b - a), times.max() / (b - a), (h[1:] == h[:-1]).mean() if b - a > 1 else 0, len(np.unique(pairs)) / max(1, len(pairs)), len(set(lines_here)) / len(lines_here),
            )
        mean_word = _per_text(~_BLANK[part], off) / np.maximum(words, 1)
        out.append(np.column_stack([np.log1p(size), np.log1p(words), np.log1p(lines), mean_word, np.log1p(of_words[:, 0]), *shares, high, *of_words[:, 1:].T]))
    return np.vstack(out) if out else np.zeros((0, len(STATISTICS)))


def with_statistics(rows: DataFrame, text_col: str = "text", *, keep_text: bool = True, prefix: str = PREFIX) -> DataFrame:
    """rows with a column prefix + name for each statistic of the text."""
    at = rows.columns.index(text_col)
    # inside, columns go by number: names may hold dots
    kept = [i for i in range(len(rows.columns)) if keep_text or i != at]
    schema = T.StructType([*[T.StructField(f"c{i}", rows.schema[i].dataType) for i in kept], *[T.StructField(s, T.DoubleType()) for s in STATISTICS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            found = statistics(batch.column(at), hasher)
            columns = [batch.column(i) for i in kept] + [pa.array(np.ascontiguousarray(found[:, k])) for k in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    numbered = rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))
    return numbered.mapInArrow(run, schema).toDF(*(rows.columns[i] for i in kept), *(prefix + s for s in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """Bounds (statistic, whether above, threshold) that must all hold, and the weight if they do."""

    bounds: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(x[:, f] > t) == above for f, above, t in self.bounds])

    def column(self, prefix: str = PREFIX) -> Column:
        test = F.lit(True)
        for f, above, t in self.bounds:
            value = F.col(prefix + STATISTICS[f])
            test = test & (value > t if above else value <= t)
        return F.when(test, F.lit(self.weight)).otherwise(0.0)


def _grow(x: np.ndarray, cuts: list[np.ndarray], bins: np.ndarray, gradient: np.ndarray, rows: np.ndarray, depth: int, path: tuple, least: int, rules: list[Rule], out: np.ndarray) -> None:
    """Splits rows by the largest fall in squared error of the gradient; each node's path joins rules."""
    if path:
        rules.append(Rule(path))
    best = (1e-9, None)
    if depth and len(rows) >= 2 * least:
        total = gradient[rows].sum()
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            n = np.cumsum(np.bincount(bins[rows, f], minlength=len(cut) + 1))[:-1]
            s = np.cumsum(np.bincount(bins[rows, f], weights=gradient[rows], minlength=len(cut) + 1))[:-1]
            m = len(rows) - n
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((n >= least) & (m >= least), s**2 / n + (total - s) ** 2 / m - total**2 / len(rows), 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (f, k))
    if best[1] is None:
        out[rows] = gradient[rows].mean() if len(rows) else 0.0
        return
    f, k = best[1]
    below = bins[rows, f] <= k
    for above, part in ((False, rows[below]), (True, rows[~below])):
        _grow(x, cuts, bins, gradient, part, depth - 1, (*path, (f, above, float(cuts[f][k]))), least, rules, out)


def fit_rules(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, penalty: float = 2e-3, steps: int = 400, seed: int = 11) -> tuple[float, list[Rule]]:
    """(intercept, rules with non-zero weights). Labels of one kind, or none at all, give no rules."""
    rate = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = math.log(rate / (1 - rate))
    if len(y) < 20 or y.min() == y.max():
        return base, []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 33), method="lower")) for f in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    rng, margin, rules = np.random.default_rng(seed), np.full(len(y), base), []
    for _ in range(trees):
        gradient, step = y - 1 / (1 + np.exp(-margin)), np.zeros(len(y))
        part = rng.permutation(len(y))[: max(20, len(y) * 3 // 4)]
        _grow(x, cuts, bins, gradient, part, depth, (), max(5, len(y) // 400), rules, step)
        margin += 2.0 * step
    rules = list(dict.fromkeys(rules))
    held = np.column_stack([r.holds(x) for r in rules]).astype(float)
    spread = held.std(axis=0)
    rules, held, spread = [r for r, s in zip(rules, spread, strict=True) if s > 0], held[:, spread > 0], spread[spread > 0]
    if not rules:
        return base, []
    z = (held - held.mean(axis=0)) / spread
    size = np.linalg.norm(z, 2) ** 2 / (4 * len(y))
    w, b, ahead, ahead_b, t = np.zeros(len(rules)), base, np.zeros(len(rules)), base, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(z @ ahead + ahead_b))) - y
        new = ahead - z.T @ error / len(y) / size
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / size, 0)
        new_b = ahead_b - 4 * error.mean()
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    weights = w / spread
    return float(b - (w * held.mean(axis=0) / spread).sum()), [Rule(r.bounds, float(v)) for r, v in zip(rules, weights, strict=True) if v]


def score_column(intercept: float, rules: list[Rule], prefix: str = PREFIX) -> Column:
    """The probability of a good label, of the statistics' columns."""
    return F.lit(1.0) / (F.exp(-sum((r.column(prefix) for r in rules), F.lit(intercept))) + 1)


def learn(described: DataFrame, labels: DataFrame, *, most_rows: int = 20_000, id_col: str = "doc_id") -> tuple[float, list[Rule]]:
    """Fits rules to rows of described (ids and statistics) that labels (doc_id, quality) names; null labels don't count.

    An id whose labels contradict each other teaches nothing; one with several texts teaches by one of them, that of the
    smallest statistics. Above most_rows labelled ids, those with the smallest hashes make the sample: never more rows
    than that reach the driver.
    """
    truth = labels.filter("quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_y"), F.max("quality").alias("_most")).filter("_y = _most").select("_id", F.col("_y").cast("double").alias("_y"))
    names = [PREFIX + s for s in STATISTICS]
    both = described.join(truth, F.col(id_col) == F.col("_id")).groupBy("_id", "_y").agg(F.min(F.struct(*names)).alias("_s"))
    both = materialise(both.select("_id", "_y", "_s.*"), "quality-labelled")
    n, drawn = both.count(), F.pmod(F.xxhash64("_id"), F.lit(1 << 20))
    if n > most_rows:
        both = both.filter(drawn <= int((1 << 20) * most_rows / n * 1.2) + 64).orderBy(drawn, "_id").limit(most_rows)
    found = both.orderBy("_id").toPandas()
    return fit_rules(found[names].to_numpy(float), found["_y"].to_numpy(float))


def score(documents: DataFrame, labels: DataFrame, *, learns_from: Column | None = None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row of documents, from its text alone.

    learns_from tells by doc_id which rows labels may be learned of. A null or empty text has the statistics of no
    bytes, and is scored by them. A null id is never learned from. Repeated rows are scored alike. An empty table
    gives no rows; without labels the score is one half. Other columns are ignored.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    described = materialise(with_statistics(rows, keep_text=False), "quality-statistics")
    intercept, rules = learn(described if learns_from is None else described.filter(learns_from), labels)
    scored = described.select("doc_id", score_column(intercept, rules).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, *, learns_from: Column | None = None, threshold: float = 0.7) -> DataFrame:
    """documents whose score reaches the threshold, with their own columns. Texts are scanned twice and never shuffled.

    Null and empty texts, repeated rows and null ids are scored as by score; columns may have any names.
    """
    prefix = PREFIX
    while any(c.lower().startswith(prefix) for c in documents.columns):
        prefix = "_" + prefix
    described = materialise(with_statistics(documents.select("doc_id", "text"), keep_text=False), "quality-statistics")
    intercept, rules = learn(described if learns_from is None else described.filter(learns_from), labels)
    return with_statistics(documents, prefix=prefix).filter(score_column(intercept, rules, prefix) >= threshold).select(*named(documents))
