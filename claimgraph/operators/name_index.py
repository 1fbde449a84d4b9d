"""Search of names through a trigram index with posting lists.

The index is a stored table of (gram, id), in buckets by gram, for all runs of three characters of all names. A pattern's
literal parts have runs of three as well, and a name that matches holds all of them: only the buckets of these grams are
read, their lists are intersected by counting, and the pattern is checked on the names that are left. A pattern without
a literal part of three characters looks at all names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.functions.versioned import VersionedTable
from claimgraph.operators.graph import degrees


def grams_of(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def literal_grams(pattern: str) -> set[str]:
    """Trigrams that every text like the pattern holds; a backslash takes the next character as it is."""
    parts, i = [""], 0
    while i < len(pattern):
        if pattern[i] == "\\" and i + 1 < len(pattern):
            parts[-1] += pattern[i + 1]
            i += 1
        elif pattern[i] in "%_":
            parts.append("")
        else:
            parts[-1] += pattern[i]
        i += 1
    return set().union(*map(grams_of, parts))


class NameIndex:
    """Names (id, name, …) and their trigrams at a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.names, self.postings = VersionedTable(spark, f"{path.rstrip('/')}/names"), VersionedTable(spark, f"{path.rstrip('/')}/grams")

    @staticmethod
    def _grams(names: DataFrame) -> DataFrame:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("name") - 2))
        each = names.select("id", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("name", i, 3)))).alias("gram"))
        return each.filter(F.char_length("gram") == 3).select("gram", "id")

    @classmethod
    def create(cls, path: str, names: DataFrame, *, buckets: int = 64) -> "NameIndex":
        index = cls(names.sparkSession, path)
        VersionedTable.create(index.names.path, names, ["id"], buckets=buckets)
        VersionedTable.create(index.postings.path, cls._grams(names), ["gram"], buckets=buckets)
        return index

    def matches(self, pattern: str) -> DataFrame:
        """The names like the pattern."""
        grams = sorted(literal_grams(pattern))
        if not grams:
            return self.names.read().filter(F.col("name").like(pattern))
        spark = self.names.spark
        asked = spark.createDataFrame([(g,) for g in grams], "gram string")
        lists = self.postings.read(buckets=self.postings.touched(asked)).filter(F.col("gram").isin(grams))
        ids = lists.groupBy("id").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams)).select("id")
        return self.names.read().join(ids, "id", "left_semi").filter(F.col("name").like(pattern))

    def search(self, edges: DataFrame, pattern: str, *, k: int = 20) -> DataFrame:
        """As graph.search: names like the pattern, best connected first, then by rho."""
        rows = self.matches(pattern).join(degrees(edges), F.col("id") == F.col("node"), "left")
        return rows.select("id", "name", F.coalesce("degree", F.lit(0)).alias("degree"), "rho").orderBy(F.desc("degree"), F.desc("rho"), "id").limit(k)
