"""Nearest neighbours by inner product through cross-polytope hashing.

A fast pseudo-rotation (random signs and a Hadamard transform, three times) turns each vector, and the signed axis
next to it is its bucket: one of twice the dimension in each of several tables. A query looks into the buckets of its
nearest axes in every table (multiprobe), and what it meets there is ranked by the exact product in double precision.
Where norms differ, one more coordinate first brings all vectors to one norm, so that the largest product has the
smallest angle. Equal vectors are indexed once. Of a class only the k + 1 smallest ids can be among the nearest
(one of them may be the query), so that is all an answer expands. Large buckets are cut into slices for one task each.
A query that met fewer vectors than it asks for is answered by all vectors, slice by slice.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.storage import materialise
from claimgraph.llm.vectors import dimensions, keyed, matrix, packed, unpacked, usable

SLICE_ROWS = 4096


class CrossPolytope:
    def __init__(self, dimension: int, tables: int, seed: int) -> None:
        self.size = 1 << max(0, dimension - 1).bit_length()
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.size))

    def axes(self, x: np.ndarray, table: int, count: int) -> np.ndarray:
        """The nearest signed axes of each row, nearest first: axis, plus size where its sign is minus."""
        turned = np.zeros((len(x), self.size))
        turned[:, : x.shape[1]] = x
        for signs in self.signs[table]:
            turned = turned * signs
            step = 1
            while step < self.size:
                pair = turned.reshape(len(x), -1, 2, step)
                turned = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(x), self.size)
                step *= 2
        return np.argsort(-np.hstack([turned, -turned]), axis=1, kind="stable")[:, :count]


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 20, tables: int = 8, probes: int = 16, seed: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest that each query finds, itself apart.

    score is the inner product of the original vectors in double precision; ties go to the smaller id. Null vectors,
    zero vectors, those with null or non-finite components and rows with a null id neither ask nor answer. Vectors of
    one dimension have an index of their own; a query finds those of its dimension. Rows that share id and vector are
    one. An empty table gives no rows. Other columns are ignored.
    """
    base = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v"), is_query.alias("asks")).filter(usable(vec_col)).filter("vec_id is not null")
    each = [_nearest(base.filter(F.size("v") == d), d, k=k, tables=tables, probes=probes, seed=seed) for d in dimensions(vectors, vec_col)]
    return functools.reduce(DataFrame.unionByName, each)


def _nearest(base: DataFrame, d: int, *, k: int, tables: int, probes: int, seed: int) -> DataFrame:
    """The answer among usable vectors (vec_id, v, asks) of dimension d."""
    base = keyed(base, "v")
    smallest = Window.partitionBy("h1", "h2").orderBy("vec_id")
    listed = base.dropDuplicates(["vec_id", "h1", "h2"]).withColumn("place", F.row_number().over(smallest)).filter(F.col("place") <= k + 1)
    listed = materialise(listed.select("vec_id", "place", "h1", "h2", F.when(F.col("place") == 1, F.col("v")).alias("v")), "ann-members")
    heads = listed.filter("place = 1").select(F.col("vec_id").alias("cls"), "h1", "h2", "v")
    members = listed.join(heads.select("cls", "h1", "h2"), ["h1", "h2"]).select("cls", "vec_id")
    asking = base.filter("asks").select("vec_id", "h1", "h2").distinct().join(heads.select("cls", "h1", "h2"), ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), "cls")
    asking = materialise(asking, "ann-queries")
    sources = heads.join(asking.select("cls").distinct(), "cls", "left_semi").select("cls", "v")

    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    shape = heads.agg(F.max(norm2).alias("most"), F.min(norm2).alias("least")).first()
    level = shape["least"] is None or shape["least"] >= 0.98 * shape["most"]
    most = 0.0 if level else shape["most"]
    hasher = CrossPolytope(d if level else d + 1, tables, seed)
    cells, id_type = hasher.size * 2, heads.schema["cls"].dataType.simpleString()

    def placed(rows: DataFrame, count: int, query: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("v"))
                own = np.array(packed(x), dtype=object)
                if not level:
                    lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))
                    x = np.column_stack([x, lift])
                for table in range(tables):
                    axes = hasher.axes(x, table, count)
                    rows_at = np.repeat(np.arange(len(x)), axes.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(table * cells + axes.ravel(), pa.int32()), batch.column("cls").take(pa.array(rows_at)), pa.array(own[rows_at], pa.binary())], names=["cell", "cls", "v"])

        return rows.mapInArrow(run, f"cell int, cls {id_type}, v binary")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            none = pd.Series([], dtype=object)
            return pd.DataFrame({"query": left["cls"].iloc[:0], "ids": none, "scores": none})
        q, x, ids = unpacked(left["v"]), unpacked(right["v"]), right["cls"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        x, ids = x[by_id], ids[by_id]
        # the product of matrices may be off by its rounding, which grows with the norms
        slack = 1e-12 * np.sqrt((q * q).sum(axis=1) * (x * x).sum(axis=1).max()) + 1e-12
        rough, found, scores = q @ x.T, [], []
        for i in range(len(q)):
            few = np.arange(len(x)) if len(x) <= k + 1 else np.flatnonzero(rough[i] >= np.partition(rough[i], -k - 1)[-k - 1] - slack[i])
            exact = (q[i] * x[few]).sum(axis=1)
            top = np.argsort(-exact, kind="stable")[: k + 1]
            found.append(ids[few[top]])
            scores.append(exact[top])
        return pd.DataFrame({"query": left["cls"].to_numpy(), "ids": found, "scores": scores})

    def answered(index: DataFrame, questions: DataFrame) -> DataFrame:
        slices = index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias("slices"))
        cut = index.join(slices, "cell").withColumn("slice", F.expr("cast(pmod(xxhash64(cls), slices) as int)")).drop("slices")
        spread = questions.join(slices, "cell").withColumn("slice", F.expr("explode(sequence(0, slices - 1))")).drop("slices")
        met = spread.groupBy("cell", "slice").cogroup(cut.groupBy("cell", "slice")).applyInPandas(best, f"query {id_type}, ids array<{id_type}>, scores array<double>")
        met = met.select("query", F.explode(F.arrays_zip("ids", "scores")).alias("f")).select("query", F.col("f.ids").alias("cls"), F.col("f.scores").alias("score")).groupBy("query", "cls").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "cls")
        return met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1).drop("place")

    def expanded(found: DataFrame) -> DataFrame:
        each = found.join(members, "cls")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        return each.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1).select("query", "vec_id", "score")

    met = materialise(expanded(answered(placed(heads.select("cls", "v"), 1, False), placed(sources, probes, True))), "ann-found")
    there = min(k + 1, listed.limit(k + 1).count())
    full = met.groupBy("query").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= there).select(F.col("query").alias("cls"))
    short = materialise(sources.join(full, "cls", "left_anti"), "ann-short")
    if not short.isEmpty():
        whole = lambda rows: _bytes(rows, id_type)
        again = expanded(answered(whole(heads.select("cls", "v")), whole(short)))
        met = met.join(short.select(F.col("cls").alias("query")), "query", "left_anti").unionByName(again)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    result = asking.join(met.withColumnRenamed("query", "cls"), "cls").filter("vec_id != query_id").withColumn("rank", F.row_number().over(order))
    return result.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _bytes(rows: DataFrame, id_type: str) -> DataFrame:
    """All rows in one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([-1] * len(batch), pa.int32()), batch.column("cls"), pa.array(packed(matrix(batch.column("v"))), pa.binary())], names=["cell", "cls", "v"])

    return rows.mapInArrow(run, f"cell int, cls {id_type}, v binary")
