"""Near-duplicate vectors through a pivot-permutation index.

A bounded sample of vectors are the pivots, less those close to another pivot: however many vectors a group of near
copies holds, few pivots stand within it, so its members name the same ones. Each vector is described by its nearest
pivots in order; an inverted list for each label and pivot holds the vectors that name it. Two vectors of a list become
candidates when their descriptions share enough pivots, and are verified by their exact cosine. A pair is looked at only
in the list of the smallest pivot that they share, so links can be counted without writing pairs down: a list gives, for
each vector, how many links it has there and one edge towards its smallest linked vector. Equal vectors of a label are
one entry with a weight. Long lists are cut into blocks, and block pairs are tasks of their own.

Where lists of single pivots would grow long, they are lists of pairs of pivots: vectors that share two pivots share
such a list, so the same pairs of vectors are looked at, in lists as many times shorter as there are pivots.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.storage import materialise
from claimgraph.llm.vectors import dimensions, keyed, matrix, packed, unpacked, usable
from claimgraph.operators.components import connected_components

BLOCK_ROWS = 1024
#: Lists of single pivots that are longer than this, on average, become lists of two.
LONG_LIST = 1 << 16
#: Pivots have a cosine below this with each other.
APART = 0.7


def pivots_for(n: int) -> int:
    """Pivots for n vectors: one for 200, from 128 to 4,096."""
    return min(4096, max(128, n // 200))


def spread(picked: np.ndarray) -> np.ndarray:
    """Those unit rows that lie apart from all rows taken before them."""
    taken = np.zeros_like(picked)
    n = 0
    for row in picked:
        if not n or (taken[:n] @ row).max() < APART:
            taken[n] = row
            n += 1
    return taken[:n]


def near_duplicates(vectors: DataFrame, *, least: float = 0.93, nearest: int = 8, shared: int = 2, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors.

    Vectors of one non-null label link when their cosine in double precision is at least ``least`` and the index finds
    them: no link is below it, some may be missed. Vectors of different dimensions don't link; those of one dimension have
    pivots of their own. Null and zero vectors, those with null or non-finite components, and rows with a null label or
    id link with nothing: no links, themselves as component (null for a null id). Repeated rows are vectors of their
    own. An empty table gives no rows. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v"), F.col(label_col).alias("label"))
    rows = rows.withColumn("fit", usable("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    first, *more = dimensions(vectors, vec_col)
    size = F.when(F.col("fit"), F.size("v")).otherwise(first)  # those that link with nothing go with the first
    parts = [rows.filter(size == d) for d in (first, *more)] if more else [rows]
    return functools.reduce(DataFrame.unionByName, [_near_duplicates(part, least=least, nearest=nearest, shared=shared, seed=seed) for part in parts])


def _near_duplicates(rows: DataFrame, *, least: float, nearest: int, shared: int, seed: int) -> DataFrame:
    """The answer for rows (vec_id, v, label, fit) whose fit vectors are of one dimension."""
    rows = keyed(rows, "v")
    same = ["label", "h1", "h2"]
    classes = rows.filter("fit").groupBy(*same).agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("weight"))
    heads = rows.filter("fit").join(classes.withColumnRenamed("cls", "vec_id"), ["vec_id", *same]).dropDuplicates(["vec_id", *same])
    heads = materialise(heads.select(F.col("vec_id").alias("cls"), "label", "weight", "v"), "pivot-heads")
    n = heads.count()
    picked = heads.orderBy(F.xxhash64(F.lit(seed), "cls"), "cls").limit(pivots_for(n)).select("v").toPandas()
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = spread(unit(np.array(picked["v"].tolist(), np.float64))) if len(picked) else np.zeros((0, 1))
    needed = min(shared, len(centres))
    by_two = needed >= 2 and n * nearest / len(centres) > LONG_LIST
    id_type, label_type = (heads.schema[c].dataType.simpleString() for c in ("cls", "label"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column("v")))
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :nearest].astype(np.int32)
            lists = near.astype(np.int64)
            if by_two:
                low, high = np.triu_indices(near.shape[1], 1)
                first, second = np.minimum(lists[:, low], lists[:, high]), np.maximum(lists[:, low], lists[:, high])
                lists = first << 32 | second
            at = np.repeat(np.arange(len(x)), lists.shape[1])
            take = pa.array(at)
            own, names = np.array(packed(x), dtype=object), np.array([r.tobytes() for r in near], dtype=object)
            columns = [batch.column(c).take(take) for c in ("label", "cls", "weight")]
            yield pa.RecordBatch.from_arrays([pa.array(lists.ravel(), pa.int64()), *columns, pa.array(names[at], pa.binary()), pa.array(own[at], pa.binary())], names=["list", "label", "cls", "weight", "names", "v"])

    index = materialise(heads.mapInArrow(describe, f"list long, label {label_type}, cls {id_type}, weight long, names binary, v binary"), "pivot-index")
    blocks = index.groupBy("label", "list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"), F.count(F.lit(1)).alias("size"))
    cut = index.join(blocks.filter("size > 1").drop("size"), ["label", "list"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        last = int(part["list"].iloc[0]) & 0xFFFFFFFF
        x, ids, weight, block = unpacked(part["v"]), part["cls"].to_numpy(), part["weight"].to_numpy(), part["block"].to_numpy()
        linked = x @ x.T >= least
        np.fill_diagonal(linked, False)
        if part["low"].iloc[0] != part["high"].iloc[0]:
            linked &= block[:, None] != block[None]
        touched = np.flatnonzero(linked.any(axis=1))
        if not len(touched):
            return pd.DataFrame({"cls": ids[:0], "to": ids[:0], "links": weight[:0]})
        links, ids = linked[np.ix_(touched, touched)], ids[touched]
        named, at = np.unique(np.frombuffer(b"".join(part["names"].iloc[touched]), np.int32), return_inverse=True)
        names = np.zeros((len(touched), len(named)), np.float32)
        np.put_along_axis(names, at.reshape(len(touched), -1), 1.0, axis=1)
        lower = names[:, : np.searchsorted(named, last)]
        links &= (names @ names.T >= needed) & (lower @ lower.T == (1 if by_two else 0))
        return pd.DataFrame({"cls": ids, "to": _towards(links, ids), "links": links @ weight[touched]})

    found = cut.groupBy("label", "list", "low", "high").applyInPandas(compare, f"cls {id_type}, to {id_type}, links long")
    found = materialise(found, "pivot-links")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("cls").alias("a"), F.col("to").alias("b")))
    known = classes.join(counts, "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    known = known.select(*same, (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component"))
    out = rows.select("vec_id", "fit", *same).join(known.withColumn("fit", F.lit(True)), ["fit", *same], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _towards(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each vector the smallest id of its component within the list."""
    at = ids.copy()
    while True:
        lower = np.minimum(at, np.where(links, at[None], at.max()).min(axis=1))
        if (lower == at).all():
            return at
        at = lower
