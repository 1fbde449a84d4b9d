"""Joins of vectors by cosine, leaders of similar items, and resolution of names.

The exact join partitions unit vectors by angle. Pivots are drawn from the table; a vector lies in the cell of its
nearest pivot and there in a ring by its angle to it, and a block is a piece of a ring that one task can hold. Of each
block the least and the largest angle to every pivot is known. By the triangle inequality two blocks hold no pair within
the threshold if, for some pivot, their ranges of angles lie further apart than that; such pairs of blocks are skipped,
all others are compared as matrices. Vectors of different dimensions never meet.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.storage import materialise
from claimgraph.operators.components import connected_components

#: Rows of a block, pivots of a dimension at most, rings of a cell, and parts in which blocks meet blocks.
BLOCK_ROWS, PIVOTS, RINGS, SALTS = 2048, 48, 4, 64
#: Blocks grow with the largest part until there are so many of them or they have so many rows: what is shuffled is rows by blocks.
BLOCKS, MOST_BLOCK_ROWS, TILE_ROWS = 32, 32768, 512
#: Angles are off by less than this.
SLACK = 1e-6


def _unit(column: pd.Series) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in column])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """Vectors whose components are numbers, none of them infinite; there is one at least."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)


def _pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """Of each dimension some unit vectors, one in a hash order for so many rows: PIVOTS of a dimension at most."""
    place = F.row_number().over(Window.partitionBy("dimension").orderBy("_drawn"))
    drawn = rows.select(F.size("embedding").alias("dimension"), "embedding", F.xxhash64(F.lit(11), "id").alias("_drawn")).withColumn("_place", place).filter(F.col("_place") <= PIVOTS)
    found = drawn.toPandas()
    return {int(d): _unit(part["embedding"]) for d, part in found.groupby("dimension")}


def angle_blocks(vectors: DataFrame, within: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, blocks): usable vectors with the part and the block that they fall into, and each block's range of angles.

    part is the value of ``within`` and the dimension, block a number within the part; lows and highs are the least and
    the largest angles to each pivot.
    """
    rows = usable_vectors(vectors).select("id", "embedding", (F.col(within) if within else F.lit(0)).alias("within")).filter("within is not null")
    rows = materialise(rows, "angle-vectors")
    pivots, part_type = _pivots(rows), rows.schema["within"].dataType.simpleString()
    id_type = rows.schema["id"].dataType.simpleString()
    # as many cells as the largest part of a dimension fills blocks, and rings where cells would hold several
    parts = rows.groupBy("within", F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    largest = {r["d"]: r["n"] for r in parts.groupBy("d").agg(F.max("n").alias("n")).collect()}
    block_rows = {d: max(BLOCK_ROWS, min(n // BLOCKS, MOST_BLOCK_ROWS)) for d, n in largest.items()}
    wanted = {d: -(-n // block_rows[d]) for d, n in largest.items()}
    cells = {d: max(1, min(len(p), wanted[d])) for d, p in pivots.items()}
    rings = {d: RINGS if wanted[d] > len(p) else 1 for d, p in pivots.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.to_pandas()
            for d, part in found.groupby(found["embedding"].map(len)):
                x = _unit(part["embedding"])
                angles = np.arccos(np.clip(x @ pivots[d].T, -1, 1))
                near = angles[:, : cells[d]]
                cell, n = near.argmin(axis=1), rings[d]
                ring = np.minimum((near.min(axis=1) * (2 * n / math.pi)).astype(int), n - 1)
                take = pa.array(part.index.to_numpy())
                columns = [batch.column("id").take(take), pa.array([r.tobytes() for r in x], pa.binary()), batch.column("within").take(take), pa.array(np.full(len(x), d, np.int32)), pa.array((cell * n + ring).astype(np.int32)), pa.array([r.tobytes() for r in angles.astype(np.float32)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "unit", "within", "dimension", "ring", "angles"])

    placed = materialise(rows.mapInArrow(place, f"id {id_type}, unit binary, within {part_type}, dimension int, ring int, angles binary"), "angle-rings")
    sizes = placed.groupBy("within", "dimension", "ring").agg(F.count(F.lit(1)).alias("n"))
    of_block = F.coalesce(F.create_map(*(F.lit(v) for pair in block_rows.items() for v in pair))[F.col("dimension")], F.lit(BLOCK_ROWS)) if block_rows else F.lit(BLOCK_ROWS)
    sizes = sizes.withColumn("pieces", F.ceil(F.col("n") / of_block).cast("int")).drop("n")
    block = (F.col("ring").cast("long") * (1 << 32)) + F.expr("pmod(xxhash64(id), pieces)")
    placed = placed.join(sizes, ["within", "dimension", "ring"]).withColumn("block", block)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.to_pandas()
            out = []
            for (w, d, b), part in found.groupby(["within", "dimension", "block"]):
                angles = np.frombuffer(b"".join(part["angles"]), np.float32).reshape(len(part), -1)
                out.append((w, d, b, angles.min(axis=0).tolist(), angles.max(axis=0).tolist()))
            w, d, b, low, high = zip(*out) if out else ((),) * 5
            floats = pa.list_(pa.float32())
            yield pa.RecordBatch.from_arrays([pa.array(w, batch.schema.field("within").type), pa.array(d, pa.int32()), pa.array(b, pa.int64()), pa.array(low, floats), pa.array(high, floats)], names=["within", "dimension", "block", "low", "high"])

    parts = placed.select("within", "dimension", "block", "angles").mapInArrow(ranges, f"within {part_type}, dimension int, block long, low array<float>, high array<float>")
    each = parts.select("within", "dimension", "block", F.posexplode(F.arrays_zip("low", "high")).alias("p", "r"))
    each = each.groupBy("within", "dimension", "block", "p").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high"))
    ordered = F.array_sort(F.collect_list(F.struct("p", "low", "high")))
    blocks = each.groupBy("within", "dimension", "block").agg(ordered.alias("r")).select("within", "dimension", "block", F.col("r.low").alias("lows"), F.col("r.high").alias("highs"))
    return placed.select("within", "dimension", "block", "id", "unit"), blocks


def block_pairs(blocks: DataFrame, least: float) -> DataFrame:
    """Pairs x <= y of blocks of a part that may hold two vectors of a cosine of ``least``, with that bound's angle.

    blocks may have a column ``bound``: then a pair is kept if it reaches the smaller bound of its two blocks.
    """
    keys = ["within", "dimension"]
    rows = blocks if "bound" in blocks.columns else blocks.withColumn("bound", F.lit(float(least)))
    x, y = rows.select(*keys, F.col("block").alias("x"), F.struct("lows", "highs", "bound").alias("a")), rows.select(*keys, F.col("block").alias("y"), F.struct("lows", "highs", "bound").alias("b"))
    far = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.least("a.bound", "b.bound")))) + SLACK
    gap = lambda p: F.greatest(p["lows1"] - p["highs2"], p["lows2"] - p["highs1"])
    ranges = F.arrays_zip(F.col("a.lows").alias("lows1"), F.col("a.highs").alias("highs1"), F.col("b.lows").alias("lows2"), F.col("b.highs").alias("highs2"))
    salted = y.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = x.withColumn("_salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"])
    return met.filter("x <= y").filter(~F.exists(ranges, lambda p: gap(p) > far)).select(*keys, "x", "y")


def _compared(rows: DataFrame, pairs: DataFrame, compare, schema: str) -> DataFrame:
    """compare on the rows of each pair of blocks, as one table with a column ``block``."""
    keys = ["within", "dimension", "block"]
    sides = pairs.select("within", "dimension", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    return rows.join(sides, keys).groupBy("within", "dimension", "x", "y").applyInPandas(compare, schema)


def _tiles(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Of a pair of blocks: all ids, and tile by tile the cosines of some rows with others and where both begin.

    Two blocks are compared with each other alone; within one block the cosines not of pairs i < j are -inf.
    """
    part = pd.concat(parts, ignore_index=True).sort_values(["block", "id"], ignore_index=True)
    ids, x = part["id"].to_numpy(), np.frombuffer(b"".join(part["unit"]), np.float64).reshape(len(part), -1)
    single = part["x"].iloc[0] == part["y"].iloc[0]
    cut = len(part) if single else int((part["block"] == part["block"].iloc[0]).sum())
    del part
    for i in range(0, cut, TILE_ROWS):
        rows = x[i : min(i + TILE_ROWS, cut)]
        for j in range(i if single else cut, len(x), MOST_BLOCK_ROWS // 8):
            cosine = rows @ x[j : j + MOST_BLOCK_ROWS // 8].T
            if single:
                cosine[np.arange(i, i + len(rows))[:, None] >= np.arange(j, j + cosine.shape[1])[None]] = -np.inf
            yield ids, cosine, i, j


def _pairs_of(id_type: str, least: float):
    """(compare, schema) that gives the pairs of two blocks that reach ``least``, tile by tile."""

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, cosine, i, j in _tiles(parts):
            r, c = np.nonzero(cosine >= least)
            a, b = ids[i + r], ids[j + c]
            yield pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "similarity": cosine[r, c]})

    return compare, f"a {id_type}, b {id_type}, similarity double"


def _pairs_above(id_type: str):
    """(compare, schema) that gives the pairs of two blocks that reach the bound (kth) of either end, tile by tile."""

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = pd.concat(parts, ignore_index=True)
        kth, bound = part.drop_duplicates("id").set_index("id")["kth"], None
        for ids, cosine, i, j in _tiles(iter([part])):
            bound = kth.reindex(ids).to_numpy() if bound is None else bound
            n, m = cosine.shape
            r, c = np.nonzero(cosine >= np.minimum(bound[i : i + n, None], bound[None, j : j + m]))
            a, b = ids[i + r], ids[j + c]
            yield pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "similarity": cosine[r, c]})

    return compare, f"a {id_type}, b {id_type}, similarity double"


def cosine_components(vectors: DataFrame, least: float) -> DataFrame:
    """J8 of (id, embedding): (node, component) of all vectors that a pair of cosine_join holds.

    A pair of blocks gives only as many of its pairs as connect the same vectors, fewer than it has rows.
    """
    rows, blocks = angle_blocks(vectors)
    id_type = rows.schema["id"].dataType.simpleString()

    def forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = None
        for ids, cosine, i, j in _tiles(parts):
            group = np.arange(len(ids)) if group is None else group
            near, a, b = cosine >= least, [], []
            for r in np.flatnonzero(near.any(axis=1)):
                found = j + np.flatnonzero(near[r])
                others, first = np.unique(group[found], return_index=True)
                for other, f in zip(others, found[first], strict=True):
                    if other != group[i + r]:
                        group[group == other] = group[i + r]
                        a.append(ids[i + r])
                        b.append(ids[f])
            yield pd.DataFrame({"a": np.array(a, ids.dtype), "b": np.array(b, ids.dtype)})

    return connected_components(_compared(rows, block_pairs(blocks, least), forest, f"a {id_type}, b {id_type}"))


def cosine_join(vectors: DataFrame, least: float, *, within: str | None = None) -> DataFrame:
    """(a, b, similarity) for all pairs a < b of (id, embedding) whose cosine is at least ``least``.

    With ``within``, pairs of one value of that column; rows where it is null have no pairs.
    """
    rows, blocks = angle_blocks(vectors, within)
    id_type = rows.schema["id"].dataType.simpleString()
    return _compared(rows, block_pairs(blocks, least), *_pairs_of(id_type, least))


def top_similar(vectors: DataFrame, existing: DataFrame, *, least: float = 0.6, k: int = 20) -> DataFrame:
    """New edges between similar concepts: a pair counts if it is among either end's k best and has no edge yet.

    Blocks are first compared with themselves. The k-th best that each vector finds there bounds what it may still want:
    a block's bound is the least of its vectors', and pairs of blocks that reach neither's bound are skipped. Of the others
    only pairs that reach the bound of either end come out, about k of a vector for each block. Edges that are there
    already don't count among the k.
    """
    rows, blocks = angle_blocks(vectors)
    rows, id_type = materialise(rows, "similar-rows"), rows.schema["id"].dataType.simpleString()
    known = existing.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    best, pair = _pairs_of(id_type, least)

    def kept(pairs: DataFrame) -> DataFrame:
        ends = pairs.join(known, ["a", "b"], "left_anti").select("a", "b", "similarity", F.explode(F.array("a", "b")).alias("end"))
        place = F.row_number().over(Window.partitionBy("end").orderBy(F.desc(F.round("similarity", 9)), "a", "b"))
        return ends.withColumn("place", place).filter(F.col("place") <= k)

    own = materialise(kept(_compared(rows, blocks.select("within", "dimension", F.col("block").alias("x"), F.col("block").alias("y")), best, pair)), "similar-own")
    # ties at the ninth digit are decided by ids: the bound stays below them
    kth = own.filter(F.col("place") == k).select(F.col("end").alias("id"), (F.col("similarity") - 1e-8).alias("kth"))
    rows = materialise(rows.join(kth, "id", "left").withColumn("kth", F.greatest(F.lit(float(least)), F.coalesce("kth", F.lit(float(least))))), "similar-bounded")
    bounds = rows.groupBy("within", "dimension", "block").agg(F.min("kth").alias("bound"))
    others = block_pairs(blocks.join(bounds, ["within", "dimension", "block"]), least).filter("x < y")
    met = _compared(rows, others, *_pairs_above(id_type)).unionByName(own.select("a", "b", "similarity")).dropDuplicates(["a", "b"])
    return kept(met).select("a", "b", F.round("similarity", 4).alias("similarity")).distinct()


def cosine_join_hashed(vectors: DataFrame, least: float, *, tables: int = 8, bucket: float | None = None, seed: int = 7) -> DataFrame:
    """J2 for tables too large for all pairs: pairs that share a bucket of random projections, checked exactly.

    Of unit vectors the distance is sqrt(2 - 2 cosine). No pair below ``least`` comes out; some above it may be missed,
    fewer with more tables and wider buckets.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    rows = usable_vectors(vectors).withColumn("_norm", norm).filter("_norm > 0").select("id", F.size("embedding").alias("_d"), array_to_vector(F.transform("embedding", lambda x: x / F.col("_norm"))).alias("unit"))
    rows, far = materialise(rows, "hashed-vectors"), (2 - 2 * least) ** 0.5
    similarity, found = 1 - F.col("far") * F.col("far") / 2, []
    for (d,) in rows.select("_d").distinct().collect() or [(1,)]:
        own = rows.filter(F.col("_d") == d)
        model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=bucket or 2 * far, numHashTables=tables, seed=seed).fit(own)
        pairs = model.approxSimilarityJoin(own, own, far + 1e-9, distCol="far").filter("datasetA.id < datasetB.id")
        found.append(pairs.select(F.col("datasetA.id").alias("a"), F.col("datasetB.id").alias("b"), similarity.alias("similarity")).filter(F.col("similarity") >= least))
    return functools.reduce(DataFrame.unionByName, found)


def nearest_to(vectors: DataFrame, asked: DataFrame, *, k: int = 5, least: float = 0.0) -> DataFrame:
    """For each asked (query, embedding), the k most similar other rows (id), then those that reach ``least``.

    Vectors of different dimensions don't meet. Both sides are cut into blocks; a task compares two blocks as matrices and keeps k rows for each query, so what is
    shuffled on is k rows for each query and block, however many are asked.
    """
    both = usable_vectors(vectors.select(F.lit(0).alias("side"), "id", "embedding").unionByName(asked.select(F.lit(1).alias("side"), F.col("query").alias("id"), "embedding")))
    both = both.withColumn("dimension", F.size("embedding"))
    blocks = both.groupBy("dimension").agg(*[F.greatest(F.lit(1), F.ceil(F.count_if(F.col("side") == s) / BLOCK_ROWS)).cast("int").alias(f"n{s}") for s in (0, 1)])
    cut = both.join(blocks, "dimension").withColumn("own", F.expr("cast(pmod(xxhash64(id), if(side = 0, n0, n1)) as int)"))
    cut = cut.withColumn("other", F.expr("explode(sequence(0, if(side = 0, n1, n0) - 1))"))
    cut = cut.select("dimension", "side", "id", "embedding", F.expr("if(side = 0, own, other)").alias("table_block"), F.expr("if(side = 0, other, own)").alias("query_block"))
    id_type = cut.schema["id"].dataType.simpleString()

    def best(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        table, queries = part[part["side"] == 0], part[part["side"] == 1]
        ids = table["id"].to_numpy()
        if not len(table) or not len(queries):  # a dimension that one side has alone
            return pd.DataFrame({"query": ids[:0], "id": ids[:0], "similarity": np.zeros(0)})
        x, q, asked, out = _unit(table["embedding"]), _unit(queries["embedding"]), queries["id"].to_numpy(), []
        begin, end = np.searchsorted(ids, asked), np.searchsorted(ids, asked, side="right")
        for start in range(0, len(q), TILE_ROWS):
            cosine = q[start : start + TILE_ROWS] @ x.T
            for row in np.flatnonzero(end[start : start + TILE_ROWS] > begin[start : start + TILE_ROWS]):  # the query itself
                cosine[row, begin[start + row] : end[start + row]] = -2.0
            # those that may round to the same four digits as the k-th stay in
            bound = np.partition(cosine, -k, axis=1)[:, -k] - 1e-4 if len(ids) > k else np.full(len(cosine), -1.5)
            r, c = np.nonzero(cosine >= np.maximum(bound, -1.5)[:, None])
            out.append(pd.DataFrame({"query": asked[start + r], "id": ids[c], "similarity": cosine[r, c]}))
        return pd.concat(out) if out else pd.DataFrame({"query": ids[:0], "id": ids[:0], "similarity": np.zeros(0)})

    met = cut.groupBy("dimension", "table_block", "query_block").applyInPandas(best, f"query {id_type}, id {id_type}, similarity double").withColumn("similarity", F.round("similarity", 4))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return met.withColumn("place", place).filter((F.col("place") <= k) & (F.col("similarity") >= least)).select("query", "id", "similarity", "place")


def dispersion(vectors: DataFrame, of: list[str]) -> DataFrame:
    """A5: mean of 1 - cosine over all pairs of a group, from the length of the sum of unit vectors: no pair is formed.

    Vectors of different dimensions have no cosine: a group counts those of each dimension by themselves, as pairs of
    cosine 0 between them.
    """
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = usable_vectors(vectors).withColumn("_norm", norm)
    counted = rows.groupBy(*of).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_norm") > 0).alias("_full"))
    sums = rows.filter("_norm > 0").select(*of, F.size("embedding").alias("_d"), F.posexplode("embedding"), "_norm").groupBy(*of, "_d", "pos").agg(F.sum(F.col("col") / F.col("_norm")).alias("s")).groupBy(*of).agg(F.sum(F.col("s") * F.col("s")).alias("_length"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    value = F.when(F.col("n") < 2, 0.0).otherwise(1 - (F.coalesce("_length", F.lit(0.0)) - F.col("_full")) / 2 / pairs)
    return counted.join(sums, of, "left").select(*of, "n", F.round(value, 6).alias("dispersion"))


#: Edges that one task decides at once.
TASK_EDGES = 1 << 20


def assign_leaders(items: DataFrame, edges: DataFrame, *, task_edges: int = TASK_EDGES, max_rounds: int = 1000) -> DataFrame:
    """(id, leader) as if items were taken in order of id and each joined the first leader that it is similar to.

    items (id); edges (a, b) between similar ids. A round takes from each component the items up to a place in the order
    so that their edges fit a task, all of most components; tasks decide them one after the other, and items beyond that
    place that a new leader is similar to are then members. What is left, without them, is the next round's. A long
    chain is one task's work, however deep.
    """
    both = edges.select(F.least("a", "b").alias("small"), F.greatest("a", "b").alias("large")).filter("small != large").distinct()
    every = items.select("id").distinct()
    both = both.join(every.withColumnRenamed("id", "small"), "small", "left_semi").join(every.withColumnRenamed("id", "large"), "large", "left_semi")
    links = materialise(both.select("small", "large"), "leader-links")
    id_type = links.schema["small"].dataType.simpleString()
    live, led = links, []

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        """Whether each item leads, of all items of some whole components or beginnings of them."""
        ids = np.unique(np.concatenate([part["small"].to_numpy(), part["large"].to_numpy()]))
        small, large = np.searchsorted(ids, part["small"].to_numpy()), np.searchsorted(ids, part["large"].to_numpy())
        by = np.argsort(large, kind="stable")
        small, starts = small[by], np.searchsorted(large[by], np.arange(len(ids) + 1))
        leads = np.ones(len(ids), bool)
        for i in range(len(ids)):
            if starts[i] < starts[i + 1]:
                leads[i] = not leads[small[starts[i] : starts[i + 1]]].any()
        return pd.DataFrame({"id": ids, "leads": leads})

    for _ in range(max_rounds):
        if live.isEmpty():
            break
        of = connected_components(live, "small", "large")
        rows = live.join(of.withColumnRenamed("node", "small"), "small")
        place = F.row_number().over(Window.partitionBy("component").orderBy("large", "small"))
        first = rows.withColumn("place", place).filter(F.col("place") <= task_edges + 1)
        # a component with more edges is decided up to, and without, the item at which they end
        ends = first.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.max("large").alias("last"))
        ends = materialise(ends, "leader-ends")
        inside = first.join(ends, "component").filter((F.col("n") <= task_edges) | (F.col("large") < F.col("last"))).select("component", "small", "large")
        tasks = max(1, -(-(ends.agg(F.sum("n")).first()[0] or 0) // task_edges))
        decided = inside.groupBy(F.pmod(F.xxhash64("component"), F.lit(tasks)).alias("task")).applyInPandas(decide, f"id {id_type}, leads boolean")
        # items before that place without an edge among them lead as well
        alone = of.select(F.col("node").alias("id"), "component").join(ends, "component").filter((F.col("n") > task_edges) & (F.col("id") < F.col("last"))).select("id").join(inside.select(F.explode(F.array("small", "large")).alias("id")), "id", "left_anti")
        decided = materialise(decided.unionByName(alone.withColumn("leads", F.lit(True))), "leader-decided")
        new = decided.filter("leads").select("id")
        led.append(new)
        covered = live.join(new.withColumnRenamed("id", "small"), "small", "left_semi").select(F.col("large").alias("id"))
        done = decided.select("id").unionByName(covered).distinct()
        left = live.join(done.withColumnRenamed("id", "small"), "small", "left_anti").join(done.withColumnRenamed("id", "large"), "large", "left_anti")
        # an item whose smaller neighbours are all decided and none of them leads: it leads
        freed = live.select(F.explode(F.array("small", "large")).alias("id")).distinct().join(done, "id", "left_anti").join(left.select(F.explode(F.array("small", "large")).alias("id")), "id", "left_anti")
        led.append(materialise(freed, "leader-freed"))
        live = materialise(left, "leader-links")
    else:
        raise RuntimeError(f"leaders have not settled in {max_rounds} rounds")
    lone = every.join(links.select(F.explode(F.array("small", "large")).alias("id")), "id", "left_anti")
    leaders = materialise(functools.reduce(DataFrame.unionByName, led, lone), "leaders")
    joins = links.join(leaders.withColumnRenamed("id", "small"), "small", "left_semi").groupBy(F.col("large").alias("id")).agg(F.min("small").alias("leader"))
    return every.join(joins, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))


#: Vectors of a chunk in order of id, those that one task decides one after the other, and those that it looks at beside new leaders.
CHUNK_ROWS, DECIDED_ROWS, COVERED_ROWS = 2048, 16384, 8192


def _first_leader(x: np.ndarray, leaders: np.ndarray, least: float) -> np.ndarray:
    """Of each row of x the first of these leaders whose cosine reaches ``least``, or -1."""
    found = np.full(len(x), -1)
    for start in range(0, len(leaders), CHUNK_ROWS):
        open_ = np.flatnonzero(found < 0)
        if not len(open_):
            break
        for rows in np.array_split(open_, -(-len(open_) // CHUNK_ROWS)):
            near = x[rows] @ leaders[start : start + CHUNK_ROWS].T >= least
            found[rows] = np.where(near.any(axis=1), start + near.argmax(axis=1), -1)
    return found


def _decided(ids: np.ndarray, x: np.ndarray, least: float) -> np.ndarray:
    """Of each row, in order, the place of its leader among them."""
    leader, leads = np.arange(len(ids)), np.zeros(0, int)
    for start in range(0, len(ids), CHUNK_ROWS // 4):
        end = min(start + CHUNK_ROWS // 4, len(ids))
        first = _first_leader(x[start:end], x[leads], least)
        leader[start:end] = np.where(first >= 0, leads[first] if len(leads) else -1, -1)
        left = start + np.flatnonzero(first < 0)
        near = x[left] @ x[left].T >= least
        taken = np.zeros(len(left), bool)
        for i in range(len(left)):
            if not taken[i]:
                new = near[i] & ~taken
                new[:i], new[i] = False, True
                leader[left[new]] = left[i]
                taken |= new
                leads = np.append(leads, left[i])
    return leader


def vector_leaders(vectors: DataFrame, least: float, *, within: str | None = None) -> DataFrame:
    """J5 of (id, embedding): (id, leader) as assign_leaders gives it for the pairs of cosine_join, without the pairs.

    A round takes from each part the first undecided vectors in order of id; one task decides these among themselves,
    and all others of the part then meet the new leaders alone: those that one of them covers are decided as well. What
    is compared is vectors by leaders, and nothing is kept of a pair. Where few vectors are alike nearly all lead, and
    that is the square of the table. Ids that several vectors share go by the pairs.
    """
    every = vectors.select("id").distinct()
    rows = usable_vectors(vectors).select("id", "embedding", (F.col(within) if within else F.lit(0)).alias("within")).filter("within is not null").withColumn("dimension", F.size("embedding"))
    rows = materialise(rows, "leader-vectors")
    id_type, part_type = rows.schema["id"].dataType.simpleString(), rows.schema["within"].dataType.simpleString()
    if not rows.groupBy("id").count().filter("count > 1 or id is null").isEmpty():
        return assign_leaders(vectors, materialise(cosine_join(vectors, least, within=within).select("a", "b"), "leader-pairs"))
    part = ["within", "dimension"]
    # places of ids in order, by ranges of ids, so that no task sorts a whole part
    dealt = materialise(rows.repartitionByRange(*part, "id").withColumn("_range", F.spark_partition_id()), "leader-ranges")
    before = dealt.groupBy(*part, "_range").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("_before", F.sum("n").over(Window.partitionBy(*part).orderBy("_range")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy(*part, "_range").orderBy("id")) - 1 + F.col("_before")
    placed = dealt.join(before, [*part, "_range"]).withColumn("chunk", F.floor(place / CHUNK_ROWS).cast("int"))
    told = f"id {id_type}, within {part_type}, dimension int, chunk int, unit binary, leader {id_type}"
    names = ["id", "within", "dimension", "chunk", "unit", "leader"]

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = [_unit(pd.Series([v]))[0].tobytes() for v in batch.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:4]), pa.array(unit, pa.binary())], names=names[:5])

    def matrix(found: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(found["unit"]), np.float64).reshape(len(found), -1)

    def decide(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("id", ignore_index=True)
        ids = found["id"].to_numpy()
        return found.assign(leader=ids[_decided(ids, matrix(found), least)])[names]

    def cover(found: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(new):
            return found.assign(leader=None)[names]
        new = new.sort_values("id", ignore_index=True)
        first = _first_leader(matrix(found), matrix(new), least)
        leader = pd.Series(new["id"].to_numpy()[first], index=found.index, dtype=object)
        return found.assign(leader=leader.where(first >= 0, None))[names]

    live, led = materialise(placed.select(*names[:4], "embedding").mapInArrow(units, told.rsplit(",", 1)[0]), "leader-live"), []
    group = F.floor(F.col("chunk") / (COVERED_ROWS // CHUNK_ROWS))
    while not live.isEmpty():
        sizes = live.groupBy(*part, "chunk").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*part).orderBy("chunk"))
        # chunks in order while they fit a task; the first one always does
        ends = materialise(sizes.withColumn("_upto", upto).filter(F.col("_upto") <= DECIDED_ROWS).groupBy(*part).agg(F.max("chunk").alias("_end")), "leader-ends")
        marked = live.join(ends, part)
        decided = materialise(marked.filter("chunk <= _end").select(*names[:5]).groupBy(*part).applyInPandas(decide, told), "leader-decided")
        led.append(decided.select("id", "leader"))
        left = marked.filter("chunk > _end").select(*names[:5], group.alias("_group"))
        if left.isEmpty():
            break
        new = decided.filter("id = leader").select(*part, "id", "unit").join(left.select(*part, "_group").distinct(), part)
        new = new.select("id", "unit", *(F.col(c).alias(f"new_{c}") for c in [*part, "_group"]))
        met = left.groupBy(*part, "_group").cogroup(new.groupBy(*(f"new_{c}" for c in [*part, "_group"]))).applyInPandas(cover, told)
        met = materialise(met, "leader-live")
        led.append(met.filter("leader is not null").select("id", "leader"))
        live = met.filter("leader is null").select(*names[:5])
    leaders = functools.reduce(DataFrame.unionByName, led, every.limit(0).select("id", F.col("id").alias("leader")))
    return every.join(leaders, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))


def semantic_merge(items: DataFrame, votes: DataFrame, *, n_models: int, least: float = 0.85, within: str | None = None) -> DataFrame:
    """A4 of items (id, embedding, text) and their votes (id, model, confidence): groups of similar items as one claim.

    The canonical item has most votes, then the shortest text, then the smallest id. Votes of all items are taken
    together, as in A1; variations lists the texts, and a group is ambiguous if two items have most votes.
    """
    led = materialise(vector_leaders(items, least, within=within), "merge-leaders")
    counts = votes.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    rows = items.select("id", "text").join(led, "id").join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("_order", F.struct((-F.col("n")).alias("n"), F.length("text").alias("l"), F.col("id")))
    tops = rows.groupBy("leader", "n").agg(F.count(F.lit(1)).alias("items")).groupBy("leader").agg((F.max_by("items", "n") > 1).alias("ambiguous"))
    groups = rows.groupBy("leader").agg(F.min_by("text", "_order").alias("canonical"), F.array_join(F.array_sort(F.collect_list("text")), "; ").alias("variations"), F.count(F.lit(1)).alias("items")).join(tops, "leader")
    cast = votes.join(led, "id").groupBy("leader").agg(F.count(F.lit(1)).alias("n_votes"), F.avg("confidence").alias("_a"), F.coalesce(F.stddev_samp("confidence"), F.lit(0.0)).alias("_s"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))
    agreement = F.coalesce("n_votes", F.lit(0)) / n_models
    r = lambda c, name: F.round(F.round(c, 9), 4).alias(name)
    return groups.join(cast, "leader", "left").select("leader", "canonical", "variations", "items", "ambiguous", F.coalesce("n_votes", F.lit(0)).alias("n_votes"), "models", r(agreement, "agreement"), r(F.col("_a"), "avg_confidence"), r(F.col("_s"), "std_confidence"), r(0.6 * agreement + 0.4 * F.col("_a"), "score"))


def duplicate_penalty(responses: DataFrame, *, least: float = 0.95, penalty: float = 0.5, within: str | None = None) -> DataFrame:
    """1 for the first of similar responses (id, embedding) of a run, the penalty for later ones."""
    led = vector_leaders(responses, least, within=within)
    return led.select("id", F.when(F.col("id") == F.col("leader"), 1.0).otherwise(penalty).alias("penalty"))


def new_aliases(resolved: DataFrame, similar: DataFrame) -> DataFrame:
    """Rows (alias, concept, similarity, method) to add to the aliases: names that a vector has resolved for good.

    resolved is what resolve_entities gave from similar (name, concept, similarity). Names that are only for review,
    and those that an alias or a concept had already, add none.
    """
    best = similar.groupBy("name", "concept").agg(F.max("similarity").alias("similarity"))
    rows = resolved.filter("method = 'embedding'").join(best, ["name", "concept"])
    return rows.select(F.col("name").alias("alias"), "concept", "similarity", "method").distinct()


def resolve_entities(names: DataFrame, aliases: DataFrame, concepts: DataFrame, similar: DataFrame | None = None, *, accept: float = 0.92, review: float = 0.85, create: bool = False) -> DataFrame:
    """J1 of (name): (name, concept, method): alias, exact, embedding (similar enough), review (less so) or not_found.

    aliases (alias, concept), concepts (concept), similar (name, concept, similarity), as closest_concepts gives it. A
    name that is only for review has its candidate as the concept. With ``create`` a name that isn't found is a concept
    of its own: new.
    """
    distinct = names.select("name").distinct()
    first = aliases.groupBy("alias").agg(F.min("concept").alias("_alias"))
    rows = distinct.join(first, F.col("name") == F.col("alias"), "left").join(concepts.select(F.col("concept").alias("_exact")).distinct(), F.col("name") == F.col("_exact"), "left")
    if similar is None:
        rows = rows.withColumns({"_near": F.lit(None).cast("string"), "_sim": F.lit(None).cast("double")})
    else:
        best = similar.groupBy(F.col("name").alias("_of")).agg(F.max_by("concept", F.struct("similarity", "concept")).alias("_near"), F.max("similarity").alias("_sim"))
        rows = rows.join(best, F.col("name") == F.col("_of"), "left")
    method = F.when(F.col("_alias").isNotNull(), "alias").when(F.col("_exact").isNotNull(), "exact").when(F.col("_sim") >= accept, "embedding").when(F.col("_sim") >= review, "review").otherwise("new" if create else "not_found")
    concept = F.coalesce("_alias", "_exact", F.when(F.col("_sim") >= review, F.col("_near")), F.col("name") if create else F.lit(None))
    return rows.select("name", concept.alias("concept"), method.alias("method"))


def closest_concepts(names: DataFrame, concepts: DataFrame, *, least: float = 0.85, itself: bool = True) -> DataFrame:
    """(name, concept, similarity) of each of names (name, embedding) and the nearest of concepts (concept, embedding).

    Without ``itself``, a name's own concept, the one of the same name, is left out.
    """
    mark = ("c:", "n:") if itself else ("c:", "c:")
    found = nearest_to(concepts.select(F.concat(F.lit(mark[0]), "concept").alias("id"), "embedding"), names.select(F.concat(F.lit(mark[1]), "name").alias("query"), "embedding"), k=1, least=least)
    return found.select(F.expr("substring(query, 3)").alias("name"), F.expr("substring(id, 3)").alias("concept"), "similarity")
