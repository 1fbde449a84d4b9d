"""Common targets of arcs and triangles of nodes, by colour: no wedge is shuffled.

Nodes have colours. A base arc u -> v and the two arcs u -> c and v -> c that close it meet in the task of the three
colours of u, v and c, where an arc of two given colours is needed once for each colour of the third node that has arcs
of all three kinds. Colours are ranges of the nodes' order first, as many as copy the fewest arcs by a count of the arcs
between ranges; a task that is still too large is cut by hashes. So where nodes that lie close to each other are linked,
an arc is copied a few times however many arcs there are; where links know no order, three times the number of colours,
which grows with the square root of the arcs. So that copies are small, arcs of two colours are sorted and compressed
before they are copied. A task holds a bounded number of arcs, and a hub's arcs are dealt to many
tasks. In a task a base arc opens the shorter of its two lists and looks its nodes up in the other one; lists are opened
some at a time.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.storage import materialise, release

#: Arcs that a task holds, and pairs of arcs that it looks at at once.
TASK_ARCS, AT_ONCE = 1 << 21, 1 << 21
#: Arcs that are compressed together.
BLOCK_ARCS = 1 << 16
#: Ranges of nodes between which arcs are counted.
MOST_RANGES = 256
BASE, OF_SOURCE, OF_TARGET = range(3)


def _bounds(tables: list[DataFrame], size: int) -> list:
    """Nodes that part the order of all nodes into ranges with about as many arcs, from a sample; they only set speed."""
    ranges = min(MOST_RANGES, 1 << math.ceil(math.log2(4 * size / TASK_ARCS))) if size > TASK_ARCS else 1
    if ranges == 1:
        return []
    some = [t.select(F.explode(F.array("source", "target")).alias("node")).filter("node is not null").sample(min(1.0, 64 * ranges / size), 1) for t in tables]
    nodes = sorted(r[0] for t in some for r in t.collect())
    return sorted({nodes[i * len(nodes) // ranges] for i in range(1, ranges)}) if nodes else []


def _coloured(rows: DataFrame, bounds: list) -> DataFrame:
    """rows (source, target) and maybe sign, with the ranges p and q of both ends."""
    rows = rows.filter("source is not null and target is not null")
    if not bounds:
        return rows.withColumns({"p": F.lit(0), "q": F.lit(0)})
    parts = np.array(bounds, None if isinstance(bounds[0], (int, float)) else object)

    def colour(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranges = [np.searchsorted(parts, b.column(c).to_numpy(zero_copy_only=False), side="right").astype(np.int32) for c in ("source", "target")]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, ranges)], [*b.schema.names, "p", "q"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return materialise(rows.mapInArrow(colour, f"{fields}, p int, q int"), "triangle-coloured")


def _tasks(counts: list[np.ndarray]) -> tuple[float, list[tuple]]:
    """(arcs in all, [(p, q, r, hashes)]): of the ranges of u, v and c those with arcs of all three kinds."""
    base, of_source, of_target = counts
    found, copied = [], 0.0
    for p in range(len(base)):
        n = base[p][:, None] + of_source[p][None, :] + of_target
        q, r = np.nonzero((base[p][:, None] > 0) & (of_source[p][None, :] > 0) & (of_target > 0))
        hashes = np.ceil(np.sqrt(n[q, r] / TASK_ARCS)).astype(np.int64)
        copied += float((n[q, r] * hashes).sum()) + TASK_ARCS / 100 * len(q)
        found += zip([p] * len(q), q.tolist(), r.tolist(), hashes.tolist(), strict=True)
    return copied, found


def _block(arcs: pa.Table) -> bytes:
    """Sorted arcs (x, y, sign), compressed; what is like the value before takes little room."""
    kinds = {c: arcs.schema.field(c).type for c in ("x", "y")}
    delta = {c: "DELTA_BINARY_PACKED" if pa.types.is_integer(k) else "DELTA_BYTE_ARRAY" for c, k in kinds.items() if pa.types.is_int32(k) or pa.types.is_int64(k) or pa.types.is_string(k)}
    out = pa.BufferOutputStream()
    pq.write_table(arcs, out, compression="zstd", use_dictionary=False, write_statistics=False, column_encoding={"x": "PLAIN", "y": "PLAIN", "sign": "PLAIN"} | delta)
    return out.getvalue().to_pybytes()


def _arcs(part: pa.Table) -> pa.Table:
    """(role, x, y) of the arcs of rows (role, block). The role of an arc of sign -1 is negative."""
    found = []
    for role, block in zip(part.column("role").to_pylist(), part.column("block"), strict=True):
        arcs = pq.read_table(pa.py_buffer(block.as_py()))
        found.append(pa.table({"role": pa.array(arcs.column("sign").to_numpy() * np.int8(role), pa.int8()), "x": arcs.column("x"), "y": arcs.column("y")}))
    return pa.concat_tables(found)


def _packed(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(i, j, h, of_x, of_y, block): arcs (i, j, x, y, sign) in blocks of two ranges and of two of h hashes; cells are (i, j, h)."""
    hashed = lambda c: F.pmod(F.xxhash64(c), F.col("h"))
    rows = rows.join(F.broadcast(cells), ["i", "j"]).select("i", "j", "h", hashed("x").alias("of_x"), hashed("y").alias("of_y"), "x", "y", "sign")

    def pack(key: tuple, part: pa.Table) -> pa.Table:
        part = part.select(["x", "y", "sign"]).sort_by([("x", "ascending"), ("y", "ascending")])
        blocks = [_block(part.slice(at, BLOCK_ARCS)) for at in range(0, part.num_rows, BLOCK_ARCS)]
        of = {name: pa.array([k.as_py()] * len(blocks), k.type) for name, k in zip(("i", "j", "h", "of_x", "of_y"), key, strict=True)}
        return pa.table(of | {"block": pa.array(blocks, pa.binary())})

    return rows.groupBy("i", "j", "h", "of_x", "of_y").applyInArrow(pack, "i int, j int, h int, of_x long, of_y long, block binary")


def _blocks(base: DataFrame, of_source: DataFrame, of_target: DataFrame, size: int) -> DataFrame:
    """(task, role, block): every arc in the tasks that need it, size arcs in all."""
    given = [base, of_source, of_target]
    own = {id(t): t for t in given}
    bounds = _bounds(list(own.values()), size)
    coloured = {k: _coloured(t, bounds) for k, t in own.items()}
    wide, tasks = len(bounds) + 1, [(0, 0, 0, 1)]
    width = wide
    if bounds:
        # a few numbers for each pair of ranges, whatever the size of the tables
        between = {}
        for k, t in coloured.items():
            between[k] = np.zeros((wide, wide))
            for r in t.groupBy("p", "q").agg(F.count(F.lit(1)).alias("n")).collect():
                between[k][r.p, r.q] = r.n
        best = None
        for step in (1 << i for i in range(wide.bit_length() + 1)):
            firsts = np.arange(0, wide, step)
            copied, found = _tasks([np.add.reduceat(np.add.reduceat(between[id(t)], firsts, 0), firsts, 1) for t in given])
            if best is None or copied < best:
                best, width, tasks = copied, step, found
    spark, numbered, at = base.sparkSession, [], 0
    for p, q, r, h in tasks:
        numbered.append((p, q, r, h, at))
        at += h**3
    table = spark.createDataFrame(numbered, "a int, b int, c int, h int, first long")
    ends = {BASE: ("a", "b"), OF_SOURCE: ("a", "c"), OF_TARGET: ("b", "c")}
    x, y, h, other = F.col("of_x"), F.col("of_y"), F.col("h"), F.col("other")
    place = F.when(F.col("role") == BASE, (x * h + y) * h + other).when(F.col("role") == OF_SOURCE, (x * h + other) * h + y).otherwise((other * h + x) * h + y)
    parts = []
    for k, rows in coloured.items():
        uses = [table.select(F.col(ends[role][0]).alias("i"), F.col(ends[role][1]).alias("j"), "h", F.lit(role).cast("byte").alias("role"), "first") for role, t in enumerate(given) if id(t) == k]
        uses = functools.reduce(DataFrame.union, uses).groupBy("i", "j", "h").agg(F.collect_list(F.struct("role", "first")).alias("at"))
        sign = F.col("sign").cast("byte") if "sign" in rows.columns else F.lit(1).cast("byte")
        rows = rows.select(F.floor(F.col("p") / width).cast("int").alias("i"), F.floor(F.col("q") / width).cast("int").alias("j"), F.col("source").alias("x"), F.col("target").alias("y"), sign.alias("sign"))
        met = _packed(rows, uses.select("i", "j", "h")).join(F.broadcast(uses), ["i", "j", "h"]).select("of_x", "of_y", "h", "block", F.explode("at").alias("at")).select("*", "at.role", "at.first")
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), h - F.lit(1).cast("long"))))
        parts.append(met.select((F.col("first") + place).alias("task"), "role", "block"))
    return functools.reduce(DataFrame.unionByName, parts)


def _dealt(base: DataFrame, of_source: DataFrame, of_target: DataFrame, size: int) -> DataFrame:
    """(task, role, x, y): the arcs of _blocks, one by one."""
    kind = base.schema["source"].dataType.simpleString()

    def opened(key: tuple, part: pa.Table) -> pa.Table:
        arcs = _arcs(part)
        return arcs.add_column(0, "task", pa.array(np.full(arcs.num_rows, key[0].as_py(), np.int64)))

    return _blocks(base, of_source, of_target, size).groupBy("task").applyInArrow(opened, f"task long, role byte, x {kind}, y {kind}")


class _Task:
    """The arcs of one task as numbers, lists by their first node, and what closes base arcs."""

    def __init__(self, part: pa.Table) -> None:
        ends = pa.chunked_array([*part.column("x").chunks, *part.column("y").chunks]).combine_chunks().dictionary_encode()
        self.nodes, code = ends.dictionary, ends.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        x, y, role = code[: part.num_rows], code[part.num_rows :], part.column("role").to_numpy()
        self.n = len(self.nodes)
        self.u, self.v = x[role == BASE], y[role == BASE]
        self.lists = []
        for kind in (OF_SOURCE, OF_TARGET):
            mine = np.abs(role) == kind
            keys = x[mine] * self.n + y[mine]
            order = np.argsort(keys)
            keys = keys[order]
            self.lists.append((keys, role[mine][order] // kind, np.searchsorted(keys, np.arange(self.n + 1) * self.n)))

    def closed(self):
        """(base arcs, third nodes, signs) of all triangles, some at a time; a sign is that of both closing arcs."""
        starts = [s for _, _, s in self.lists]
        by_source, by_target = starts[0][self.u + 1] - starts[0][self.u], starts[1][self.v + 1] - starts[1][self.v]
        for open_source in (True, False):
            mine = np.flatnonzero((by_source <= by_target) == open_source)
            size = (by_source if open_source else by_target)[mine]
            (keys, sign, first), (other, other_sign, _) = self.lists if open_source else self.lists[::-1]
            here, there = (self.u, self.v) if open_source else (self.v, self.u)
            upto = np.concatenate([[0], np.cumsum(size)])
            at = 0
            while at < len(mine):
                to = max(at + 1, int(np.searchsorted(upto, upto[at] + AT_ONCE, side="right")) - 1)
                some, n = mine[at:to], size[at:to]
                arcs = np.repeat(some, n)
                place = np.arange(int(n.sum())) - np.repeat(upto[at:to] - upto[at], n) + np.repeat(first[here[some]], n)
                third = keys[place] % self.n
                wanted = there[arcs] * self.n + third
                found = np.searchsorted(other, wanted)
                hit = found < len(other)
                hit[hit] = other[found[hit]] == wanted[hit]
                yield arcs[hit], third[hit], sign[place[hit]] * other_sign[found[hit]]
                at = to


def _counted(base: DataFrame, of_source: DataFrame, of_target: DataFrame, size: int) -> DataFrame:
    """(source, target, both): of arcs of base, the sum of the signs of what closes them, where it isn't 0."""
    kind = base.schema["source"].dataType.simpleString()

    def count(part: pa.Table) -> pa.Table:
        task = _Task(_arcs(part))
        times = np.zeros(len(task.u), np.int64)
        for found, _, sign in task.closed():
            np.add.at(times, found, sign.astype(np.int64))
        some = np.flatnonzero(times)
        return pa.table({"source": task.nodes.take(pa.array(task.u[some])), "target": task.nodes.take(pa.array(task.v[some])), "both": pa.array(times[some])})

    met = _blocks(base, of_source, of_target, size).groupBy("task").applyInArrow(count, f"source {kind}, target {kind}, both long")
    return met.groupBy("source", "target").agg(F.sum("both").alias("both"))


def common_targets(arcs: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(source, target, both): for each arc of base, or of arcs, how many targets its ends have in common, if any.

    arcs (source, target) are distinct.
    """
    arcs = materialise(arcs.select("source", "target"), "triangle-arcs")
    base = arcs if base is None else base.select("source", "target")
    return _counted(base, arcs, arcs, 3 * arcs.count())


def common_target_changes(base: DataFrame, before: DataFrame, after: DataFrame, changes: DataFrame) -> DataFrame:
    """(source, target, both): by how much the common targets of arcs of base, which stay, have become more or fewer.

    changes (source, target, sign) are the arcs that came, sign 1, and went, -1; before and after hold, at least, all
    arcs into targets of changes as they were and are. A pair of arcs that closes base is counted once for each of them
    that changed, the first against what is now and the second against what was: changes x after + before x changes.
    So the work grows with the changes and the arcs beside them, not with the graph. All tables hold distinct arcs.
    """
    changes = materialise(changes.select("source", "target", "sign"), "triangle-changes")
    into = changes.select("target").distinct()
    sources = changes.select("source").distinct()
    before, after = (materialise(t.select("source", "target").join(into, "target", "left_semi").select("source", "target"), "triangle-beside") for t in (before, after))
    # what base arcs lead from may have changed, or what they lead to
    opened, closing = (materialise(base.join(sources.toDF(end), end, "left_semi").select("source", "target"), "triangle-base") for end in ("source", "target"))
    n = changes.count()
    first = _counted(opened, changes, after, opened.count() + n + after.count())
    second = _counted(closing, before, changes, closing.count() + n + before.count())
    found = first.unionByName(second).groupBy("source", "target").agg(F.sum("both").alias("both")).filter("both != 0")
    found = materialise(found, "triangle-gained")
    release(changes, before, after, opened, closing)
    return found


def triangles(arcs: DataFrame) -> DataFrame:
    """(node, triangles) of nodes in triangles, from arcs (source, target) that point along one order of the nodes."""
    arcs = materialise(arcs.select("source", "target"), "triangle-arcs")
    kind = arcs.schema["source"].dataType.simpleString()

    def count(part: pa.Table) -> pa.Table:
        task = _Task(_arcs(part))
        times = np.zeros(task.n, np.int64)
        for found, third, _ in task.closed():
            for ends in (task.u[found], task.v[found], third):
                times += np.bincount(ends, minlength=task.n)
        some = np.flatnonzero(times)
        return pa.table({"node": task.nodes.take(pa.array(some)), "triangles": pa.array(times[some])})

    met = _blocks(arcs, arcs, arcs, 3 * arcs.count()).groupBy("task").applyInArrow(count, f"node {kind}, triangles long")
    return met.groupBy("node").agg(F.sum("triangles").alias("triangles"))
