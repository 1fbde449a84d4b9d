"""Edges and their curvature, kept up to date on storage by a stream of changes that may stop and start again.

An edge lies in the bucket of either end, so all that touches a node is in one bucket. A batch rewrites the buckets of
the nodes that it touches and of the neighbours of nodes that it deletes, and no others. Each version's tag has the
number of the batch that made it: a batch that comes again, after a stop, finds its number and does nothing. The nodes
whose edges need their curvature again are queued by batch. Curvature is stored with the counts that it rests on; refresh
takes what is queued, reads the edges of those nodes as they were and are, carries the counts on by what changed, and
rewrites the curvature of those edges. The neighbours' own edges aren't looked at, however many they have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.functions.storage import materialise, release
from claimgraph.functions.versioned import VersionedTable
from claimgraph.operators.graph import apply_deltas, changed_counts, curvature_counts, curvature_of_counts, incident, valid_deltas

EDGE = ["source", "target"]


def _both(edges: DataFrame) -> DataFrame:
    """A row in the bucket of either end."""
    return incident(edges)


def _other() -> Column:
    return F.when(F.col("node") == F.col("source"), F.col("target")).otherwise(F.col("source"))


class EdgeStore:
    """Edges (source, target, weight) at a path, their curvature, and the queue of nodes to look at again."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.table, self.curved = VersionedTable(spark, f"{self.path}/edges"), VersionedTable(spark, f"{self.path}/curvature")

    @classmethod
    def create(cls, path: str, start: DataFrame, *, buckets: int = 64) -> "EdgeStore":
        """A store of the edges of start, with their curvature."""
        store, start = cls(start.sparkSession, path), start.select(*EDGE, "weight")
        VersionedTable.create(store.table.path, _both(start), ["node"], buckets=buckets, tag={"batch": -1})
        VersionedTable.create(store.curved.path, _both(curvature_counts(store.edges())), ["node"], buckets=buckets, tag={"batch": -1})
        return store

    def edges(self) -> DataFrame:
        return self.table.read().filter("node = source").select(*EDGE, "weight")

    def curvature(self, *, weightless: float = 0.0) -> DataFrame:
        return curvature_of_counts(self.curved.read().filter("node = source"), weightless=weightless)

    def _queued(self, number: int | str) -> str:
        return f"{self.path}/queue/batch={number}"

    def queue(self) -> DataFrame:
        """(batch, node): whose edges each batch has made dirty and whose curvature hasn't been taken again."""
        schema = f"node {self.table.read().schema['node'].dataType.simpleString()}, batch int"
        done, made = self.curved.tag["batch"], [int(n.removeprefix("batch=")) for n in VersionedTable(self.spark, f"{self.path}/queue")._names() if n.startswith("batch=")]
        paths = [self._queued(n) for n in made if n > done]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/queue").parquet(*paths)

    def dirty(self) -> DataFrame:
        """(source, target): edges that touch a queued node."""
        nodes = self.queue().select("node").distinct()
        return self.table.read(buckets=self.table.touched(nodes)).join(nodes, "node", "left_semi").select(*EDGE).distinct()

    def merge(self, batch: DataFrame, number: int) -> None:
        """One batch of changes (operation, source, target, weight, ts, id): edges, then the queue."""
        done = self.table.tag["batch"]
        if done > number:
            return  # the next batch is only given once this one is through
        changes = materialise(valid_deltas(batch).filter("valid").drop("valid"), "store-changes")
        ends = changes.select(F.explode(F.when(F.col("operation").endswith("node"), F.array("source")).otherwise(F.array("source", "target"))).alias("node")).distinct()
        gone = changes.filter("operation = 'delete_node'").select(F.col("source").alias("node")).distinct()
        before = self.table.manifest()["version"] - (done == number)  # the version that the batch meets, if it comes again too
        beside = self.table.read(version=before, buckets=self.table.touched(gone)).join(gone, "node", "left_semi").select(_other().alias("node"))
        nodes = materialise(ends.union(beside).distinct(), "store-nodes")
        if done < number:
            buckets = self.table.touched(nodes)
            now = self.table.read(buckets=buckets).select(*EDGE, "weight").distinct()
            self.table.rewrite(buckets, _both(apply_deltas(now, changes)), tag={"batch": number})
        nodes.write.mode("overwrite").parquet(self._queued(number))
        release(changes, nodes)

    def _version_of(self, number: int) -> int:
        """The last version of the edges that holds no batch after this one."""
        return next(v for v in reversed(self.table.versions()) if self.table.manifest(v)["tag"]["batch"] <= number)

    def refresh(self) -> int:
        """G5 and G6 of what is queued: the curvature of all edges that touch queued nodes. Gives the last batch."""
        queued = materialise(self.queue(), "store-queue")
        last = queued.agg(F.max("batch")).first()[0]
        if last is None:
            return self.curved.tag["batch"]
        nodes = queued.select("node").distinct()
        buckets = self.table.touched(nodes)
        beside = lambda table, **of: table.read(buckets=buckets, **of).join(nodes, "node", "left_semi").drop("node").distinct()
        old = materialise(beside(self.curved), "store-old")
        # edges of a batch that isn't queued yet, as after a stop, are left to the next time
        made = changed_counts(old, beside(self.table, version=self._version_of(last)), nodes)
        ends = incident(made.select(*EDGE).unionByName(old.select(*EDGE))).select("node").union(nodes).distinct()
        buckets = self.curved.touched(ends)
        stays = self.curved.read(buckets=buckets).drop("node").distinct()
        for end in EDGE:
            stays = stays.join(nodes.withColumnRenamed("node", end), end, "left_anti")
        self.curved.rewrite(buckets, _both(stays.select(*made.columns).unionByName(made)), tag={"batch": int(last)})
        release(queued, old, made)
        return int(last)

    def follow(self, deltas: DataFrame) -> None:
        """All changes that a stream holds now, batch by batch; a stream goes on where its last run stopped."""
        query = deltas.writeStream.foreachBatch(lambda batch, number: self.merge(batch, number)).option("checkpointLocation", f"{self.path}/checkpoint")
        query.trigger(availableNow=True).start().awaitTermination()
