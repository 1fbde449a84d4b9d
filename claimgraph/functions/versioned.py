"""Tables whose versions stay readable: a change rewrites only the buckets of the keys that it touches.

Rows lie in folders by a hash of their keys. A manifest, a small JSON file, names the folder of each bucket; a new
version is a new manifest that names new folders for the buckets that were rewritten and the old ones for all others.
Folders are written first and the manifest is renamed into place last, so a reader sees a version whole or not at all,
and a writer that stops half-way leaves only folders that no manifest names. One writer at a time: a version that is
there already is an error. What a writer wants to find again, such as the number of the last batch, is the version's tag.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimgraph.functions.storage import shared_dir

BUCKET = "_bucket"


class VersionedTable:
    """A table at a path that driver and executors share; open it again by its path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, path: str, rows: DataFrame, keys: list[str], *, buckets: int = 64, tag: dict | None = None) -> "VersionedTable":
        """A new table of rows. A table that is there already is an error."""
        table = cls(rows.sparkSession, path)
        if table.versions():
            raise FileExistsError(path)
        table._commit({"version": 0, "tag": tag or {}, "keys": keys, "buckets": buckets, "schema": rows.schema.json(), "folders": {}}, rows, None)
        return table

    @classmethod
    def scratch(cls, rows: DataFrame, keys: list[str], name: str, *, buckets: int = 64) -> "VersionedTable":
        """A new table in a place of its own in the shared folder."""
        return cls.create(f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}", rows, keys, buckets=buckets)

    # files

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _files(self):
        return self._at().getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, *parts: str) -> list[str]:
        files, at = self._files(), self._at(*parts)
        return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        at = self._at("manifests", f"{found[-1] if version is None else version:012d}.json")
        stream = self._files().open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    @property
    def tag(self) -> dict:
        return self.manifest()["tag"]

    # rows

    def _bucket(self, manifest: dict) -> Column:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        return F.pmod(F.xxhash64(*(F.col(k).cast(schema[k].dataType) for k in manifest["keys"])), F.lit(manifest["buckets"])).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that the keys of rows fall into: as many as the table has, at most."""
        return sorted(r[0] for r in rows.select(self._bucket(self.manifest()).alias(BUCKET)).distinct().collect())

    def read(self, *, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, the last one unless told otherwise, and of some buckets only."""
        m = self.manifest(version)
        folders = [f for b, f in m["folders"].items() if buckets is None or int(b) in set(buckets)]
        schema = StructType.fromJson(json.loads(m["schema"]))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def rewrite(self, buckets: list[int], rows: DataFrame, *, tag: dict | None = None) -> int:
        """A new version in which these buckets hold those of rows that belong there; gives its number."""
        old = self.manifest()
        kept = {b: f for b, f in old["folders"].items() if int(b) not in set(buckets)}
        return self._commit({**old, "version": old["version"] + 1, "tag": old["tag"] | (tag or {}), "folders": kept}, rows, buckets)

    def update(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], *, tag: dict | None = None) -> int:
        """A new version in which change has been made to the rows of all buckets that keys fall into."""
        buckets = self.touched(keys)
        return self.rewrite(buckets, change(self.read(buckets=buckets)), tag=tag)

    def _commit(self, manifest: dict, rows: DataFrame, buckets: list[int] | None) -> int:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in schema)).withColumn(BUCKET, self._bucket(manifest))
        if buckets is not None:
            rows = rows.filter(F.col(BUCKET).isin(buckets))
        folder = f"data/{manifest['version']:012d}-{uuid.uuid4().hex}"
        if buckets is None or buckets:
            rows.hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        for name in self._names(*folder.split("/")):
            if name.startswith(BUCKET + "="):
                manifest["folders"][name.removeprefix(BUCKET + "=")] = f"{folder}/{name}"
        files, draft = self._files(), self._at("manifests", f".{uuid.uuid4().hex}")
        stream = files.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        to = self._at("manifests", f"{manifest['version']:012d}.json")
        if files.exists(to) or not files.rename(draft, to):
            raise RuntimeError(f"{self.path} has a version {manifest['version']} already")
        return manifest["version"]

    def expire(self, *, keep: int = 1) -> None:
        """Forget all versions but the last so many, and delete folders that none of those left names."""
        found, files = self.versions(), self._files()
        named = {f.split("/")[1] + "/" + f.split("/")[2] for v in found[-keep:] for f in self.manifest(v)["folders"].values()}
        for v in found[:-keep]:
            files.delete(self._at("manifests", f"{v:012d}.json"), False)
        for folder in self._names("data"):
            parts = [n for n in self._names("data", folder) if n.startswith(BUCKET + "=")]
            gone = [n for n in parts if f"{folder}/{n}" not in named]
            if len(gone) == len(parts):
                files.delete(self._at("data", folder), True)
            else:
                for n in gone:
                    files.delete(self._at("data", folder, n), True)
