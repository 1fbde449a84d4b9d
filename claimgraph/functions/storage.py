"""Tables that cut lineage, kept in the folder that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a local session may do without: it gets a folder of its own."""
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if not named:
        if not (spark.conf.get("spark.master", "") or "").startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(CHECKPOINT_CONF, named)
    return named.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: no lineage, columnar, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables that materialise has written and that nothing reads any more, such as an iteration's last state."""
    for table in tables:
        files = table.inputFiles()
        if not files:
            continue
        folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if folder.toUri().getPath().startswith(table.sparkSession._jvm.org.apache.hadoop.fs.Path(shared_dir(table.sparkSession)).toUri().getPath()):
            folder.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
