"""Folders of landed JSON as tables, with what can't be read told apart.

Files are JSON lines, or one JSON value over several lines. Spark lists, splits and reads them, from whatever store they
lie in. Each value is a row; a line or file that is cut off or no JSON, and a file that is empty, are rows too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOOD, BROKEN, EMPTY = "good", "broken", "empty"


def read_landed(spark: SparkSession, folder: str, *, whole_files: bool = False) -> DataFrame:
    """(path, state, raw): good values, broken ones as they are, and empty files with a null raw.

    Lines of white space are left out. With ``whole_files`` a file is one value and may hold line ends.
    """
    source = spark.read.option("recursiveFileLookup", True)
    lines = source.text(folder, wholetext=whole_files).select(F.col("_metadata.file_path").alias("path"), F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("raw")).filter("raw != ''")
    rows = lines.select("path", F.when(F.try_parse_json("raw").isNotNull(), GOOD).otherwise(BROKEN).alias("state"), "raw")
    name = lambda c: F.regexp_replace(c, r"^[a-z]+:/+", "/")  # noqa: E731 - the two readers write schemes differently
    # the driver lists the folder's files for any read; an empty one has no row of its own
    files = spark.createDataFrame([(f,) for f in source.text(folder).inputFiles()], "path string")
    empty = files.select(name("path").alias("path")).join(lines.select(name("path").alias("path")).distinct(), "path", "left_anti")
    return rows.withColumn("path", name("path")).unionByName(empty.select("path", F.lit(EMPTY).alias("state"), F.lit(None).cast("string").alias("raw")))


def landing_report(landed: DataFrame) -> DataFrame:
    """(state, files, n): how many files and values are in each state."""
    return landed.groupBy("state").agg(F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("n"))
