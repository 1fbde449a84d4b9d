"""A training corpus in five stages: good documents, one of each near-duplicate group, masked secrets, mixed, packed.

Each stage works on all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.functions.storage import materialise
from claimgraph.llm import jaccard, mixing, packing, quality, queries, secrets
from claimgraph.llm.columns import named


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.7 or more. It learns from the labels that op5_quality learns from.

    A null or empty text is scored by the statistics of no bytes. Repeated rows go or stay together; null ids are never
    learned from; an empty table gives no rows; columns may have any names and stay as they are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels, learns_from=F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by 0.8 of their five-word shingles.

    Rows that share an id are one document: they go together, and of those that stay the one with the smallest hash of
    its row is kept. Rows with a null id, or without words, link with nothing; the former all stay. An empty table gives
    no rows; columns may have any names and stay as they are.
    """
    groups = materialise(jaccard.jaccard_components(docs, width=5, percent=80), "pipeline-groups")
    known = groups.filter("doc_id is not null")
    copies = known.filter("doc_id != component_id").select("doc_id").distinct()
    left = docs.join(copies.hint("merge"), "doc_id", "left_anti")  # copies have no bound: never a broadcast
    repeated = materialise(known.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "pipeline-repeated")
    if repeated.isEmpty():
        return left.select(*named(docs))
    again = left.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.struct(*named(docs)).alias("row"))
    again = again.groupBy("id").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return left.join(repeated, "doc_id", "left_anti").unionByName(again).select(*named(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets of documents that hold a live-looking one are masked; every document stays.

    Null and empty texts stay; repeated rows are masked alike; an empty table gives no rows; columns may have any names.
    """
    return secrets.mask_live(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it.

    A null source is one of its own; texts without words are never taken; equal rows are taken equally often; an empty
    table gives no rows; columns may have any names.
    """
    return mixing.resample(docs, weights=queries.SOURCE_WEIGHTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens.

    A null or empty text is its end token alone; repeated rows, such as the mixture's copies, are documents of their own;
    an empty table gives no rows; other columns are left out.
    """
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]
#: No stage but the secret scan can be written in SQL: trained rules, Newton steps and packing are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
