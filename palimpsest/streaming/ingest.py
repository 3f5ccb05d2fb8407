"""Streaming ingestion: files of new papers are matched against the repository as they arrive.

Each micro-batch is matched with the repository as it was before and with earlier rows of the same batch, so the outcome is that of strict
sequence by ``ingest_seq``. The repository's shingles are a table that grows; a paper that fails
gets the status ``error`` instead of failing the batch. The checkpoint takes the place of a queue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.overlap import shingle_table

SCHEMA = "ingest_seq long, doc_id long, assignment string, text string"


def sequential_candidates(new: DataFrame, repository: DataFrame, min_shared: int = 2, max_df: int = 200) -> DataFrame:
    """Pairs of a new paper and an earlier one: ``sub_id, src_id, shared``. Both: ``doc_id, ingest_seq, shingle``."""
    common = repository.groupBy("shingle").agg(F.count("*").alias("df")).where(F.col("df") <= max_df).select("shingle")
    old = repository.join(common, "shingle", "left_semi").select(F.col("doc_id").alias("src_id"), F.col("ingest_seq").alias("src_seq"), "shingle")
    pairs = new.select(F.col("doc_id").alias("sub_id"), "ingest_seq", "shingle").join(old, "shingle").where("src_seq < ingest_seq and sub_id <> src_id")
    return pairs.groupBy("sub_id", "src_id").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)


def process(batch: DataFrame, spark: SparkSession, folder: str) -> None:
    """One micro-batch: appends results and shingles. Written with the batch's own number, so a repeated batch replaces its files."""
    number = batch.agg(F.min("ingest_seq")).first()[0]
    if number is None:
        return
    status = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "error").otherwise("done")
    rows = batch.withColumn("status", status)
    good = rows.where("status = 'done'")
    fresh = shingle_table(good, "doc_id", ["ingest_seq"])
    fresh.write.mode("overwrite").parquet(f"{folder}/shingles/batch={number}")
    held = spark.read.schema("doc_id long, ingest_seq long, shingle long").parquet(f"{folder}/shingles/*")
    found = sequential_candidates(spark.read.schema("doc_id long, ingest_seq long, shingle long").parquet(f"{folder}/shingles/batch={number}"), held)
    best = found.groupBy(F.col("sub_id").alias("doc_id")).agg(F.count("*").alias("matches"), F.max("shared").alias("most_shared"))
    out = rows.select("ingest_seq", "doc_id", "assignment", "status", F.size(T.norms(F.coalesce("text", F.lit("")))).alias("words")).join(best, "doc_id", "left")
    out = out.select("ingest_seq", "doc_id", "assignment", "status", "words", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("most_shared", F.lit(0)).alias("most_shared"))
    out.write.mode("overwrite").parquet(f"{folder}/results/batch={number}")


def start(spark: SparkSession, source: str, folder: str, once: bool = True, files_per_batch: int = 1000) -> StreamingQuery:
    """Reads JSON files of papers from ``source`` as a stream; results go to ``folder/results``."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(source)
    writer = stream.writeStream.foreachBatch(lambda df, _: process(df, df.sparkSession, folder)).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def results(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/results/*")
