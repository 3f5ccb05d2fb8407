"""Line and table files: labelled texts, lexicons, feature rows, evaluations, stored models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELLED = "id string, label int, `group` string, text string"


def labelled_texts(spark: SparkSession, path: str) -> DataFrame:
    """``id, label, group, text`` of JSON lines; lines that are no JSON object are skipped."""
    lines = spark.read.schema(f"{LABELLED}, bad string").option("columnNameOfCorruptRecord", "bad").json(path)
    return lines.where("bad is null").drop("bad")


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``word, zipf`` of tab-separated lines, packed or not; lines without a number are skipped."""
    rows = spark.read.schema("word string, zipf double").options(sep="\t", quote="", mode="DROPMALFORMED").csv(path)
    return rows.where("word is not null and zipf is not null")


def write_features(rows: DataFrame, path: str) -> None:
    """Feature rows as JSON lines, vectors as arrays."""
    rows.write.mode("overwrite").json(path)


def formatted_evaluation(evaluation: DataFrame) -> DataFrame:
    """A line of text per group, in order of the groups: ``line``."""
    dash = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.format_string("%.1f", c))
    line = F.format_string("%-24s %6d %6d %8s %8s %8s", "grp", "docs", "scored", dash("ge20"), dash("gt0"), dash("mean"))
    return evaluation.orderBy("grp").select(line.alias("line"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Adds read pages to a cache, a folder a day of reading. ``pages``: ``url, fetched, failed, text``."""
    pages.withColumn("day", F.to_date("fetched")).write.mode("append").partitionBy("day").parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The cache with one row per page, the last that was read."""
    last = spark.read.parquet(path).drop("day").groupBy("url").agg(F.max_by(F.struct("fetched", "failed", "text"), "fetched").alias("p"))
    return last.select("url", "p.*")
