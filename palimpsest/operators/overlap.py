"""Relational text-reuse operators: shingles, candidates, exact passages, indexes and cohort overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

K = 5
MIN_WORDS = 7


def shingle_table(docs: DataFrame, key: str = "doc_id", extra: list[str] | None = None) -> DataFrame:
    """Distinct five-word shingles of each text: ``key, extra, shingle`` (a 64-bit hash of its words' hashes). Words are hashed before they are joined, so no string is built for a shingle."""

    def runs(h: Column) -> Column:
        # the five words from each place on, side by side
        ahead = [F.slice(h, F.lit(1 + k), F.greatest(F.size(h) - (K - 1), F.lit(0))) for k in range(K)]
        return F.array_distinct(F.transform(F.arrays_zip(*(x.alias(f"w{k}") for k, x in enumerate(ahead))), lambda w: F.xxhash64(*(w[f"w{k}"] for k in range(K)))))

    hashes = F.transform(T.norms(F.col("text")), lambda w: F.xxhash64(w))
    return docs.select(key, *(extra or []), F.explode(T.let(hashes, runs)).alias("shingle"))


def shingle_frequency(docs: DataFrame) -> DataFrame:
    """How many documents hold each shingle, as a histogram: ``df, shingles``."""
    df = shingle_table(docs).groupBy("shingle").agg(F.count("*").alias("df"))
    return df.groupBy("df").agg(F.count("*").alias("shingles"))


def candidates(subs: DataFrame, repo: DataFrame, max_df: int = 200, min_shared: int = 2) -> DataFrame:
    """Pairs of a submission and another repository text with enough shared shingles: ``sub_id, src_id, shared``.

    Shingles that more than ``max_df`` repository texts hold are dropped before the join, so no shingle joins more than ``max_df`` times.
    """
    held = shingle_table(repo, "src_id")
    common = held.groupBy("shingle").agg(F.count("*").alias("df")).where(F.col("df") <= max_df).select("shingle")
    rare = held.join(common, "shingle", "left_semi")
    return (
        shingle_table(subs, "sub_id")
        .join(rare, "shingle")
        .where("sub_id <> src_id")
        .groupBy("sub_id", "src_id")
        .agg(F.count("*").alias("shared"))
        .where(F.col("shared") >= min_shared)
    )


def positions(docs: DataFrame, key: str, extra: list[str] | None = None) -> DataFrame:
    """Shingle occurrences with positions: ``key, extra, pos, shingle``."""
    return docs.select(key, *(extra or []), F.posexplode(T.grams(T.norms(F.col("text")), K)).alias("pos", "gram")).select(
        key, *(extra or []), "pos", F.xxhash64("gram").alias("shingle")
    )


def exact_passages(subs: DataFrame, sources: DataFrame, min_words: int = MIN_WORDS, extra: list[str] | None = None) -> DataFrame:
    """Maximal runs of equal words: ``sub_id, src_id, sub_from, sub_to, src_from, words``.

    Equal shingles on one diagonal that follow each other are one run (gaps and islands). Only the source side's distinct shingles reach the join.
    """
    a, b = positions(subs, "sub_id", extra), positions(sources, "src_id", extra).withColumnRenamed("pos", "src_pos")
    on = ["shingle", *(extra or [])]
    hits = a.join(b, on).select("sub_id", "src_id", "pos", (F.col("pos") - F.col("src_pos")).alias("diag"))
    order = Window.partitionBy("sub_id", "src_id", "diag").orderBy("pos")
    runs = hits.withColumn("island", F.col("pos") - F.row_number().over(order))
    runs = runs.groupBy("sub_id", "src_id", "diag", "island").agg(F.min("pos").alias("sub_from"), (F.max("pos") + K).alias("sub_to"))
    return runs.where(F.col("sub_to") - F.col("sub_from") >= min_words).select(
        "sub_id", "src_id", "sub_from", "sub_to", (F.col("sub_from") - F.col("diag")).alias("src_from"), (F.col("sub_to") - F.col("sub_from")).alias("words")
    )


def covered_words(passages: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct covered positions by keys: ``keys, matched``. Runs are merged by a running maximum, not expanded word by word."""
    order = Window.partitionBy(*keys).orderBy("sub_from", "sub_to").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max("sub_to").over(order), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("sub_to") - F.greatest(F.col("sub_from"), done))
    return passages.select(*keys, "sub_from", "sub_to").withColumn("fresh", fresh).groupBy(*keys).agg(F.sum("fresh").cast("long").alias("matched"))


def token_counts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(T.norms(F.col("text"))).cast("long").alias("tokens"))


def similarity_index(subs: DataFrame, sources: DataFrame) -> DataFrame:
    """Exact-run similarity index of every submission: ``doc_id, total_words, matched_words, index_percent, index_exact``."""
    matched = covered_words(exact_passages(subs.withColumnRenamed("doc_id", "sub_id"), sources), ["sub_id"]).withColumnRenamed("sub_id", "doc_id")
    m, n = F.coalesce("matched", F.lit(0)), F.col("tokens")
    return token_counts(subs).join(matched, "doc_id", "left").select(
        "doc_id", n.alias("total_words"), m.cast("long").alias("matched_words"), T.percent(m, n).alias("index_percent"),
        F.round(100 * m / F.greatest(n, F.lit(1)), 6).alias("index_exact"),
    )


def coverage_by_type(subs: DataFrame, sources: DataFrame) -> DataFrame:
    """Coverage by the sources' type, each type on its own: ``doc_id, type, percent``."""
    runs = exact_passages(subs.withColumnRenamed("doc_id", "sub_id"), sources).join(sources.select("src_id", "type"), "src_id")
    matched = covered_words(runs, ["sub_id", "type"]).withColumnRenamed("sub_id", "doc_id")
    return matched.join(token_counts(subs), "doc_id").select("doc_id", "type", T.percent(F.col("matched"), F.col("tokens")).alias("percent"))
