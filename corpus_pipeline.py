"""A training-corpus pipeline of five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontam, langid, linededup, minhash, packing
from palimpsest.llm.common import few_files, materialize, read, release

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those with nothing in common with any language learned from ``lang``, however many languages there are.

    Null and empty texts have no letter. Where no row has a language, nothing can be rejected but texts without a letter. Repeated rows stay or go together; whole texts count; an empty table stays empty.
    """
    model = langid.fit(docs)
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).select(*COLUMNS)
    scored = langid.predict(docs.select(*COLUMNS), model, COLUMNS)
    return few_files(scored.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("claim") != 0)).select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes lines that an earlier document holds in an aligned block; documents of which no line is left go.

    Null and empty texts have nothing to delete and stay, and so do rows without an id. Repeated rows lose the same lines. Whole texts are compared; an empty table stays empty.
    """
    out = linededup.dedup_lines(docs.select(*COLUMNS))
    blank = F.trim(F.translate(F.coalesce("text", F.lit("")), "\n\r\t", "   ")) == ""
    kept = out.where((F.col("n_dropped") == 0) | ~blank)
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS).transform(few_files)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates (five-word shingles, 0.8).

    Empty texts and rows without an id are in no group and stay; repeated rows are one document and stay or go together. Whole texts are compared; an empty table stays empty.
    """
    found = minhash.near_duplicates(docs, shingle=5).where(~F.col("kept")).select("doc_id").distinct()
    return few_files(docs.select(*COLUMNS).join(found, "doc_id", "left_anti").select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of eight words of a benchmark item.

    Items of fewer than eight words count only together with another item, as one such item can be a common phrase. Null and word-less texts hold no window; a null id is an id like any other, and
    rows that share an id go together. Whole texts are searched; without items nothing goes, and an empty table stays empty.
    """
    items = read(spark, sf_dir, "benchmark")
    found = materialize(decontam.decontaminate(docs, items, min_items=2, near_share=None).where("n_items > 0").select("doc_id", "contaminated", "items"), "contaminated")
    long = items.where(F.size(decontam.word_array(F.col("text"))) >= 8).select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item")).distinct()
    holds = found.select("doc_id", F.explode("items").alias("item")).join(long, "item", "left_semi").select("doc_id")
    gone = holds.unionByName(found.where("contaminated").select("doc_id")).distinct()
    kept = docs.select(*COLUMNS)
    return few_files(kept.join(gone, kept["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti").select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into sequences of 4096 tokens.

    Null and empty texts are the end id alone; every row is packed, repeated ones too, whatever its length; an empty table gives no rows.
    """
    return packing.packed_digest(docs)


STAGES = [("language", language), ("lines", lines), ("near", near), ("benchmark", benchmark), ("packing", packed)]

#: SQL can express neither the trained model of the first stage nor the tokenizer of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``, each on what the one before has written; see the stages for nulls, repeated rows and empty tables."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
