"""Source search: phrases and keywords to search for, hits by page, deduplication, page cache."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lists, urls
from ..functions import text as T


def word_zipf(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``word, zipf`` of the distinct words of ``words`` that the lexicon has, or has up to their first apostrophe."""
    vocabulary = words.select("word").distinct()
    direct = vocabulary.join(lexicon, "word")
    prefix = F.substring_index("word", "'", 1)
    cut = vocabulary.where((F.instr("word", "'") > 1)).join(lexicon, "word", "left_anti").select("word", prefix.alias("stem"))
    return direct.select("word", "zipf").unionByName(cut.join(lexicon.withColumnRenamed("word", "stem"), "stem").select("word", "zipf"))


def top_keywords(docs: DataFrame, lexicon: DataFrame, n: int = 8) -> DataFrame:
    """``doc_id, rank, word, score``: frequent rare words; ties by the word."""
    words = docs.select("doc_id", F.explode(T.norms(F.col("text"))).alias("word"))
    words = words.where((F.octet_length("word") >= 4) & ~F.col("word").rlike("^[0-9]+$") & ~F.col("word").isin(lists.STOPWORDS))
    counts = words.groupBy("doc_id", "word").agg(F.count("*").alias("c"))
    counts = counts.join(word_zipf(counts, lexicon), "word", "left")
    z = F.when(F.coalesce("zipf", F.lit(0.0)) == 0, 2.0).otherwise(F.col("zipf"))
    scored = counts.select("doc_id", "word", F.round(F.col("c") * (7 - z), 6).alias("score"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "word")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("doc_id", "rank", "word", "score")


def phrase_candidates(docs: DataFrame) -> DataFrame:
    """Up to 14 words from the middle of every sentence before the references with at least 8: ``doc_id, pos, phrase, norms``; the phrase keeps the original spelling."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                text = text or ""
                bib, pos = T.bibliography_start(text), 0
                for s, e in T.sentence_spans(text):
                    if 0 <= bib <= s:
                        break
                    part = text[s:e]
                    tokens = T.token_spans(part)
                    if len(tokens) < 8:
                        continue
                    first = max(0, (len(tokens) - 14) // 2)
                    mid = tokens[first : first + 14]
                    out.append((doc, pos, " ".join(part[x:y] for _, x, y in mid), [w for w, _, _ in mid]))
                    pos += 1
            yield pd.DataFrame(out, columns=["doc_id", "pos", "phrase", "norms"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, pos int, phrase string, norms array<string>")


def search_phrases(docs: DataFrame, lexicon: DataFrame, most: int = 40) -> DataFrame:
    """``doc_id, bucket, pos, phrase``: all candidates if there are at most ``most``, else the most distinctive of each of ``most`` buckets in order, the first of equal ones."""
    cands = phrase_candidates(docs)
    words = cands.select("doc_id", "pos", F.explode("norms").alias("word"))
    words = words.join(word_zipf(words, lexicon), "word", "left")
    gain = F.when(F.col("word").isin(lists.STOPWORDS), 0.0).otherwise(F.greatest(F.lit(0.0), 6 - F.coalesce("zipf", F.lit(0.0))))
    score = words.groupBy("doc_id", "pos").agg((F.sum(gain) / F.count("*")).alias("score"))
    n = F.count("*").over(Window.partitionBy("doc_id"))
    held = cands.select("doc_id", "pos", "phrase").join(score, ["doc_id", "pos"]).withColumn("n", n)
    # the bucket k with floor(k n / most) <= pos < floor((k + 1) n / most)
    bucket = F.when(F.col("n") <= most, F.col("pos")).otherwise(F.floor((F.col("pos") * most + most - 1) / F.col("n")))
    held = held.withColumn("bucket", bucket.cast("int"))
    order = Window.partitionBy("doc_id", "bucket").orderBy(F.desc(F.round("score", 9)), "pos")
    return held.withColumn("k", F.row_number().over(order)).where("k = 1").select("doc_id", "bucket", "pos", "phrase")


def database_queries(phrases: DataFrame, keywords: DataFrame, most: int = 6) -> DataFrame:
    """Queries for the databases: the keywords as one query, then every fourth phrase, ``most`` in all: ``doc_id, rank, query``."""
    words = keywords.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("w"))
    first = words.select("doc_id", F.lit(-1).alias("pos"), F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("query"))
    every = phrases.where(F.col("bucket") % 4 == 0).select("doc_id", F.col("bucket").alias("pos"), F.col("phrase").alias("query"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    return first.unionByName(every).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("doc_id", "rank", "query")


def url_hits(hits: DataFrame) -> DataFrame:
    """Pages by normalized URL: ``page, hits, title, snippets``. Of each search the first six hits count, skipped hosts among them.

    ``hits``: ``query_id, pos, url, title, snippet``.
    """
    counted = hits.where((F.col("pos") < 6) & ~urls.is_skipped(F.col("url"))).withColumn("page", urls.normalize(F.col("url")))
    place = F.struct("query_id", "pos")
    named = F.array_sort(F.collect_list(F.when(F.coalesce("snippet", F.lit("")) != "", F.struct("query_id", "pos", "snippet"))))
    return counted.groupBy("page").agg(
        F.count("*").alias("hits"), F.min_by("title", place).alias("title"), F.transform(named, lambda x: x["snippet"]).alias("snippets")
    )


def top_pages(pages: DataFrame, most: int = 40) -> DataFrame:
    """The pages with most hits; ties by URL."""
    return pages.orderBy(F.desc("hits"), "page").limit(most)


def dedupe_sources(sources: DataFrame) -> DataFrame:
    """One source per reference or normalized URL: that with most blocks, with the first one's id. ``sources``: ``id, ref, url, n_blocks`` and more."""
    key = F.when(F.coalesce("ref", F.lit("")) != "", F.col("ref")).otherwise(urls.normalize(F.col("url")))
    keyed = sources.withColumn("key", key)
    order = Window.partitionBy("key").orderBy(F.desc("n_blocks"), "id")
    kept = keyed.withColumn("k", F.row_number().over(order)).withColumn("first_id", F.min("id").over(Window.partitionBy("key")))
    return kept.where("k = 1").withColumn("id", F.col("first_id")).drop("k", "key", "first_id")


def fresh_pages(cache: DataFrame, now: str) -> DataFrame:
    """Cached pages that still count: 30 days if read, 24 hours if failed. ``cache``: ``url, fetched, failed``."""
    age = F.to_timestamp(F.lit(now)) - F.col("fetched")
    return cache.where(age <= F.when(F.col("failed"), F.expr("interval 24 hours")).otherwise(F.expr("interval 30 days")))


def page_bodies(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """``page, title, text``: the cached text, or the snippets joined by line feeds where there is none."""
    got = cache.select(F.col("url").alias("page"), F.col("text").alias("cached"))
    text = F.when(F.trim(F.coalesce("cached", F.lit(""))) != "", F.col("cached")).otherwise(F.array_join("snippets", "\n"))
    return pages.join(got, "page", "left").select("page", "title", text.alias("text"))


def run_notes(runs: DataFrame) -> DataFrame:
    """``engine, note`` from ``engine, failed``: all failed, more than a third failed, or nothing."""
    bad, n = F.count_if("failed"), F.count("*")
    counted = runs.groupBy("engine").agg(bad.alias("bad"), n.alias("n"))
    note = F.when(F.col("bad") == F.col("n"), "all searches failed").when(F.col("bad") * 3 > F.col("n"), F.concat("bad", F.lit(" of "), "n", F.lit(" searches failed")))
    return counted.select("engine", F.coalesce(note, F.lit("")).alias("note"))
