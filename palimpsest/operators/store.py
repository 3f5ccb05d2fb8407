"""Tables of submissions and assignments: lookups, replacement, cascades, summaries, integrity flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lists
from ..functions import text as T


def replace_rows(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Insert or replace whole rows by key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def update_rows(table: DataFrame, changed: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Replaces some columns of the rows named in ``changed``."""
    new = changed.select(key, *(F.col(c).alias(f"{c}__new") for c in columns), F.lit(True).alias("hit__"))
    joined = table.join(new, key, "left")
    return joined.select(*(F.when(F.col("hit__"), F.col(f"{c}__new")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns))


def delete_rows(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids, key, "left_anti")


def delete_assignments(assignments: DataFrame, submissions: DataFrame, shingles: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deletes assignments with their submissions and these submissions' shingles."""
    gone = submissions.join(ids.withColumnRenamed("id", "assignment"), "assignment", "left_semi").select("id")
    return delete_rows(assignments, ids), delete_rows(submissions, gone), delete_rows(shingles, gone.withColumnRenamed("id", "doc_id"), "doc_id")


def save_assignments(old: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Saves assignments: a blank name becomes a placeholder, the time of creation is kept on update. Columns ``id, name, created``."""
    name = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "Untitled assignment").otherwise(F.col("name"))
    was = old.select("id", F.col("created").alias("was"))
    fresh = new.join(was, "id", "left").select("id", name.alias("name"), F.coalesce("was", F.to_timestamp(F.lit(now))).alias("created"))
    return replace_rows(old.select("id", "name", "created"), fresh)


def settings(max_queries: int = 0, max_pages: int = 0) -> dict[str, int]:
    """Defaults and bounds: 40 of nothing, at most 200 queries and 150 pages."""
    return {"max_queries": min(max_queries if max_queries > 0 else 40, 200), "max_pages": min(max_pages if max_pages > 0 else 40, 150)}


def assignment_counts(assignments: DataFrame, submissions: DataFrame) -> DataFrame:
    """``id, name, papers``, newest first."""
    n = submissions.groupBy(F.col("assignment").alias("id")).agg(F.count("*").alias("papers"))
    return assignments.join(n, "id", "left").select("id", "name", "created", F.coalesce("papers", F.lit(0)).alias("papers")).orderBy(F.desc("created"), "id")


def repository_titles(matches: DataFrame, submissions: DataFrame, assignments: DataFrame) -> DataFrame:
    """Adds ``title`` and ``url`` of repository sources: the paper's assignment and day of upload, with defaults where they are gone."""
    subs = submissions.select(F.col("id").alias("src_id"), "assignment", "uploaded")
    named = matches.join(subs, "src_id", "left").join(assignments.select(F.col("id").alias("assignment"), F.col("name")), "assignment", "left")
    title = F.concat(F.lit("Paper submitted to "), F.coalesce("name", F.lit("another assignment")), F.coalesce(F.concat(F.lit(" on "), F.date_format("uploaded", "yyyy-MM-dd")), F.lit("")))
    return named.withColumn("title", title).drop("name", "uploaded", "assignment")


def replaced_chars(docs: DataFrame) -> DataFrame:
    """``doc_id, replaced``: look-alike letters and invisible characters next to a Latin letter."""
    latin = r"[\p{L}&&[\x00-\x{24F}]]"
    marks = "".join(lists.LOOKALIKES) + lists.SUSPICIOUS
    n = F.regexp_count("text", F.lit(f"[{marks}](?={latin})|(?<={latin})[{marks}]"))
    return docs.select("doc_id", F.coalesce(n, F.lit(0)).cast("long").alias("replaced"))


def hidden_words(docs: DataFrame) -> DataFrame:
    """``doc_id, words`` in hidden spans. ``docs``: ``doc_id, text, hidden`` with spans in UTF-8 bytes, as the readers of files give them."""
    part = F.explode_outer("hidden")
    one = docs.select("doc_id", "text", part.alias("h"))
    n = F.size(T.norms(F.expr("decode(substring(encode(text, 'UTF-8'), h.start + 1, h.end - h.start), 'UTF-8')")))
    return one.groupBy("doc_id").agg(F.coalesce(F.sum(F.when(F.col("h").isNotNull(), n)), F.lit(0)).alias("words"))


def integrity_flags(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, title, count`` of what looks like tampering. ``docs``: ``doc_id, text, hidden_words``."""
    both = replaced_chars(docs).join(docs.select("doc_id", "hidden_words"), "doc_id")
    found = F.explode(F.array(
        F.struct(F.lit("replaced").alias("kind"), F.lit("Replaced characters").alias("title"), F.col("replaced").alias("count")),
        F.struct(F.lit("hidden").alias("kind"), F.lit("Hidden text").alias("title"), F.col("hidden_words").alias("count")),
    ))
    return both.select("doc_id", found.alias("f")).select("doc_id", "f.*").where("count > 0")
