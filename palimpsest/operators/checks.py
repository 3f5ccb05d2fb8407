"""From submitted files to checked papers: submission rows, origins of sources, the check itself, and what lists and pages show of it."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import urls
from . import align, authorship, overlap, report
from .report import Filters

LEAST_PASTED = 20


# ---- small expressions ----


def author_guess(base: Column) -> Column:
    """An author from a file name without its ending: the first two words, nothing if there are fewer. Underscores, hyphens and full stops part words."""
    words = F.filter(F.split(F.translate(base, "_-.", "   "), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 2), " ")).otherwise("")


def first_filled(*values: Column) -> Column:
    """The first value that is more than white space, as it is; an empty text if there is none."""
    return F.coalesce(*(F.when(v.rlike(r"[^\s]"), v) for v in values), F.lit(""))


def shown_percent(share: Column) -> Column:
    """``<1%`` between 0 and 1, else the rounded number."""
    return F.when((share > 0) & (share < 1), "<1%").otherwise(F.concat(F.floor(share + 0.5).cast("string"), F.lit("%")))


def band(percent: Column) -> Column:
    """Colour band of a similarity index."""
    return F.when(percent == 0, "none").when(percent < 25, "low").when(percent < 50, "medium").when(percent < 75, "high").otherwise("very high")


# ---- submissions ----


def submissions(files: DataFrame, now: str) -> DataFrame:
    """Rows of new papers from ``id, assignment, name, text`` and, given by hand, ``author, title``.

    A title that is not given is the file name without its ending, an author is guessed from it. A text without a file name (pasted) needs ``LEAST_PASTED`` words;
    shorter ones get the status ``error``.
    """
    name = F.coalesce("name", F.lit(""))
    base = F.regexp_replace(name, r"\.[^.]*$", "")
    text = F.coalesce("text", F.lit(""))
    rows = files.select("id", "assignment", name.alias("name"), base.alias("base"), text.alias("text"), *(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("author", "title")))
    rows = rows.withColumn("words", F.size(T.norms(F.col("text"))).cast("long"))
    short = (F.col("name") == "") & (F.col("words") < LEAST_PASTED)
    return rows.select(
        "id", "assignment", "name", first_filled(F.col("title"), F.col("base")).alias("title"), F.when(F.col("author") != "", F.col("author")).otherwise(author_guess(F.col("base"))).alias("author"),
        "text", "words", F.length("text").cast("long").alias("chars"), F.when(short, "error").otherwise("queued").alias("status"), F.to_timestamp(F.lit(now)).alias("uploaded"),
    )


def with_default_assignment(assignments: DataFrame, name: str, now: str) -> DataFrame:
    """``id, name, created``; one assignment of the given name where there is none."""
    default = assignments.sparkSession.range(1).select(F.lit("default").alias("id"), F.lit(name).alias("name"), F.to_timestamp(F.lit(now)).alias("created"))
    count = assignments.agg(F.count("*").alias("n"))
    return assignments.select("id", "name", "created").unionByName(default.join(count).where("n = 0").drop("n"))


def repository_size(papers: DataFrame) -> DataFrame:
    """``papers``: how many distinct papers are in the repository."""
    return papers.agg(F.count_distinct("doc_id").alias("papers"))


def neighbours(papers: DataFrame) -> DataFrame:
    """Adds ``previous, next``: the papers before and after in the list of an assignment, newest first. ``papers``: ``id, assignment, uploaded``."""
    order = Window.partitionBy("assignment").orderBy(F.desc("uploaded"), "id")
    return papers.select("*", F.lag("id").over(order).alias("previous"), F.lead("id").over(order).alias("next"))


def ranked_pairs(pairs: DataFrame) -> DataFrame:
    """Adds ``rank``: pairs of a cohort by shared words, most first; ties by the two papers. ``pairs``: ``cohort, a, b, words``."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("cohort").orderBy(F.desc("words"), "a", "b")))


# ---- sources ----


def origins(**found: DataFrame) -> DataFrame:
    """Sources of all origins in one table, with their ``origin``. Each: ``src_id, url, title, type, text``."""
    tables = [t.select(F.lit(name).alias("origin"), "src_id", "url", "title", "type", "text") for name, t in found.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def publications_only(sources: DataFrame, web: bool) -> DataFrame:
    """All sources, or publications alone where the web is not to be searched."""
    return sources if web else sources.where(F.col("type") == "Publication")


def _one_per_page(blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """Blocks of one source per paper and page: that with most blocks, the first of equal ones."""
    n = blocks.groupBy("sub_id", "src_id").agg(F.count("*").alias("n"))
    page = F.when(F.coalesce("url", F.lit("")) != "", urls.normalize(F.col("url"))).otherwise(F.concat(F.lit("\x00"), F.col("src_id").cast("string")))
    keyed = n.join(sources.select("src_id", page.alias("page")), "src_id")
    order = Window.partitionBy("sub_id", "page").orderBy(F.desc("n"), "src_id")
    kept = keyed.withColumn("k", F.row_number().over(order)).where("k = 1").select("sub_id", "src_id")
    return blocks.join(kept, ["sub_id", "src_id"], "left_semi")


# ---- the check ----


def check_submissions(subs: DataFrame, repository: DataFrame, found: DataFrame, filters: Filters = Filters(), web: bool = True) -> DataFrame:  # noqa: B008
    """Checks papers against a repository and found sources: the columns of a report and ``status, words``, a row per paper.

    ``subs``: ``doc_id, text``. ``repository``: ``doc_id, title, text``; a paper is not compared with itself. ``found``: ``src_id, url, title, type, text`` with ids of zero
    or more; papers of the repository are sources ``-1 - doc_id``. A paper without words gets the status ``error`` and an empty report, so it fails no other.
    """
    papers = subs.select(F.col("doc_id").alias("sub_id"), "text")
    stored = repository.select((-1 - F.col("doc_id")).alias("src_id"), F.lit("").alias("url"), "title", F.lit("Student Paper").alias("type"), "text")
    near = overlap.candidates(papers, repository.select(F.col("doc_id").alias("src_id"), "text")).select("sub_id", (-1 - F.col("src_id")).alias("src_id"))
    online = publications_only(found.select("src_id", "url", "title", "type", "text"), web)
    sources = origins(repository=stored, online=online)
    pairs = near.unionByName(align.seeded_pairs(papers, online))
    blocks = _one_per_page(align.match_passages(pairs, papers, sources), sources)
    out = report.similarity_reports(subs.select("doc_id", "text"), blocks, sources, filters)
    return out.withColumn("status", F.when(F.col("total_words") == 0, "error").otherwise("done"))


def detect_ai(docs: DataFrame, lexicon: DataFrame, model: PipelineModel, threshold: float = authorship.THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Machine authorship of whole papers: a row per paper as from ``authorship.ai_reports``, and ``doc_id, sentence, score, flagged`` of its qualifying sentences."""
    docs = docs.select("doc_id", "text")
    sentences = authorship.sentence_words(docs)
    windows = authorship.score_windows(authorship.vectors(authorship.featurize(docs, lexicon)), model)
    smoothed = authorship.smooth(authorship.sentence_scores(windows), threshold)
    result = authorship.ai_reports(docs, sentences, smoothed)
    shown = smoothed.join(result.where("available").select("doc_id"), "doc_id", "left_semi")
    return result, shown


# ---- what is shown ----


def summaries(papers: DataFrame, reports: DataFrame, ai: DataFrame, flags: DataFrame) -> DataFrame:
    """The rows of an assignment's list: ``id, assignment, title, author, status, words, percent, ai, ai_available, flags``."""
    count = flags.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("flags"))
    index = reports.select(F.col("doc_id").alias("id"), F.col("index_percent").alias("percent"))
    score = ai.select(F.col("doc_id").alias("id"), F.col("percent").alias("ai"), F.col("available").alias("ai_available"))
    rows = papers.join(index, "id", "left").join(score, "id", "left").join(count, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("id", "assignment", "title", "author", "status", "words", zero("percent"), zero("ai"), F.coalesce("ai_available", F.lit(False)).alias("ai_available"), zero("flags"))


def visible_blocks(blocks: DataFrame, highlights: DataFrame, excluded: DataFrame) -> DataFrame:
    """Blocks whose excerpt is shown: those that a highlight is left of, and those excluded by hand. All: ``doc_id, src_id, block``."""
    keys = ["doc_id", "src_id", "block"]
    return blocks.join(highlights.select(*keys).unionByName(excluded.select(*keys)).distinct(), keys, "left_semi")


def highlight_layers(**layers: DataFrame) -> DataFrame:
    """Spans of all layers in one table: ``doc_id, layer, start, end``."""
    tables = [t.select("doc_id", F.lit(name).alias("layer"), "start", "end") for name, t in layers.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def database_notes(runs: DataFrame) -> DataFrame:
    """``database, note`` of databases of which no query worked. ``runs``: ``database, failed``."""
    return runs.groupBy("database").agg(F.bool_and("failed").alias("none")).where("none").select("database", F.concat("database", F.lit(" could not be searched")).alias("note"))
