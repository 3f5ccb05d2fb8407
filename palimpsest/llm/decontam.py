"""Benchmark decontamination over a positional inverted index (DataFrame and SQL functions only).

The index stores a posting ``(document, pos, term)`` for each word of a document that is a
test term. It is split by document, so building it needs no shuffle. Counts of the
postings tell which terms of a test window are rarest. The list of a window's rarest term,
moved back by the term's offset in the item, gives diagonals; the list of the next term is looked up where it
must stand on them. What is left names (document, item, diagonal) candidates, and the lists of all other terms are
intersected with these to confirm whole windows. Document texts are read once, to build the index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, materialize, read, release, small

#: A document: rows that share an id but not the text are told apart by a hash of the text.
DOC = ["doc_id", "version"]

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split_words(text: Column) -> Column:
    """Pieces between separators; the first and the last may be empty."""
    return F.split(ascii_lower(text), SEPARATORS, -1)


def word_array(text: Column) -> Column:
    return F.filter(split_words(F.coalesce(text, F.lit(""))), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Words of a text without building them one by one in a lambda; 0 for null."""
    w = split_words(F.coalesce(text, F.lit("")))
    first = F.when(F.element_at(w, 1) == "", 1).otherwise(0)
    last = F.when((F.element_at(w, -1) == "") & (F.size(w) > 1), 1).otherwise(0)
    return (F.size(w) - first - last).cast("long")


@dataclass
class TestItems:
    """Distinct word sequences of the test set, and which item ids carry each."""

    passages: DataFrame  # passage, words, size (window length)
    members: DataFrame  # passage, item_id


def test_items(benchmark: DataFrame, window: int) -> TestItems:
    items = benchmark.select("item_id", word_array(F.col("text")).alias("words")).where(F.size("words") > 0)
    passages = materialize(
        items.select("words").distinct().select(
            F.monotonically_increasing_id().alias("passage"), "words", F.least(F.size("words"), F.lit(window)).alias("size")
        ),
        "passages",
    )
    members = items.distinct().join(passages.select("passage", "words"), "words").select("passage", "item_id").distinct()
    return TestItems(passages, materialize(members, "members"))


def _version(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["version"] == b["version"])


def build_index(docs: DataFrame, items: TestItems) -> DataFrame:
    """Postings of the test terms: ``doc_id, version, pos, term``, split by document as the input is."""
    vocabulary = items.passages.select(F.explode("words").alias("term")).distinct()
    words = docs.select("doc_id", _version(F.col("text")).alias("version"), F.posexplode(split_words(F.col("text"))).alias("pos", "term")).where(F.col("term") != "")
    return materialize(words.join(small(vocabulary), "term", "left_semi").select(*DOC, "pos", "term"), "postings")


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 8, slop: int = 4, near_share: float | None = 0.8) -> DataFrame:
    """Exact phrase and proximity matches.

    ``docs``: ``doc_id, text``; ``benchmark``: ``item_id, text``. A window is ``window``
    consecutive words of an item; an item with fewer (but some) words is one window.
    Returns, per document with a match, ``doc_id, version`` (a hash of its text), ``hits`` (sorted word positions inside any
    occurrence of a window; positions count from the first piece of the text),
    ``passages`` (those with an occurring window) and ``near`` (those of which at
    least ``near_share`` of the distinct words lie, in any order, in a stretch of the text as long as the item and ``slop`` words on each side; none if ``near_share`` is None).

    Nulls: null and word-less texts have no words; a null ``doc_id`` or ``item_id`` is an id
    like any other. Rows that share a ``doc_id`` and differ in text are documents of their own; of repeated rows each gets what one has. Repeated items count once per id.
    Texts of any length are indexed whole, a posting a row. An empty table gives no rows. Of terms that are equally rare the first in the window is looked up first, which changes no result.
    """
    items = test_items(benchmark, window)
    return _matches(docs, build_index(docs, items), items, slop, near_share)


def _proximity(postings: DataFrame, counts: DataFrame, items: TestItems, slop: int, near_share: float) -> DataFrame:
    """``doc_id, version, near``: passages of which enough distinct words lie in one stretch of a document.

    At most ``x`` of a passage's words may be missing, so of its ``r`` rarest words a document needs ``r - x``. Only for such documents are the other
    postings read; as a position holds one word, a stretch has no more postings than positions, and checking is linear in the document.
    """
    words = items.passages.select("passage", (F.size("words") + 2 * slop).alias("span"), F.array_distinct("words").alias("words"))
    words = words.withColumn("least", F.expr(f"int(ceil({near_share} * size(words)))"))
    words = words.withColumn("r", F.expr("least(size(words), 2 * (size(words) - least) + 3)")).withColumn("need", F.expr("greatest(1, r - size(words) + least)"))
    terms = words.select("passage", "span", "least", "r", "need", F.explode("words").alias("term")).join(small(counts), "term", "left")
    order = Window.partitionBy("passage").orderBy(F.coalesce("n", F.lit(0)), "term")
    terms = materialize(terms.withColumn("rank", F.row_number().over(order)).drop("n"), "near-terms")
    rare = terms.where("rank <= r").select("passage", "need", "term")
    held = postings.join(small(rare), "term").groupBy(*DOC, "passage", "need").agg(F.size(F.collect_set("term")).alias("held"))
    able = materialize(held.where("held >= need").select(*DOC, "passage"), "able")
    found = postings.join(small(able.select(*(F.col(c).alias(f"{c}__") for c in DOC), "passage")), F.col("doc_id").eqNullSafe(F.col("doc_id__")) & (F.col("version") == F.col("version__")))
    found = found.join(small(terms.select("passage", "term", "span", "least")), ["passage", "term"])
    found = found.groupBy(*DOC, "passage", "span", "least").agg(F.sort_array(F.collect_set(F.struct("pos", "term"))).alias("list"))
    inside = "transform(filter(slice(list, i, span), x -> x.pos < list[i - 1].pos + span), x -> x.term)"
    found = found.where("size(list) >= least").where(F.expr(f"exists(sequence(1, size(list)), i -> size(array_distinct({inside})) >= least)"))
    out = materialize(found.groupBy(*DOC).agg(F.collect_set("passage").alias("near")), "near")
    release(terms, able)
    return out


def _lookup(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (a written table with ``doc_id, version, pos, term``) that are postings."""
    there = small(wanted)
    if there is wanted:
        there = wanted.hint("shuffle_hash")  # the index is streamed past it, not sorted
    return postings.join(there, _same(postings, wanted) & (postings["pos"] == wanted["pos"]) & (postings["term"] == wanted["term"])).select(*(wanted[c] for c in wanted.columns))


def _matches(docs: DataFrame, postings: DataFrame, items: TestItems, slop: int, near_share: float | None) -> DataFrame:
    counts = materialize(postings.groupBy("term").agg(F.count("*").alias("n")), "counts")
    windows = items.passages.select(
        "passage", "size", "words", F.explode(F.expr("sequence(0, size(words) - size)")).alias("w")
    ).select("passage", "w", "size", F.posexplode(F.expr("slice(words, w + 1, size)")).alias("off", "term"))
    # windows whose terms all occur: the rarest term and the next one, by their counts of postings, with their places in the item
    place = F.struct("n", "off", (F.col("w") + F.col("off")).alias("q"), "term")
    needs = windows.join(small(counts), "term").groupBy("passage", "w", "size").agg(F.count("*").alias("found"), F.array_sort(F.collect_list(place)).alias("t")).where("found = size")
    probes = needs.select("passage", F.expr("t[0].q").alias("q1"), F.expr("t[0].term").alias("first"), F.expr("get(t, 1).q").alias("q2"), F.expr("get(t, 1).term").alias("second"))
    probes = materialize(probes.distinct(), "probes")
    # offset-adjusted list of the rarest term: a posting at item position q lies on diagonal pos - q
    starts = postings.join(small(probes.withColumnRenamed("first", "term")), "term")
    starts = starts.select(*DOC, "passage", (F.col("pos") - F.col("q1")).alias("diag"), (F.col("pos") - F.col("q1") + F.col("q2")).alias("pos"), F.col("second").alias("term"))
    starts = materialize(starts, "starts")
    met = _lookup(postings.join(small(probes.select(F.col("second").alias("term")).distinct()), "term", "left_semi"), starts)
    candidates = met.unionByName(starts.where("term is null")).select(*DOC, "passage", "diag").distinct()
    # the other lists, at the places where a candidate's item has their terms
    wanted = candidates.join(small(items.passages), "passage").select(*DOC, "passage", "diag", "size", F.posexplode("words").alias("k", "term"))
    wanted = materialize(wanted.withColumn("pos", F.col("diag") + F.col("k")), "wanted")
    seen = _lookup(postings, wanted).groupBy(*DOC, "passage", "diag", "size").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    whole = "filter(sequence(0, size(ks) - size), i -> ks[i + size - 1] - ks[i] = size - 1)"
    seen = seen.where("size(ks) >= size").select(*DOC, "passage", F.expr(f"array_distinct(flatten(transform({whole}, i -> sequence(diag + ks[i], diag + ks[i] + size - 1))))").alias("hits"))
    out = seen.where("size(hits) > 0").groupBy(*DOC).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.collect_set("passage").alias("passages"))
    out = out.withColumn("near", F.expr("cast(array() as array<bigint>)"))
    if near_share is not None:
        close = _proximity(postings, counts, items, slop, near_share)
        close = close.select(*DOC, F.expr("cast(array() as array<int>)").alias("hits"), F.expr("cast(array() as array<bigint>)").alias("passages"), "near")
        out = out.unionByName(close).groupBy(*DOC).agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "passages", "near")))
    out = materialize(out, "matches")
    out._members = items.members
    release(postings, counts, probes, starts, wanted, items.passages)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_items: int = 2, near_share: float | None = 0.8) -> DataFrame:
    """A row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, items``.

    See :func:`find_matches` for the handling of nulls, ties and repeated rows. An empty
    test set gives zero counts; an empty ``docs`` gives no rows. ``n_near`` counts items with a proximity match.
    """
    docs = docs.select("doc_id", "text")
    found = find_matches(docs, benchmark, window, near_share=near_share)
    members = found._members

    def named(column: str, name: str) -> DataFrame:
        ids = found.select(*DOC, F.explode(column).alias("passage")).join(small(members), "passage")
        return ids.groupBy(*DOC).agg(F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("null")))).alias(name))

    hits = found.select(*DOC, F.size("hits").cast("long").alias("n_hit"))
    for column, name in (("passages", "items"), ("near", "near_items")) if near_share is not None else (("passages", "items"),):
        ids = named(column, name)
        hits = hits.join(ids, _same(hits, ids), "left").select(*(hits[c] for c in hits.columns), name)
    none = F.array().cast("array<string>")
    if near_share is None:
        hits = hits.withColumn("near_items", none)
    hits = materialize(hits, "hits")
    release(found, members)
    sized = docs.select("doc_id", _version(F.col("text")).alias("version"), word_count(F.col("text")).alias("n_words"))
    items = F.coalesce("items", none)
    there = small(hits)
    return sized.join(there, _same(sized, hits), "left").select(
        sized["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size(items) >= min_items).alias("contaminated"), F.coalesce(F.size("near_items"), F.lit(0)).cast("long").alias("n_near"), items.alias("items"),
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that the SQL has; :func:`op1_proximity` has the proximity matches besides."""
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), near_share=None).drop("items", "n_near")


def op1_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, len, array_to_string(list_slice(w, i, i + len - 1), ' ') AS g
  FROM (SELECT item_id, w, least(8, len(w)) AS len, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT len FROM bw), grams AS (SELECT DISTINCT len, g FROM bw),
dp AS (
  SELECT doc_id, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM d, lens WHERE len(w) >= len
), m AS (
  SELECT doc_id, i, dg.len, dg.g FROM (SELECT doc_id, i, len, array_to_string(list_slice(w, i, i + len - 1), ' ') AS g FROM dp) dg JOIN grams ON dg.len = grams.len AND dg.g = grams.g
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + len)) AS p FROM m) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT m.doc_id, CAST(bw.item_id AS VARCHAR) AS item FROM m JOIN bw ON m.len = bw.len AND m.g = bw.g) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.items, '')) AS items_sha256,
       coalesce(it.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
