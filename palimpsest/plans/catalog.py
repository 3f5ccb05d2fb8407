"""The queries this engine registers, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lists, urls
from ..functions import text as T
from ..operators import align, authorship, checks, cohorts, overlap, report, search, store
from ..shared import materialize
from ..sources import connectors
from ..sources import html as pages_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---- inputs ----


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with references, citations, quotations and replaced characters put in by plain rules."""
    d = documents(spark, sf).select("doc_id", "text", "source")
    t = F.when(F.col("doc_id") % 7 == 0, F.translate("text", "o", "о")).otherwise(F.col("text"))
    d = d.withColumn("text", t)
    zero = F.concat(F.expr("left(text, 3)"), F.lit("​"), F.expr("substring(text, 4)"))
    d = d.withColumn("text", F.when(F.col("doc_id") % 11 == 0, zero).otherwise(F.col("text")))
    d = d.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" (Doe, 2019)."))).otherwise(F.col("text")))
    d = d.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('"'), F.substring_index("text", "\n", 1), F.lit('"\n'), "text")).otherwise(F.col("text")))
    return d.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nReferences\nDoe, J. (2019). Title."))).otherwise(F.col("text")))


_ENRICHED = """e1 AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN translate(text, 'o', 'о') ELSE text END AS text FROM documents),
e2 AS (SELECT doc_id, source, CASE WHEN doc_id % 11 = 0 THEN left(text, 3) || chr(8203) || substring(text, 4) ELSE text END AS text FROM e1),
e3 AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN text || ' (Doe, 2019).' ELSE text END AS text FROM e2),
e4 AS (SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN '"' || split_part(text, chr(10), 1) || '"' || chr(10) || text ELSE text END AS text FROM e3),
e AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || 'References' || chr(10) || 'Doe, J. (2019). Title.' ELSE text END AS text FROM e4)"""

_CLEAN = f"lower(translate(regexp_replace({{0}}, '[{lists.INVISIBLE}]', '', 'g'), '{T.FROM}', '{T.TO.replace(chr(39), chr(39) * 2)}'))"


def _norms(column: str) -> str:
    return f"list_transform(regexp_extract_all({_CLEAN.format(column)}, '[\\p{{L}}\\p{{Nd}}][\\p{{L}}\\p{{Nd}}'']*'), lambda w: rtrim(w, ''''))"


_TOK = f"tok AS (SELECT doc_id, source, {_norms('text')} AS w FROM documents)"
_BTOK = f"btok AS (SELECT item_id AS src_id, {_norms('text')} AS w FROM benchmark)"
_POS = "SELECT {0}, unnest(range(0, len(w) - 4)) AS pos, w FROM {1} WHERE len(w) >= 5"
_G = "w[pos + 1] || ' ' || w[pos + 2] || ' ' || w[pos + 3] || ' ' || w[pos + 4] || ' ' || w[pos + 5]"
_PCT = "CAST(CASE WHEN {1} > 0 THEN floor(100.0 * {0} / {1} + 0.5) ELSE 0 END AS BIGINT)"


def _list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# ---- text ----


@query(f"WITH {_TOK} SELECT doc_id, CAST(len(w) AS BIGINT) AS tokens FROM tok")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.token_counts(documents(spark, sf))


@query(f"WITH {_TOK} SELECT d.doc_id, CAST(len(w) AS BIGINT) AS words, CAST(length(d.text) AS BIGINT) AS chars, CAST(strlen(d.text) AS BIGINT) AS bytes FROM tok JOIN documents d USING (doc_id)")
def doc_words_chars(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    return d.select("doc_id", F.size(T.norms(F.col("text"))).cast("long").alias("words"), F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"))


@query("""SELECT doc_id, CAST(count(*) AS BIGINT) AS paragraphs, CAST(sum(length(p)) AS BIGINT) AS chars, CAST(max(length(p)) AS BIGINT) AS longest
FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), chr(32) || chr(9) || chr(13) || chr(12) || chr(11)) AS p FROM documents) WHERE p <> '' GROUP BY doc_id""")
def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    p = documents(spark, sf).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("p"))
    p = p.select("doc_id", F.trim("p", F.lit(" \t\r\f\v")).alias("p")).where("p <> ''")
    return p.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("p")).alias("chars"), F.max(F.length("p")).cast("long").alias("longest"))


def _sentence_table(docs: DataFrame) -> DataFrame:
    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                text = text or ""
                at, spans = T.Bytes(text), T.sentence_spans(text)
                out += [(doc, k, at(s), at(e), text[s:e], c) for k, ((s, e), c) in enumerate(zip(spans, T.cited_flags(text, spans), strict=True))]
            yield pd.DataFrame(out, columns=["doc_id", "n", "start", "end", "sentence", "cited"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n int, start int, end int, sentence string, cited boolean")


_SPACE = "chr(32) || chr(9) || chr(13) || chr(12) || chr(11)"
_BLANK = "[ \\t\\r\\f\\v]"


def _sentence_sql(docs: str) -> str:
    """Tables ``ln`` (lines: ``doc_id, i, line, spot``) and ``snt`` (``doc_id, i, n, start, end, sentence``) of a table of texts; offsets in bytes."""
    return f"""ln AS (SELECT doc_id, i, line, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot
  FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS line FROM {docs})),
ps AS (SELECT doc_id, i, spot, ps, unnest(range(1, len(ps) + 1)) AS k FROM (SELECT *, regexp_extract_all(line, '[^.!?]+|[.!?][.!?"'')\\]]*[”’]*') AS ps FROM ln)),
pc AS (SELECT doc_id, i, spot, k, ps[k] AS part, contains('.!?', left(ps[k], 1)) AND (k = len(ps) OR regexp_matches(ps[k + 1], '^{_BLANK}')) AND (left(ps[k], 1) <> '.' OR NOT (
    lower(regexp_extract(right(array_to_string(list_slice(ps, greatest(1, k - 40), k - 1), ''), 40), '[A-Za-z0-9.]*$')) IN ({_list(lists.ABBREVIATIONS)})
    OR regexp_matches(lower(regexp_extract(right(array_to_string(list_slice(ps, greatest(1, k - 40), k - 1), ''), 40), '[A-Za-z0-9.]*$')), '^[a-z]$')
    OR regexp_matches(coalesce(ps[k + 1], ''), '^{_BLANK}*[a-z]'))) AS ends FROM ps),
gr AS (SELECT *, coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY doc_id, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g,
  coalesce(sum(strlen(part)) OVER (PARTITION BY doc_id, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM pc),
jn AS (SELECT doc_id, i, g, any_value(spot) + min(ahead) AS spot, string_agg(part, '' ORDER BY k) AS raw FROM gr GROUP BY doc_id, i, g),
snt AS (SELECT doc_id, i, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, g) - 1 AS INTEGER) AS n, CAST(spot + strlen(raw) - strlen(ltrim(raw, {_SPACE})) AS INTEGER) AS "start",
  CAST(spot + strlen(raw) - strlen(ltrim(raw, {_SPACE})) + strlen(trim(raw, {_SPACE})) AS INTEGER) AS "end", trim(raw, {_SPACE}) AS sentence FROM jn WHERE trim(raw, {_SPACE}) <> '')"""


_CITED = lists.CITATION.replace("'", "''")
_IS_CITED = f"(regexp_matches(lower(sentence), '{_CITED}') OR regexp_matches(sentence, '{_CITED}') OR coalesce(strlen(nxt) < 40 AND regexp_matches(nxt, '{_CITED}'), false))"


@query(f'WITH {_sentence_sql("documents")} SELECT doc_id, n, "start", "end", sentence FROM snt')
def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _sentence_table(documents(spark, sf)).drop("cited")


@query(f"""WITH {_ENRICHED}, {_sentence_sql("e")}, nx AS (SELECT *, lead(sentence) OVER (PARTITION BY doc_id ORDER BY n) AS nxt FROM snt)
SELECT doc_id, n, "start", "end" FROM nx WHERE {_IS_CITED}""")
def cited_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _sentence_table(enriched(spark, sf)).where("cited").select("doc_id", "n", "start", "end")


@query(f"""WITH {_ENRICHED}, l AS (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, string_split(text, chr(10)) AS ls FROM e),
h AS (SELECT doc_id, text, i, strlen(array_to_string(list_slice(ls, 1, i - 1), chr(10))) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS start FROM l
  WHERE regexp_matches(ls[i], '(?i)^[ \\t]*({lists.HEADINGS})[ \\t]*:?[ \\t]*$')),
b AS (SELECT doc_id, arg_max(start, i) AS start, any_value(strlen(text)) AS n FROM h GROUP BY doc_id)
SELECT e.doc_id, CAST(CASE WHEN b.start >= b.n * 2 // 5 THEN b.start ELSE -1 END AS BIGINT) AS bib_start FROM e LEFT JOIN b ON e.doc_id = b.doc_id""")
def bibliography_start(spark: SparkSession, sf: str) -> DataFrame:
    lines = enriched(spark, sf).select("doc_id", "text", F.posexplode_outer(F.split("text", "\n", -1)).alias("i", "line"))
    ahead = F.coalesce(F.sum(F.octet_length("line") + 1).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.select("doc_id", "i", ahead.alias("start"), F.octet_length("text").alias("n"), F.col("line").rlike(rf"(?i)^[ \t]*({lists.HEADINGS})[ \t]*:?[ \t]*$").alias("head"))
    last = lines.groupBy("doc_id").agg(F.max_by("start", F.when(F.col("head"), F.col("i"))).alias("start"), F.first("n").alias("n"))
    return last.select("doc_id", F.when(F.col("start") >= F.floor(F.col("n") * 2 / 5), F.col("start")).otherwise(-1).cast("long").alias("bib_start"))


_BIB = f"""h0 AS (SELECT doc_id, arg_max(spot, i) AS start FROM ln WHERE regexp_matches(line, '(?i)^[ \\t]*({lists.HEADINGS})[ \\t]*:?[ \\t]*$') GROUP BY doc_id),
bs AS (SELECT doc_id, h0.start AS bib FROM h0 JOIN (SELECT doc_id, max(spot + strlen(line)) AS size FROM ln GROUP BY doc_id) USING (doc_id) WHERE h0.start >= size * 2 // 5)"""


@query(f"""WITH RECURSIVE {_ENRICHED}, {_sentence_sql("e")},
qp AS (SELECT doc_id, i, spot, ps, unnest(range(1, len(ps) + 1)) AS k FROM (SELECT *, regexp_extract_all(line, '[“«”»"]|[^“«”»"]+') AS ps FROM ln WHERE regexp_matches(line, '[“«”»"]'))),
qo AS (SELECT doc_id, i, spot + coalesce(sum(strlen(ps[k])) OVER (PARTITION BY doc_id, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, ps[k] AS ch FROM qp),
qm AS (SELECT doc_id, i, s, ch, row_number() OVER (PARTITION BY doc_id, i ORDER BY s) AS k FROM qo WHERE contains('“«”»"', ch)),
st AS (SELECT doc_id, i, 0::BIGINT AS k, NULL::BIGINT AS opened, NULL::BIGINT AS f, NULL::BIGINT AS t FROM (SELECT DISTINCT doc_id, i FROM qm)
  UNION ALL SELECT qm.doc_id, qm.i, qm.k, CASE WHEN ch IN ('“', '«') OR ch = '"' AND opened IS NULL THEN s END,
    CASE WHEN NOT (ch IN ('“', '«') OR ch = '"' AND opened IS NULL) THEN opened END, CASE WHEN NOT (ch IN ('“', '«') OR ch = '"' AND opened IS NULL) AND opened IS NOT NULL THEN s + strlen(ch) END
  FROM st JOIN qm ON qm.doc_id = st.doc_id AND qm.i = st.i AND qm.k = st.k + 1)
SELECT doc_id, CAST(f AS INTEGER) AS "start", CAST(t AS INTEGER) AS "end" FROM st WHERE t IS NOT NULL""")
def quote_spans(spark: SparkSession, sf: str) -> DataFrame:
    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                at = T.Bytes(text or "")
                out += [(doc, at(s), at(e)) for s, e in T.quote_spans(text or "")]
            yield pd.DataFrame(out, columns=["doc_id", "start", "end"])

    return enriched(spark, sf).select("doc_id", "text").mapInPandas(run, "doc_id long, start int, end int")


_REPLACED = f"""{_ENRICHED}, c AS (SELECT doc_id, unnest(range(1, length(text) + 1)) AS i, text FROM e WHERE regexp_matches(text, '[{"".join(lists.LOOKALIKES) + lists.SUSPICIOUS}]')),
m AS (SELECT doc_id, i, substring(text, i, 1) AS ch FROM c), n AS (
SELECT doc_id, ch, lag(ch) OVER (PARTITION BY doc_id ORDER BY i) AS p, lead(ch) OVER (PARTITION BY doc_id ORDER BY i) AS q FROM m),
r AS (SELECT doc_id, count(*) AS replaced FROM n WHERE contains('{"".join(lists.LOOKALIKES) + lists.SUSPICIOUS}', ch)
  AND ((regexp_matches(p, '\\p{{L}}') AND unicode(p) < 592) OR (regexp_matches(q, '\\p{{L}}') AND unicode(q) < 592)) GROUP BY doc_id)"""


@query(f"WITH {_REPLACED} SELECT e.doc_id, CAST(coalesce(r.replaced, 0) AS BIGINT) AS replaced FROM e LEFT JOIN r ON e.doc_id = r.doc_id")
def replaced_chars(spark: SparkSession, sf: str) -> DataFrame:
    return store.replaced_chars(enriched(spark, sf))


@query(f"""WITH {_REPLACED} SELECT e.doc_id, 'replaced' AS kind, 'Replaced characters' AS title, CAST(r.replaced AS BIGINT) AS count FROM e JOIN r ON e.doc_id = r.doc_id
UNION ALL SELECT doc_id, 'hidden', 'Hidden text', CAST(doc_id % 4 AS BIGINT) FROM e WHERE doc_id % 4 > 0""")
def integrity_flags(spark: SparkSession, sf: str) -> DataFrame:
    return store.integrity_flags(enriched(spark, sf).withColumn("hidden_words", F.col("doc_id") % 4))


@query(f"""WITH {_TOK}, t AS (SELECT unnest(w) AS word FROM tok)
SELECT word, CAST(count(*) AS BIGINT) AS n FROM t WHERE word NOT IN ({_list(lists.STOPWORDS)}) GROUP BY word ORDER BY n DESC, word LIMIT 50""")
def top_terms(spark: SparkSession, sf: str) -> DataFrame:
    w = documents(spark, sf).select(F.explode(T.norms(F.col("text"))).alias("word")).where(~F.col("word").isin(lists.STOPWORDS))
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)


@query(f"""WITH {_TOK} SELECT doc_id, CAST(len(list_filter(w, lambda x: strlen(x) > 2 AND x NOT IN ({_list(lists.STOPWORDS)}))) AS BIGINT) AS content_words FROM tok""")
def content_words(spark: SparkSession, sf: str) -> DataFrame:
    stop = F.array(*map(F.lit, lists.STOPWORDS))
    kept = F.filter(T.norms(F.col("text")), lambda w: (F.octet_length(w) > 2) & ~F.array_contains(stop, w))
    return documents(spark, sf).select("doc_id", F.size(kept).cast("long").alias("content_words"))


@query(f"""WITH {_TOK} SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 40 THEN len(list_distinct(w)) / len(w)
ELSE list_avg(list_transform(range(1, len(w) - 38, 5), lambda i: len(list_distinct(list_slice(w, i, i + 39))) / 40.0)) END, 9) AS mattr FROM tok""")
def mattr(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.round(T.mattr(T.norms(F.col("text"))), 9).alias("mattr"))


# ---- overlap ----

_SH = f"{_TOK}, sh AS (SELECT DISTINCT doc_id, source, g FROM (SELECT doc_id, source, {_G} AS g FROM ({_POS.format('doc_id, source', 'tok')})))"


@query(f"WITH {_SH}, f AS (SELECT g, count(*) AS df FROM sh GROUP BY g) SELECT CAST(df AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS shingles FROM f GROUP BY df")
def shingle_df(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.shingle_frequency(documents(spark, sf))


@query(f"""WITH {_SH}, f AS (SELECT g FROM sh GROUP BY g HAVING count(*) <= 200)
SELECT a.doc_id AS sub_id, b.doc_id AS src_id, CAST(count(*) AS BIGINT) AS shared FROM sh a JOIN sh b ON a.g = b.g JOIN f ON f.g = a.g
WHERE a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING count(*) >= 2""")
def repo_candidates(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    return overlap.candidates(d.withColumnRenamed("doc_id", "sub_id"), d.withColumnRenamed("doc_id", "src_id"))


_RUNS = f"""{_TOK}, {_BTOK}, a AS (SELECT doc_id, pos, {_G} AS g FROM ({_POS.format('doc_id', 'tok')})), b AS (SELECT src_id, pos AS q, {_G} AS g FROM ({_POS.format('src_id', 'btok')})),
h AS (SELECT doc_id, src_id, pos, pos - q AS diag FROM a JOIN b USING (g)),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, src_id, diag ORDER BY pos) AS island FROM h),
runs AS (SELECT doc_id, src_id, diag, min(pos) AS f, max(pos) + 5 AS t FROM i GROUP BY doc_id, src_id, diag, island HAVING max(pos) + 5 - min(pos) >= 7)"""


def _bench(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("src_id"), "text")


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, lists.SOURCE_TYPES)), (F.col("src_id") % 3).cast("int"))
    place = F.concat(F.lit("https://example.org/"), F.col("src_id").cast("string"))
    return _bench(spark, sf).select("src_id", "text", place.alias("url"), F.concat(F.lit("Item "), F.col("src_id").cast("string")).alias("title"), kind.alias("type"))


@query(f"WITH {_RUNS} SELECT doc_id AS sub_id, src_id, CAST(f AS BIGINT) AS sub_from, CAST(t AS BIGINT) AS sub_to, CAST(f - diag AS BIGINT) AS src_from, CAST(t - f AS BIGINT) AS words FROM runs")
def exact_passages(spark: SparkSession, sf: str) -> DataFrame:
    out = overlap.exact_passages(documents(spark, sf).withColumnRenamed("doc_id", "sub_id"), _bench(spark, sf))
    return out.select("sub_id", "src_id", *(F.col(c).cast("long").alias(c) for c in ("sub_from", "sub_to", "src_from", "words")))


@query(f"""WITH {_RUNS}, c AS (SELECT doc_id, count(DISTINCT p) AS m FROM (SELECT doc_id, unnest(range(f, t)) AS p FROM runs) GROUP BY doc_id)
SELECT tok.doc_id, CAST(len(w) AS BIGINT) AS total_words, CAST(coalesce(m, 0) AS BIGINT) AS matched_words, {_PCT.format('coalesce(m, 0)', 'len(w)')} AS index_percent,
round(100.0 * coalesce(m, 0) / greatest(len(w), 1), 6) AS index_exact FROM tok LEFT JOIN c ON tok.doc_id = c.doc_id""")
def similarity_index(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.similarity_index(documents(spark, sf), _bench(spark, sf))


@query(f"""WITH {_RUNS}, c AS (SELECT doc_id, src_id % 3 AS k, count(DISTINCT p) AS m FROM (SELECT doc_id, src_id, unnest(range(f, t)) AS p FROM runs) GROUP BY 1, 2)
SELECT c.doc_id, ['Internet', 'Publication', 'Student Paper'][k + 1] AS type, {_PCT.format('m', 'len(w)')} AS percent FROM c JOIN tok ON tok.doc_id = c.doc_id""")
def coverage_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.coverage_by_type(documents(spark, sf), _typed(spark, sf))


@query(f"""WITH {_TOK}, a AS (SELECT doc_id, source, pos, {_G} AS g FROM ({_POS.format('doc_id, source', 'tok')})),
h AS (SELECT a.source, a.doc_id AS a, b.doc_id AS b, a.pos, a.pos - b.pos AS diag FROM a JOIN a b ON a.g = b.g AND a.source = b.source AND a.doc_id > b.doc_id),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY a, b, diag ORDER BY pos) AS island FROM h),
r AS (SELECT source, a, b, min(pos) AS f, max(pos) + 5 AS t FROM i GROUP BY source, a, b, diag, island HAVING max(pos) + 5 - min(pos) >= 7),
c AS (SELECT source, a, b, count(DISTINCT p) AS m FROM (SELECT source, a, b, unnest(range(f, t)) AS p FROM r) GROUP BY 1, 2, 3)
SELECT c.source AS cohort, a, b, CAST(m AS BIGINT) AS words, {_PCT.format('m', 'len(x.w)')} AS percent_a, {_PCT.format('m', 'len(y.w)')} AS percent_b
FROM c JOIN tok x ON x.doc_id = a JOIN tok y ON y.doc_id = b""")
def cohort_overlap_exact(spark: SparkSession, sf: str) -> DataFrame:
    return cohorts.cohort_overlap(documents(spark, sf), "source")


def _blocks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, sources = enriched(spark, sf), _typed(spark, sf)
    subs = docs.select(F.col("doc_id").alias("sub_id"), "text")
    return docs, sources, align.match_passages(align.seeded_pairs(subs, sources), subs, sources)


@query()
def match_passages(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf)[2]


def _reports(spark: SparkSession, sf: str, filters: report.Filters = report.Filters()) -> DataFrame:  # noqa: B008
    docs, sources, blocks = _blocks(spark, sf)
    return report.similarity_reports(docs, blocks, sources, filters)


@query()
def similarity_report(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf).select("doc_id", "total_words", "matched_words", "index_percent", "index_exact", F.to_json("by_type").alias("by_type"), "bib_start", F.size("excluded").alias("excluded"))


@query()
def ranked_sources(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf).select("doc_id", F.explode("sources").alias("s")).select("doc_id", "s.*")


@query()
def source_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _reports(spark, sf, report.Filters(excluded_sources=(0,))).select("doc_id", F.explode("sources").alias("s")).select("doc_id", "s.*")
    return rows.select("doc_id", "id", report.source_state().alias("state"), "words", "total")


@query()
def highlights(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf).select("doc_id", F.explode("highlights").alias("h")).select("doc_id", "h.*")


@query()
def match_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf).select("doc_id", F.explode("groups").alias("g")).select("doc_id", "g.*")


@query()
def report_filtered(spark: SparkSession, sf: str) -> DataFrame:
    f = report.Filters(exclude_quotes=True, exclude_bib=True, exclude_cited=True, exclude_small=10)
    return _reports(spark, sf, f).select("doc_id", "total_words", "matched_words", "index_percent", "index_exact")


@query()
def cohort_compare(spark: SparkSession, sf: str) -> DataFrame:
    return align.compare_cohort(documents(spark, sf), "source")


# ---- pages and search ----


@query()
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return pages_of.text_of_pages(table(spark, sf, "pages"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages""")
def html_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", pages_of.raw_title(F.col("html")).alias("title"))


_AUTH = r"regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', ''), '^m\.', '')"
_HOST = r"regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', '')"
_NORMAL = rf"""CASE WHEN {_AUTH} = '' THEN url ELSE regexp_replace('https://' || {_AUTH} || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) ||
 CASE WHEN len(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), '^(utm_.*|fbclid|gclid)$'))) > 0
 THEN '?' || array_to_string(list_transform(list_sort(list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
   lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), '^(utm_.*|fbclid|gclid)$')), lambda p: {{'k': split_part(p, '=', 1), 'v': regexp_extract(p, '=(.*)$', 1)}})),
   lambda s: replace(url_encode(replace(url_decode(replace(s.k, '+', ' ')), '%20', '+')), '%20', '+') || '=' || replace(url_encode(url_decode(replace(s.v, '+', ' '))), '%20', '+')), '&') ELSE '' END, '/$', '') END"""


@query(f"SELECT page_id, {_NORMAL} AS page FROM pages")
def normalize_url(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.normalize(F.col("url")).alias("page"))


_PUBLICATION = " OR ".join(f"contains(url, '{h}')" for h in lists.PUBLICATION_HOSTS)


@query(f"SELECT page_id, {_HOST} AS host, CASE WHEN {_PUBLICATION} OR ({_HOST} LIKE '%.edu' AND lower(url) LIKE '%.pdf') THEN 'Publication' ELSE 'Internet' END AS type FROM pages")
def classify_source(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.classify(F.col("url")).alias("type"))


def _search_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as answers of searches: page p is hit by queries p % 40 and p % 7, at place p % 10."""
    p = table(spark, sf, "pages")
    q = F.explode(F.array(F.col("page_id") % 40, 100 + F.col("page_id") % 7)).alias("query_id")
    return p.select(q, (F.col("page_id") % 10).alias("pos"), "url", F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("title"), F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("snippet"))


_SKIP = " OR ".join(f"contains({_HOST}, '{h}')" for h in lists.SKIPPED_HOSTS)
_PAGES = f"""WITH q AS (SELECT page_id, url, page_id % 10 AS pos, unnest([page_id % 40, 100 + page_id % 7]) AS query_id FROM pages),
h AS (SELECT query_id, pos, page_id, {_NORMAL} AS page FROM q WHERE pos < 6 AND NOT ({_SKIP})),
u AS (SELECT page, CAST(count(*) AS BIGINT) AS hits, arg_min('t' || page_id, query_id * 100 + pos) AS title,
  array_to_string(list('s' || page_id ORDER BY query_id, pos, 's' || page_id), '|') AS snippets FROM h GROUP BY page)"""


@query(f"{_PAGES} SELECT page, hits, snippets FROM u")
def url_hits(spark: SparkSession, sf: str) -> DataFrame:
    return search.url_hits(_search_hits(spark, sf)).select("page", "hits", F.array_join("snippets", "|").alias("snippets"))


@query(f"{_PAGES} SELECT page, hits FROM u ORDER BY hits DESC, page LIMIT 40")
def top_pages(spark: SparkSession, sf: str) -> DataFrame:
    return search.top_pages(search.url_hits(_search_hits(spark, sf))).select("page", "hits")


@query(f"""WITH s AS (SELECT page_id AS id, {_NORMAL} AS key, page_id % 13 AS n_blocks FROM pages),
r AS (SELECT *, min(id) OVER (PARTITION BY key) AS first_id, row_number() OVER (PARTITION BY key ORDER BY n_blocks DESC, id) AS k FROM s)
SELECT CAST(first_id AS BIGINT) AS id, CAST(n_blocks AS BIGINT) AS n_blocks FROM r WHERE k = 1""")
def dedupe_sources(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("").alias("ref"), "url", (F.col("page_id") % 13).alias("n_blocks"))
    return search.dedupe_sources(s).select("id", "n_blocks")


@query("""WITH c AS (SELECT page_id, TIMESTAMP '2024-03-01 12:00:00' - to_hours(CAST(page_id * 7 AS INTEGER)) AS fetched, page_id % 3 = 0 AS failed FROM pages)
SELECT page_id FROM c WHERE TIMESTAMP '2024-03-01 12:00:00' - fetched <= CASE WHEN failed THEN INTERVAL 24 HOURS ELSE INTERVAL 720 HOURS END""")
def cache_fresh(spark: SparkSession, sf: str) -> DataFrame:
    now = "2024-03-01 12:00:00"
    fetched = F.to_timestamp(F.lit(now)) - F.make_dt_interval(hours=(F.col("page_id") * 7).cast("int"))
    cache = table(spark, sf, "pages").select("page_id", "url", fetched.alias("fetched"), (F.col("page_id") % 3 == 0).alias("failed"))
    return search.fresh_pages(cache, now).select("page_id")


@query("""WITH r AS (SELECT 'engine' || (page_id % 5) AS engine, page_id % 5 = 0 OR page_id % (2 + page_id % 5) = 0 AS failed FROM pages),
c AS (SELECT engine, count(*) FILTER (failed) AS bad, count(*) AS n FROM r GROUP BY engine)
SELECT engine, CASE WHEN bad = n THEN 'all searches failed' WHEN bad * 3 > n THEN bad || ' of ' || n || ' searches failed' ELSE '' END AS note FROM c""")
def run_notes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id") % 5
    r = table(spark, sf, "pages").select(F.concat(F.lit("engine"), k.cast("string")).alias("engine"), ((k == 0) | (F.col("page_id") % (2 + k) == 0)).alias("failed"))
    return search.run_notes(r)


@query(f"""WITH {_TOK}, p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM tok)
SELECT doc_id, array_to_string(list(w[i] ORDER BY i), ' ') AS abstract FROM p GROUP BY doc_id""")
def abstract_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """Builds the inverted index of each text and the text from it again."""
    w = documents(spark, sf).select("doc_id", F.posexplode(T.norms(F.col("text"))).alias("i", "w"))
    index = w.groupBy("doc_id", "w").agg(F.collect_list("i").alias("at")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("index"))
    return index.select("doc_id", connectors.abstract_text(F.col("index")).alias("abstract"))


@query("""SELECT o_orderkey AS id, CASE WHEN n = 0 AND v = '' AND y <= 0 THEN '' ELSE ' (' || array_to_string(list_filter([CASE WHEN n > 1 THEN 'A' || id || ' et al.' WHEN n = 1 THEN 'A' || id END,
nullif(v, ''), CASE WHEN y > 0 THEN CAST(y AS VARCHAR) END], lambda x: x IS NOT NULL), ', ') || ')' END AS line
FROM (SELECT o_orderkey, o_orderkey AS id, o_orderkey % 3 AS n, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'V' || (o_orderkey % 10) END AS v, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1990 + o_orderkey % 30 END AS y FROM orders)""")
def author_line(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    names = F.transform(F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), (k % 3).cast("int")), lambda _: F.concat(F.lit("A"), k.cast("string")))
    venue = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("V"), (k % 10).cast("string")))
    year = F.when(k % 5 == 0, 0).otherwise(1990 + k % 30)
    return table(spark, sf, "orders").select(k.alias("id"), connectors.author_line(names, venue, year).alias("line"))


_LEX = """lex AS (SELECT word, CASE WHEN zipf = 0 THEN 2 ELSE zipf END AS z FROM (SELECT word, round(log10(n / total * 1e9), 3) AS zipf FROM (
SELECT word, count(*) AS n, sum(count(*)) OVER () AS total FROM (SELECT unnest(w) AS word FROM tok) GROUP BY word)))"""


@query(f"""WITH {_TOK}, {_LEX}, c AS (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(w) AS word FROM tok)
WHERE strlen(word) >= 4 AND NOT regexp_matches(word, '^[0-9]+$') AND word NOT IN ({_list(lists.STOPWORDS)}) GROUP BY 1, 2),
s AS (SELECT doc_id, word, round(c * (7 - z), 6) AS score FROM c JOIN lex USING (word))
SELECT doc_id, CAST(k AS INTEGER) AS rank, word, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word) AS k FROM s) WHERE k <= 8""")
def top_keywords(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    return search.top_keywords(d, authorship.corpus_lexicon(d))


_PHRASES = rf"""{_TOK}, {_sentence_sql("documents")}, {_BIB},
zipf AS (SELECT word, round(log10(n / total * 1e9), 3) AS zipf FROM (SELECT word, count(*) AS n, sum(count(*)) OVER () AS total FROM (SELECT unnest(w) AS word FROM tok) GROUP BY word)),
cd AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS pos, list_slice(raw, (len(raw) - 14) // 2 * CAST(len(raw) > 14 AS INTEGER) + 1, (len(raw) - 14) // 2 * CAST(len(raw) > 14 AS INTEGER) + 14) AS raw
  FROM (SELECT snt.*, regexp_extract_all(sentence, '[\p{{L}}\p{{Nd}}][\p{{L}}\p{{Nd}}''’{lists.INVISIBLE}]*') AS raw FROM snt LEFT JOIN bs ON bs.doc_id = snt.doc_id WHERE bib IS NULL OR bib > "start") WHERE len(raw) >= 8),
cw AS (SELECT doc_id, pos, rtrim({_CLEAN.format('r')}, chr(39)) AS word FROM (SELECT doc_id, pos, unnest(raw) AS r FROM cd)),
sc AS (SELECT doc_id, pos, sum(CASE WHEN word IN ({_list(lists.STOPWORDS)}) THEN 0 ELSE greatest(0, 6 - coalesce(zipf, 0)) END) / count(*) AS score FROM cw LEFT JOIN zipf USING (word) GROUP BY 1, 2),
bk AS (SELECT doc_id, pos, array_to_string(raw, ' ') AS phrase, score, count(*) OVER (PARTITION BY doc_id) AS n FROM cd JOIN sc USING (doc_id, pos)),
bp AS (SELECT *, CAST(CASE WHEN n <= 40 THEN pos ELSE (pos * 40 + 39) // n END AS INTEGER) AS bucket FROM bk),
ph AS (SELECT doc_id, bucket, pos, phrase FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, bucket ORDER BY round(score, 9) DESC, pos) AS k FROM bp) WHERE k = 1)"""


@query(f"WITH {_PHRASES} SELECT doc_id, bucket, pos, phrase FROM ph")
def search_phrases(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    return search.search_phrases(d, authorship.corpus_lexicon(d))


@query(f"""WITH {_PHRASES}, kw AS (SELECT doc_id, array_to_string(list(word ORDER BY rank), ' ') AS query FROM ({SQL["top_keywords"]}) WHERE rank <= 6 GROUP BY doc_id),
qs AS (SELECT doc_id, -1 AS pos, query FROM kw UNION ALL SELECT doc_id, bucket, phrase FROM ph WHERE bucket % 4 = 0)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, query FROM (SELECT doc_id, query, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank FROM qs) WHERE rank <= 6""")
def database_queries(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    lexicon = authorship.corpus_lexicon(d)
    return search.database_queries(search.search_phrases(d, lexicon), search.top_keywords(d, lexicon, 6))


# ---- authorship ----


@query(f"""WITH {_ENRICHED}, {_sentence_sql("e")}, {_BIB},
pg AS (SELECT doc_id, i, spot + strlen(line) - strlen(ltrim(line, {_SPACE})) AS spot, trim(line, {_SPACE}) AS p, len({_norms("line")}) AS n FROM ln WHERE trim(line, {_SPACE}) <> ''),
ok AS (SELECT pg.doc_id, pg.i FROM pg LEFT JOIN bs ON bs.doc_id = pg.doc_id JOIN (SELECT doc_id, i, count(*) AS c FROM snt GROUP BY 1, 2) c ON c.doc_id = pg.doc_id AND c.i = pg.i
  WHERE (bib IS NULL OR bib > spot) AND NOT (n < 40 AND regexp_matches(p, '{lists.BULLET}')) AND length(p) - length(replace(p, chr(9), '')) < 2 AND length(p) - length(replace(p, '|', '')) < 2
  AND NOT (n < 12 AND NOT contains('.!?"' || chr(39), right(p, 1))) AND NOT (c = 1 AND n < 25))
SELECT doc_id, CAST(count(*) AS BIGINT) AS sentences, CAST(sum(w) AS BIGINT) AS words FROM (SELECT snt.doc_id, len({_norms("sentence")}) AS w FROM snt JOIN ok ON ok.doc_id = snt.doc_id AND ok.i = snt.i) WHERE w >= 4 GROUP BY doc_id""")
def qualifying_words(spark: SparkSession, sf: str) -> DataFrame:
    return authorship.sentence_words(enriched(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum("words").alias("words"))


@query()
def dense_features(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    f = authorship.featurize(d, materialize(authorship.corpus_lexicon(d), "lexicon"), terms=False)
    return f.select("doc_id", "win", "words", *(F.round(F.get("dense", F.lit(k)), 9).alias(n) for k, n in enumerate(authorship.DENSE)))


@query()
def ai_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of windows by a model trained on the quality labels of all documents that have one."""
    d = documents(spark, sf).select("doc_id", "text")
    lexicon = materialize(authorship.corpus_lexicon(d), "lexicon")
    common = authorship.shipped(lexicon)
    zipf = materialize(authorship.window_zipf(d, lexicon, common), "zipf")  # for training and for scores
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    model = authorship.train(authorship.labelled(d.join(labels, "doc_id"), common, zipf))
    return authorship.score_texts(d, model, common, zipf).select("doc_id", "win", F.round("p", 6).alias("p"))


_SCORES = "s AS (SELECT doc_id, i - 1 AS sentence, (doc_id * 37 + i * i * 11) % 100 / 100.0 AS score FROM (SELECT doc_id, unnest(range(1, 2 + doc_id % 30)) AS i FROM documents))"


def _given_scores(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).select("doc_id", F.explode(F.expr("sequence(1, int(1 + doc_id % 30))")).alias("i"))
    return d.select("doc_id", (F.col("i") - 1).alias("sentence"), ((F.col("doc_id") * 37 + F.col("i") * F.col("i") * 11) % 100 / 100.0).alias("score"))


_FLAGS = f"""{_SCORES}, h AS (SELECT *, score >= 0.5 AS high FROM s), f AS (SELECT doc_id, sentence, score, high AND (coalesce(lag(high) OVER w, false) OR coalesce(lead(high) OVER w, false)) AS flagged
FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY sentence))"""


@query(f"WITH {_FLAGS} SELECT doc_id, CAST(sentence AS INTEGER) AS sentence, floor(score * 1000 + 0.5) / 1000 AS score, flagged FROM f")
def flag_runs(spark: SparkSession, sf: str) -> DataFrame:
    return authorship.smooth(_given_scores(spark, sf), 0.5)


@query(f"""WITH {_FLAGS}, d AS (SELECT doc_id, count(*) >= 5 AS available, floor(100.0 * count(*) FILTER (flagged) / count(*) + 0.5) AS percent FROM f GROUP BY doc_id),
g AS (SELECT source AS grp, available, CASE WHEN available THEN percent ELSE 0 END AS percent FROM d JOIN documents USING (doc_id))
SELECT grp, CAST(count(*) AS BIGINT) AS docs, CAST(count(*) FILTER (available) AS BIGINT) AS scored,
round(100.0 * count(*) FILTER (available AND percent >= 20) / nullif(count(*) FILTER (available), 0), 1) AS ge20,
round(100.0 * count(*) FILTER (available AND percent > 0) / nullif(count(*) FILTER (available), 0), 1) AS gt0, round(avg(percent) FILTER (available), 1) AS mean FROM g GROUP BY grp""")
def evaluate_groups(spark: SparkSession, sf: str) -> DataFrame:
    flags = authorship.smooth(_given_scores(spark, sf), 0.5)
    docs = flags.groupBy("doc_id").agg((F.count("*") >= 5).alias("available"), T.percent(F.count_if("flagged"), F.count("*")).alias("percent"))
    rows = docs.join(documents(spark, sf).select("doc_id", F.col("source").alias("grp")), "doc_id")
    return authorship.evaluate(rows.select("grp", "available", F.when(F.col("available"), F.col("percent")).otherwise(0).alias("percent")))


@query(f"""WITH {_FLAGS}, d AS (SELECT doc_id, count(*) >= 5 AS available, CAST(floor(100.0 * count(*) FILTER (flagged) / count(*) + 0.5) AS BIGINT) AS p FROM f GROUP BY doc_id)
SELECT doc_id, CASE WHEN NOT available THEN '' WHEN p = 0 THEN '0%' WHEN p < 20 THEN '*%' ELSE p || '%' END AS shown,
CASE WHEN p = 0 THEN 'none' WHEN p < 25 THEN 'low' WHEN p < 50 THEN 'medium' WHEN p < 75 THEN 'high' ELSE 'very high' END AS band FROM d""")
def display_bands(spark: SparkSession, sf: str) -> DataFrame:
    flags = authorship.smooth(_given_scores(spark, sf), 0.5)
    d = flags.groupBy("doc_id").agg((F.count("*") >= 5).alias("available"), T.percent(F.count_if("flagged"), F.count("*")).alias("p"))
    p = F.col("p")
    band = F.when(p == 0, "none").when(p < 25, "low").when(p < 50, "medium").when(p < 75, "high").otherwise("very high")
    return d.select("doc_id", authorship.display(F.col("available"), p).alias("shown"), band.alias("band"))


# ---- store ----


def _assignments(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = documents(spark, sf)
    subs = d.select(F.col("doc_id").alias("id"), F.col("source").alias("assignment"), (F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("uploaded"))
    return d.select(F.col("source").alias("id")).distinct().select("id", F.concat(F.lit("Essay "), "id").alias("name"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("created")), subs


@query("SELECT source AS id, 'Essay ' || source AS name, CAST(count(*) AS BIGINT) AS papers FROM documents GROUP BY source")
def assignment_counts(spark: SparkSession, sf: str) -> DataFrame:
    return store.assignment_counts(*_assignments(spark, sf)).select("id", "name", "papers")


@query(f"WITH {_SH} SELECT doc_id, CAST(count(*) AS BIGINT) AS shingles FROM sh WHERE source NOT IN ('src1', 'src2') GROUP BY doc_id")
def delete_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of the shingle table when two assignments are deleted."""
    a, s = _assignments(spark, sf)
    gone = a.where(F.col("id").isin("src1", "src2")).select("id")
    left = store.delete_assignments(a, s, overlap.shingle_table(documents(spark, sf)), gone)[2]
    return left.groupBy("doc_id").agg(F.count("*").alias("shingles"))


@query("""SELECT doc_id AS id, 'Paper submitted to ' || CASE WHEN source = 'src3' THEN 'another assignment' ELSE 'Essay ' || source END || ' on ' ||
strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)), '%Y-%m-%d') AS title FROM documents""")
def repository_titles(spark: SparkSession, sf: str) -> DataFrame:
    a, s = _assignments(spark, sf)
    return store.repository_titles(s.select(F.col("id").alias("src_id")), s, a.where("id <> 'src3'")).select(F.col("src_id").alias("id"), "title")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'error' ELSE 'done' END AS status FROM documents WHERE doc_id % 17 <> 0""")
def update_status(spark: SparkSession, sf: str) -> DataFrame:
    """Rows updated in place and rows deleted."""
    rows = documents(spark, sf).select(F.col("doc_id").alias("id"), F.lit("done").alias("status"))
    changed = rows.where("id % 10 = 0").select("id", F.lit("error").alias("status"))
    return store.delete_rows(store.update_rows(rows, changed, ["status"]), rows.where("id % 17 = 0").select("id"))


# ---- papers: submission, check, lists ----

_NOW = "2024-03-01 12:00:00"


def _papers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as handed in: file names made of a text's first characters, every fourth pasted, every fifth with an author, every third with a title."""
    d, k = documents(spark, sf), F.col("doc_id")
    name = F.when(k % 4 == 0, "").otherwise(F.concat(F.expr("left(text, 25)"), F.lit("_"), F.col("lang"), F.lit(".txt")))
    files = d.select(k.alias("id"), F.col("source").alias("assignment"), name.alias("name"), "text", F.when(k % 5 == 0, " Doe, J. ").alias("author"), F.when(k % 3 == 0, F.col("lang")).alias("title"))
    return checks.submissions(files, _NOW)


_PAPERS = f"""{_TOK}, nm AS (SELECT doc_id AS id, source AS assignment, CASE WHEN doc_id % 4 = 0 THEN '' ELSE coalesce(left(text, 25) || '_' || lang || '.txt', '') END AS name, coalesce(text, '') AS text, lang FROM documents),
bn AS (SELECT *, regexp_replace(name, '\\.[^.]*$', '') AS base FROM nm),
gs AS (SELECT *, regexp_extract_all(translate(base, '_-.', '   '), '[^\\s]+') AS f FROM bn),
papers AS (SELECT id, assignment, name, CASE WHEN id % 3 = 0 AND regexp_matches(lang, '[^\\s]') THEN lang WHEN regexp_matches(base, '[^\\s]') THEN base ELSE '' END AS title,
  CASE WHEN id % 5 = 0 THEN 'Doe, J.' WHEN len(f) >= 2 THEN f[1] || ' ' || f[2] ELSE '' END AS author, CAST(len(w) AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS chars,
  CASE WHEN name = '' AND len(w) < 20 THEN 'error' ELSE 'queued' END AS status FROM gs JOIN tok ON tok.doc_id = id)"""


@query(f"WITH {_PAPERS} SELECT id, assignment, name, title, author, words, chars, status FROM papers")
def submissions(spark: SparkSession, sf: str) -> DataFrame:
    return _papers(spark, sf).drop("text", "uploaded")


@query("SELECT count(DISTINCT doc_id) AS papers FROM documents")
def repository_size(spark: SparkSession, sf: str) -> DataFrame:
    return checks.repository_size(documents(spark, sf))


@query("""SELECT doc_id AS id, lag(doc_id) OVER w AS previous, lead(doc_id) OVER w AS next FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id DESC)""")
def paper_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return checks.neighbours(_assignments(spark, sf)[1]).select("id", "previous", "next")


@query(f"SELECT cohort, a, b, words, CAST(row_number() OVER (PARTITION BY cohort ORDER BY words DESC, a, b) AS INTEGER) AS rank FROM ({SQL['cohort_overlap_exact']})")
def ranked_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return cohorts.ranked_pairs(documents(spark, sf), "source")


@query(f"""SELECT doc_id, CASE WHEN index_exact > 0 AND index_exact < 1 THEN '<1%' ELSE CAST(floor(index_exact + 0.5) AS BIGINT) || '%' END AS shown,
CASE WHEN index_percent = 0 THEN 'none' WHEN index_percent < 25 THEN 'low' WHEN index_percent < 50 THEN 'medium' WHEN index_percent < 75 THEN 'high' ELSE 'very high' END AS band
FROM ({SQL["similarity_index"]})""")
def index_display(spark: SparkSession, sf: str) -> DataFrame:
    return similarity_index(spark, sf).select("doc_id", checks.shown_percent(F.col("index_exact")).alias("shown"), checks.band(F.col("index_percent")).alias("band"))


def _online(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages and read pages as sources found online."""
    p, u = table(spark, sf, "pages"), F.col("url")
    pages = p.select((1_000_000_000 + F.col("page_id")).alias("src_id"), "url", pages_of.raw_title(F.col("html")).alias("title"), urls.classify(u).alias("type"), F.col("html").alias("text"))
    return checks.origins(benchmark=_typed(spark, sf), pages=pages)


@query(f"""WITH o AS (SELECT 'benchmark' AS origin, ['Internet', 'Publication', 'Student Paper'][item_id % 3 + 1] AS type, item_id AS src_id FROM benchmark
UNION ALL SELECT 'pages', type, 1000000000 + page_id FROM ({SQL["classify_source"]})) SELECT origin, src_id, type FROM o WHERE type = 'Publication'""")
def publication_sources(spark: SparkSession, sf: str) -> DataFrame:
    return checks.publications_only(_online(spark, sf), web=False).select("origin", "src_id", "type")


@query(f"""SELECT doc_id, 'quoted' AS layer, "start", "end" FROM ({SQL["quote_spans"]}) UNION ALL SELECT doc_id, 'cited', "start", "end" FROM ({SQL["cited_sentences"]})""")
def highlight_layers(spark: SparkSession, sf: str) -> DataFrame:
    return checks.highlight_layers(quoted=quote_spans(spark, sf), cited=cited_sentences(spark, sf))


@query("""SELECT 'db' || (page_id % 5) AS database, 'db' || (page_id % 5) || ' could not be searched' AS note FROM pages GROUP BY 1, 2 HAVING bool_and(page_id % 5 = 3 OR contains(url, 'q'))""")
def database_notes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id") % 5
    return checks.database_notes(table(spark, sf, "pages").select(F.concat(F.lit("db"), k.cast("string")).alias("database"), ((k == 3) | F.col("url").contains("q")).alias("failed")))


@query(f"""WITH {_PAPERS}, ix AS (SELECT doc_id AS id, index_percent FROM ({SQL["similarity_index"]})), fl AS (SELECT doc_id AS id, CAST(count(*) AS BIGINT) AS flags FROM ({SQL["integrity_flags"]}) GROUP BY 1)
SELECT id, assignment, title, author, status, words, index_percent AS percent, CAST(id % 50 AS BIGINT) AS ai, id % 2 = 0 AS ai_available, coalesce(flags, 0) AS flags FROM papers JOIN ix USING (id) LEFT JOIN fl USING (id)""")
def paper_list(spark: SparkSession, sf: str) -> DataFrame:
    """The list of an assignment's papers; scores of machine authorship are given, the rest is computed."""
    ai = documents(spark, sf).select("doc_id", (F.col("doc_id") % 50).alias("percent"), (F.col("doc_id") % 2 == 0).alias("available"))
    return checks.summaries(_papers(spark, sf), similarity_index(spark, sf), ai, integrity_flags(spark, sf))
