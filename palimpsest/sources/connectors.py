"""Search engines and research databases: parsers of saved payloads, as DataFrame functions.

Nothing here goes to a network. Input is a table ``query_id, body`` of answers; output the common records
``url, title, snippet`` (hits) or ``url, title, type, text`` (sources).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_tags(s: Column) -> Column:
    plain = F.regexp_replace(s, "<[^>]*>", "")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(mark))
    return F.trim(plain)


def author_line(names: Column, venue: Column, year: Column) -> Column:
    """First author (et al.), venue and year in parentheses; empty if there is none of them."""
    first = F.when(F.size(names) > 1, F.concat(F.get(names, F.lit(0)), F.lit(" et al."))).when(F.size(names) == 1, F.get(names, F.lit(0)))
    parts = F.filter(F.array(first, F.nullif(venue, F.lit("")), F.when(year > 0, year.cast("string"))), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.concat(F.lit(" ("), F.array_join(parts, ", "), F.lit(")"))).otherwise("")


def abstract_text(index: Column) -> Column:
    """A text from its inverted index, map of word to positions."""
    entries = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(entries), lambda e: e["w"]), " ")


def _hits(answers: DataFrame, schema: str, items: str, url: str, title: str, snippet: str) -> DataFrame:
    parsed = answers.select("query_id", F.from_json("body", schema).alias("j")).select("query_id", F.posexplode(F.col(items)).alias("pos", "i"))
    return parsed.select("query_id", "pos", F.col(url).alias("url"), strip_tags(F.col(title)).alias("title"), strip_tags(F.col(snippet)).alias("snippet"))


def brave(answers: DataFrame) -> DataFrame:
    return _hits(answers, "web struct<results:array<struct<url:string,title:string,description:string>>>", "j.web.results", "i.url", "i.title", "i.description")


def google(answers: DataFrame) -> DataFrame:
    return _hits(answers, "items array<struct<link:string,title:string,snippet:string>>", "j.items", "i.link", "i.title", "i.snippet")


def bing_api(answers: DataFrame) -> DataFrame:
    return _hits(answers, "webPages struct<value:array<struct<url:string,name:string,snippet:string>>>", "j.webPages.value", "i.url", "i.name", "i.snippet")


def ddg_html(answers: DataFrame) -> DataFrame:
    """Result links of the HTML page, redirects unwrapped, advertisements dropped."""
    link = r'(?s)<a[^>]*class="[^"]*result__a[^"]*"[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    note = r'(?s)<a[^>]*class="[^"]*result__snippet[^"]*"[^>]*>(.*?)</a>'
    zipped = F.arrays_zip(
        F.regexp_extract_all("body", F.lit(link), F.lit(1)).alias("u"), F.regexp_extract_all("body", F.lit(link), F.lit(2)).alias("t"), F.regexp_extract_all("body", F.lit(note), F.lit(1)).alias("s")
    )
    rows = answers.select("query_id", F.posexplode(zipped).alias("pos", "i")).select("query_id", "pos", "i.u", "i.t", "i.s")
    target = F.try_url_decode(F.regexp_extract("u", "[?&]uddg=([^&]*)", 1))
    url = F.when(F.col("u").contains("uddg="), target).otherwise(F.col("u"))
    return rows.where(~F.col("u").contains("/y.js?")).select("query_id", "pos", url.alias("url"), strip_tags(F.col("t")).alias("title"), strip_tags(F.col("s")).alias("snippet"))


def bing_html(answers: DataFrame) -> DataFrame:
    """Result items of the HTML page; redirects carry the target in base64 after ``u=a1``."""
    items = answers.select("query_id", F.posexplode(F.regexp_extract_all("body", F.lit(r'(?s)<li class="b_algo"(.*?)</li>'), F.lit(1))).alias("pos", "i"))
    link = F.regexp_extract("i", r'(?s)<h2[^>]*>\s*<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)
    name = F.regexp_extract("i", r'(?s)<h2[^>]*>\s*<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)
    code = F.translate(F.regexp_extract(link, "[?&]u=a1([^&]*)", 1), "-_", "+/")
    padded = F.rpad(code, (F.ceil(F.length(code) / 4) * 4).cast("int"), "=")
    url = F.when(link.contains("u=a1"), F.unbase64(padded).cast("string")).otherwise(link)
    return items.select("query_id", "pos", url.alias("url"), strip_tags(name).alias("title"), strip_tags(F.regexp_extract("i", r"(?s)<p[^>]*>(.*?)</p>", 1)).alias("snippet"))


def first_engine(hits: DataFrame, engines: list[str]) -> DataFrame:
    """Per query the hits of the first engine, by priority, that has any."""
    order = F.array_position(F.array(*map(F.lit, engines)), F.col("engine"))
    best = hits.groupBy("query_id").agg(F.min(order).alias("best"))
    return hits.withColumn("rank", order).join(best, "query_id").where("rank = best and rank > 0").drop("rank", "best")


def _sources(rows: DataFrame, url: Column, title: Column, extra: Column, text: Column, kind: str = "Publication") -> DataFrame:
    full = F.concat(F.coalesce(title, F.lit("")), extra)
    return rows.select("query_id", url.alias("url"), full.alias("title"), F.lit(kind).alias("type"), strip_tags(text).alias("text")).where("coalesce(text, '') <> '' and coalesce(url, '') <> ''")


def _rows(answers: DataFrame, schema: str, items: str) -> DataFrame:
    return answers.select("query_id", F.from_json("body", schema).alias("j")).select("query_id", F.explode(F.col(items)).alias("i"))


def _doi(doi: Column, other: Column) -> Column:
    return F.coalesce(F.when(F.nullif(doi, F.lit("")).isNotNull(), F.concat(F.lit("https://doi.org/"), doi)), other)


def wikipedia(answers: DataFrame) -> DataFrame:
    rows = answers.select("query_id", F.from_json("body", "query struct<pages:map<string,struct<title:string,extract:string,fullurl:string>>>").alias("j"))
    rows = rows.select("query_id", F.explode(F.map_values("j.query.pages")).alias("i"))
    return _sources(rows, F.col("i.fullurl"), F.concat(F.col("i.title"), F.lit(" - Wikipedia")), F.lit(""), F.col("i.extract"), "Internet")


def openalex(answers: DataFrame) -> DataFrame:
    schema = """results array<struct<id:string,doi:string,display_name:string,publication_year:int,abstract_inverted_index:map<string,array<int>>,
        authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<landing_page_url:string,source:struct<display_name:string>>>>"""
    rows = _rows(answers, schema, "j.results").where("i.abstract_inverted_index is not null")
    names = F.transform("i.authorships", lambda a: a["author"]["display_name"])
    line = author_line(names, F.col("i.primary_location.source.display_name"), F.col("i.publication_year"))
    url = F.coalesce(F.nullif("i.doi", F.lit("")), F.nullif("i.primary_location.landing_page_url", F.lit("")), F.col("i.id"))
    return _sources(rows, url, F.col("i.display_name"), line, abstract_text(F.col("i.abstract_inverted_index")))


def semantic_scholar(answers: DataFrame) -> DataFrame:
    rows = _rows(answers, "data array<struct<title:string,abstract:string,url:string,year:int,venue:string,externalIds:map<string,string>,authors:array<struct<name:string>>>>", "j.data")
    line = author_line(F.transform("i.authors", lambda a: a["name"]), F.col("i.venue"), F.col("i.year"))
    return _sources(rows, _doi(F.try_element_at("i.externalIds", F.lit("DOI")), F.col("i.url")), F.col("i.title"), line, F.col("i.abstract"))


def crossref(answers: DataFrame) -> DataFrame:
    schema = """message struct<items:array<struct<DOI:string,URL:string,title:array<string>,abstract:string,`container-title`:array<string>,
        author:array<struct<given:string,family:string>>,issued:struct<`date-parts`:array<array<int>>>>>>"""
    rows = _rows(answers, schema, "j.message.items")
    names = F.transform("i.author", lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"])))
    line = author_line(names, F.get("i.container-title", F.lit(0)), F.get(F.get(F.col("i.issued.date-parts"), F.lit(0)), F.lit(0)))
    return _sources(rows, _doi(F.col("i.DOI"), F.col("i.URL")), F.get("i.title", F.lit(0)), line, F.col("i.abstract"))


def arxiv(answers: DataFrame) -> DataFrame:
    """Atom feed."""
    entries = answers.select("query_id", F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))).alias("e"))
    one = lambda tag: strip_tags(F.regexp_replace(F.regexp_extract("e", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), r"\s+", " "))
    names = F.regexp_extract_all("e", F.lit(r"(?s)<name>(.*?)</name>"), F.lit(1))
    line = author_line(names, F.lit("arXiv"), F.substring(one("published"), 1, 4).try_cast("int"))
    return _sources(entries, one("id"), one("title"), line, one("summary"))


def europe_pmc(answers: DataFrame) -> DataFrame:
    schema = "resultList struct<result:array<struct<id:string,source:string,doi:string,title:string,authorString:string,journalTitle:string,pubYear:string,abstractText:string>>>"
    rows = _rows(answers, schema, "j.resultList.result")
    line = author_line(F.filter(F.split("i.authorString", ", "), lambda a: a != ""), F.col("i.journalTitle"), F.col("i.pubYear").try_cast("int"))
    page = F.concat(F.lit("https://europepmc.org/article/"), F.col("i.source"), F.lit("/"), F.col("i.id"))
    return _sources(rows, _doi(F.col("i.doi"), page), F.col("i.title"), line, F.col("i.abstractText"))


def core(answers: DataFrame) -> DataFrame:
    schema = """results array<struct<id:string,doi:string,title:string,abstract:string,fullText:string,downloadUrl:string,yearPublished:int,publisher:string,authors:array<struct<name:string>>>>"""
    rows = _rows(answers, schema, "j.results")
    line = author_line(F.transform("i.authors", lambda a: a["name"]), F.col("i.publisher"), F.col("i.yearPublished"))
    text = F.coalesce(F.nullif(F.trim("i.fullText"), F.lit("")), F.col("i.abstract"))
    return _sources(rows, _doi(F.col("i.doi"), F.coalesce(F.nullif("i.downloadUrl", F.lit("")), F.concat(F.lit("https://core.ac.uk/works/"), F.col("i.id")))), F.col("i.title"), line, text)


def error_class(message: Column) -> Column:
    """What a failed search tells the user."""
    m = F.lower(message)
    return (
        F.when(m.contains("http 401") | m.contains("http 403"), "key rejected")
        .when(m.contains("http 429"), "rate limited")
        .when(m.contains("timeout") | m.contains("deadline"), "timed out")
        .otherwise("failed")
    )
