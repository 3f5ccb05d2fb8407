import io
import json
import zipfile

from pyspark.sql import functions as F

from palimpsest.functions import urls
from palimpsest.functions.register import register
from palimpsest.operators import search, store
from palimpsest.sources import connectors, extract
from palimpsest.sources.html import html_to_text
from palimpsest.streaming import ingest

LONG = "these twenty words and some more are here so that the file is long enough to be taken as a paper now"


def docx(body):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://x"><w:body>{body}</w:body></w:document>')
    return raw.getvalue()


def test_docx_with_hidden_runs():
    body = f'<w:p><w:r><w:t>{LONG}</w:t></w:r><w:r><w:rPr><w:vanish/></w:rPr><w:t>secret é</w:t></w:r><w:r><w:rPr><w:vanish w:val="0"/></w:rPr><w:tab/><w:t>b</w:t></w:r></w:p>'
    text, hidden = extract.extract("a.DOCX", docx(body))
    assert text == f"{LONG}secret é\tb\n" and hidden == [(len(LONG), len(LONG) + 9)]


def test_text_encodings_and_rtf():
    assert extract.decode_text(b"\xff\xfea\x00") == "a" and extract.decode_text("é".encode()) == "é" and extract.decode_text(b"\x93x") == "“x"
    assert extract.rtf_text(r"{\rtf1{\fonttbl{\f0 Arial;}}caf\'e9 \u233? x\par y\emdash z}") == "café é x\ny—z"
    assert extract.reflow("This is a long line of text that wraps and is hyphen-\nated over lines which go on and\non here.\n\n- point") == "This is a long line of text that wraps and is hyphenated over lines which go on and on here.\n\n- point\n"


def test_files_and_errors(spark, tmp_path):
    (tmp_path / "a.txt").write_text(LONG)
    (tmp_path / "b.txt").write_text("short")
    (tmp_path / "c.xyz").write_text(LONG)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in extract.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == LONG and rows["b.txt"].error == "too little text" and "unsupported" in rows["c.xyz"].error
    web = extract.web_folder(spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")).collect()
    assert [(r.url, r.title) for r in web] == [("https://example.org/a.txt", "a")]


def test_html():
    page = '<html><head><title>x</title></head><body>Intro<p>Para &amp; b</p><!-- c --><div class="sharebar">no</div><p hidden>no</p><ul><li>a<li>b</ul>'
    assert html_to_text(page) == "IntroPara & b\na\nb\n" and html_to_text("") == html_to_text(None) == ""


def test_urls(spark):
    given = ["HTTP://www.m.Example.com/a/?b=2&utm_x=1&a=1&b=1#f", "https://example.com/", "nonsense", "https://e.com/?k&z=a b*~", "https://e.com/p?utm_a=1", "example.org/x?b=1", "//www.e.org/y/", "mailto:a@b.c", "not a scheme:x", ""]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(given)], "k int, u string").orderBy("k")
    assert [r.n for r in df.select(urls.normalize(F.col("u")).alias("n")).collect()] == ["https://example.com/a/?a=1&b=2&b=1", "https://example.com", "https://nonsense", "https://e.com/?k=&z=a+b%2A~", "https://e.com/p", "https://example.org/x?b=1", "https://e.org/y", "https:a@b.c", "not a scheme:x", "https:"]
    kinds = spark.createDataFrame([("https://www.mit.edu/x.pdf",), ("https://doi.org/1",), ("https://netflix.com/",)], "u string")
    assert [r.c for r in kinds.select(urls.classify(F.col("u")).alias("c")).collect()] == ["Publication", "Publication", "Internet"]
    assert [r.c for r in kinds.select(urls.is_skipped(F.col("u")).alias("c")).collect()] == [False, False, True]


def answers(spark, body):
    return spark.createDataFrame([(1, body if isinstance(body, str) else json.dumps(body))], "query_id int, body string")


def test_connectors(spark):
    hit = connectors.brave(answers(spark, {"web": {"results": [{"url": "u", "title": "<b>T</b> &amp; x", "description": "d"}]}})).first()
    assert (hit.url, hit.title, hit.snippet) == ("u", "T & x", "d")
    assert connectors.google(answers(spark, {"items": [{"link": "u", "title": "t", "snippet": "s"}]})).first().url == "u"
    assert connectors.bing_api(answers(spark, {"webPages": {"value": [{"url": "u", "name": "n", "snippet": "s"}]}})).first().title == "n"
    page = '<a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fe.org%2F&x=1">T</a><a class="result__snippet" href="x">S</a>'
    assert connectors.ddg_html(answers(spark, page)).first().url == "https://e.org/"
    page = '<li class="b_algo"><h2><a href="https://b.com/ck?u=a1aHR0cHM6Ly9lLm9yZy8">T</a></h2><p>S</p></li>'
    assert connectors.bing_html(answers(spark, page)).first().url == "https://e.org/"
    paper = {"results": [{"id": "w", "doi": "https://doi.org/1", "display_name": "T", "publication_year": 2020, "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "authorships": [{"author": {"display_name": "A"}}, {"author": {"display_name": "B"}}], "primary_location": {"source": {"display_name": "V"}}}, {"id": "x"}]}
    rows = connectors.openalex(answers(spark, paper)).collect()
    assert [(r.url, r.title, r.text) for r in rows] == [("https://doi.org/1", "T (A et al., V, 2020)", "a b a")]
    assert connectors.semantic_scholar(answers(spark, {"data": [{"title": "T", "abstract": "x", "url": "u", "year": 0, "externalIds": {"DOI": "9"}, "authors": []}]})).first().url == "https://doi.org/9"
    assert connectors.crossref(answers(spark, {"message": {"items": [{"DOI": "9", "title": ["T"], "abstract": "<p>x</p>"}]}})).first().text == "x"
    feed = "<feed><entry><id>http://arxiv.org/1</id><title>T\n t</title><summary>s</summary><published>2021-01-01</published><author><name>A</name></author></entry></feed>"
    assert connectors.arxiv(answers(spark, feed)).first().title == "T t (A, arXiv, 2021)"
    assert connectors.europe_pmc(answers(spark, {"resultList": {"result": [{"id": "1", "source": "MED", "title": "T", "authorString": "A, B", "abstractText": "x"}]}})).first().url == "https://europepmc.org/article/MED/1"
    assert connectors.core(answers(spark, {"results": [{"id": "1", "title": "T", "abstract": "x", "fullText": " full "}]})).first().text == "full"
    assert connectors.wikipedia(answers(spark, {"query": {"pages": {"5": {"title": "T", "extract": "x", "fullurl": "w"}}}})).first().title == "T - Wikipedia"
    hits = spark.createDataFrame([(1, "b", "x"), (1, "a", "y"), (2, "b", "z")], "query_id int, engine string, url string")
    assert {(r.query_id, r.url) for r in connectors.first_engine(hits, ["a", "b"]).collect()} == {(1, "y"), (2, "z")}


def test_store(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    got = store.replace_rows(rows, spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"))
    assert {(r.id, r.v) for r in got.collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert store.settings() == {"max_queries": 40, "max_pages": 40} and store.settings(900, 900) == {"max_queries": 200, "max_pages": 150}
    old = spark.sql("select 1 as id, 'x' as name, timestamp'2020-01-01' as created")
    new = spark.sql("select * from values (1, ' ', timestamp'2021-01-01'), (2, 'n', timestamp'2021-01-01') as t(id, name, created)")
    saved = {r.id: r for r in store.save_assignments(old, new, "2022-01-01 00:00:00").collect()}
    assert saved[1].name == "Untitled assignment" and saved[1].created.year == 2020 and saved[2].created.year == 2022
    cache = spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:00', true), ('b', timestamp'2024-01-01 00:00:00', false) as t(url, fetched, failed)")
    assert [r.url for r in search.fresh_pages(cache, "2024-01-02 01:00:00").collect()] == ["b"]


def test_pdf_lines(spark):
    glyphs = [(1, 0, 0.0, 100.0, 10.0, 10.0, "He"), (1, 1, 10.0, 100.0, 5.0, 10.0, "y"), (1, 2, 20.0, 100.0, 5.0, 10.0, "you"), (1, 3, 0.0, 86.0, 5.0, 10.0, "next"), (1, 4, 0.0, 50.0, 5.0, 10.0, "far")]
    df = spark.createDataFrame(glyphs, "page int, seq int, x double, y double, w double, font_size double, s string")
    lines = extract.page_lines(df)
    assert [r.text for r in lines.orderBy("line").collect()] == ["Hey you", "next", "far"]
    assert extract.page_text(lines).first().text == "Hey you\nnext\n\nfar"
    assert extract.better_page("ab", "abcdefghij") == "abcdefghij" and extract.better_page("abcdefghi", "abcdefghij") == "abcdefghi"


def test_streaming_equals_sequence(spark, tmp_path):
    words = [f"w{k}" for k in range(40)]
    papers = [{"ingest_seq": k, "doc_id": 100 + k, "assignment": "a", "text": " ".join(words[k : k + 20]) if k != 2 else ""} for k in range(4)]
    source = tmp_path / "in"
    source.mkdir()
    for k in (0, 1):
        (source / f"{k}.json").write_text("\n".join(json.dumps(p) for p in papers[2 * k : 2 * k + 2]))
        ingest.start(spark, str(source), str(tmp_path / "out")).awaitTermination(60)
    got = {r.doc_id: r for r in ingest.results(spark, str(tmp_path / "out")).collect()}
    assert [got[100 + k].matches for k in range(4)] == [0, 1, 0, 2] and got[102].status == "error"


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("select tokenize('A b') as t").first().t == ["a", "b"]
    assert spark.sql("select size(sentences('A cat. The dog.')) as n").first().n == 2
    text = "the quick brown fox jumps over the lazy dog"
    assert spark.sql(f"select * from match_passages('{text}', '{text}')").first().tok_to == 9
