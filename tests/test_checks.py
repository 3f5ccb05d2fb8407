import gzip

from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import authorship, checks, store
from palimpsest.sources import tables

FOX = "quick brown fox jumps over lazy dog near river while students measured water temperature every morning"


def test_check_against_repository_and_found_sources(spark):
    subs = spark.createDataFrame([(1, f"Own words open this paper here. {FOX}."), (2, "  "), (3, "nothing of this text stands anywhere else in the whole collection")], "doc_id long, text string")
    repo = subs.select("doc_id", F.lit("t").alias("title"), "text").unionByName(spark.createDataFrame([(9, "old", f"{FOX} again")], "doc_id long, title string, text string"))
    short = " ".join(FOX.split()[:9])
    found = spark.createDataFrame(
        [(0, "http://www.a.org/x/", "a", "Internet", FOX), (1, "https://a.org/x?utm_source=q", "a2", "Internet", FOX), (2, "https://doi.org/1", "d", "Publication", short)],
        "src_id long, url string, title string, type string, text string",
    )
    rows = {r["doc_id"]: r for r in checks.check_submissions(subs, repo, found).collect()}
    assert rows[2]["status"] == "error" and rows[3]["status"] == "done" and rows[3]["matched_words"] == 0
    ids = {s["id"] for s in rows[1]["sources"]}
    assert ids == {0, 2, -10}  # one address once; never the paper itself
    assert rows[1]["matched_words"] == len(FOX.split()) and rows[1]["total_words"] == 6 + len(FOX.split())
    alone = {r["doc_id"]: r for r in checks.check_submissions(subs, repo, found, web=False).collect()}
    assert {s["id"] for s in alone[1]["sources"]} == {2, -10}
    assert text.cited_flags("", []) == []
    none = checks.check_submissions(subs, repo.limit(0), found.limit(0)).collect()
    assert len(none) == 3 and all(r["matched_words"] == 0 for r in none)


def test_machine_authorship_of_whole_papers(spark, monkeypatch):
    line = "The students of this school have measured the water in the river and wrote down what they saw on every single morning of a long and warm summer."
    body = "\n".join(f"{line} {line}" for _ in range(8))
    docs = spark.createDataFrame([(1, body), (2, line), (3, None)], "doc_id long, text string")
    monkeypatch.setattr(authorship, "vectors", lambda rows: rows)
    monkeypatch.setattr(authorship, "score_windows", lambda rows, model: rows.select("doc_id", "win", "members", F.lit(model).alias("p")))
    result, sentences = checks.detect_ai(docs, authorship.corpus_lexicon(docs), 0.9)
    got = {r["doc_id"]: r for r in result.collect()}
    assert got[1]["available"] and got[1]["percent"] == 100 and got[1]["flagged_words"] == got[1]["qualifying_words"] >= 300
    assert not got[2]["available"] and got[2]["percent"] == 0 and not got[3]["available"]
    assert {r["doc_id"] for r in sentences.collect()} == {1} and sentences.count() == 16
    low = checks.detect_ai(docs, authorship.corpus_lexicon(docs), 0.1)[0].where("doc_id = 1").first()
    assert low["percent"] == 0 and low["flagged_words"] == 0


def test_small_rules(spark):
    row = spark.range(1).select(
        checks.first_filled(F.lit(None).cast("string"), F.lit(" \t"), F.lit(" a ")).alias("a"), checks.first_filled(F.lit("")).alias("b"),
        checks.shown_percent(F.lit(0.4)).alias("c"), checks.shown_percent(F.lit(0.0)).alias("d"), checks.shown_percent(F.lit(1.5)).alias("e"),
        checks.author_guess(F.lit("Jane_Doe-Essay.1")).alias("f"), checks.author_guess(F.lit("Essay")).alias("g"),
    ).first()
    assert tuple(row) == (" a ", "", "<1%", "0%", "2%", "Jane Doe", "")
    some = spark.createDataFrame([("x", "X", None)], "id string, name string, created timestamp")
    assert checks.with_default_assignment(some, "Essays", "2024-01-01").count() == 1
    assert checks.with_default_assignment(some.limit(0), "Essays", "2024-01-01").first()["name"] == "Essays"
    keys = "doc_id long, src_id long, block int"
    blocks = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (1, 2, 0)], keys)
    kept = checks.visible_blocks(blocks, blocks.where("src_id = 1 and block = 0").unionByName(blocks.where("block = 0 and src_id = 1")), blocks.where("src_id = 2"))
    assert sorted(map(tuple, kept.collect())) == [(1, 1, 0), (1, 2, 0)]


def test_hidden_words_of_byte_spans(spark):
    body = "Één öffentlich überall hidden words here"
    start = len(body[: body.index("hidden")].encode())
    docs = spark.createDataFrame([(1, body, [(start, start + len("hidden words"))]), (2, body, []), (3, None, None)], "doc_id long, text string, hidden array<struct<start:int,end:int>>")
    assert {r["doc_id"]: r["words"] for r in store.hidden_words(docs).collect()} == {1: 2, 2: 0, 3: 0}


def test_line_and_table_files(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"id": "a", "label": 1, "group": "g", "text": "x"}\nno json\n{"id": "b", "label": 0, "text": "y"}\n')
    assert sorted(map(tuple, tables.labelled_texts(spark, str(tmp_path / "t.jsonl")).collect())) == [("a", 1, "g", "x"), ("b", 0, None, "y")]
    with gzip.open(tmp_path / "w.tsv.gz", "wt") as f:
        f.write('the\t7.5\nbad line\n"q\t3.25\n')
    assert sorted(map(tuple, tables.lexicon(spark, str(tmp_path / "w.tsv.gz")).collect())) == [('"q', 3.25), ("the", 7.5)]
    pages = spark.sql("select 'u' as url, timestamp'2024-01-01' as fetched, false as failed, 'old' as text")
    tables.write_pages(pages, str(tmp_path / "cache"))
    tables.write_pages(spark.sql("select 'u' as url, timestamp'2024-01-02' as fetched, false as failed, 'new' as text"), str(tmp_path / "cache"))
    assert [(r["url"], r["text"]) for r in tables.read_pages(spark, str(tmp_path / "cache")).collect()] == [("u", "new")]
    lines = tables.formatted_evaluation(spark.sql("select 'g' as grp, 3 as docs, 2 as scored, 50.0D as ge20, cast(null as double) as gt0, 12.3D as mean"))
    assert lines.first()["line"].split() == ["g", "3", "2", "50.0", "-", "12.3"]
