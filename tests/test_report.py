from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import authorship, report
from palimpsest.operators.align import passages
from palimpsest.operators.report import Filters, Source, build
from palimpsest.shared import materialize

TEXT = (
    'Opening words of my own stand here first. "the quick brown fox jumps over the lazy dog near the river" (Doe, 2019).\n'
    "and the students measured water temperature every morning during seven weeks of summer before writing reports.\nReferences\nDoe, J. (2019). Title of it all."
)


def sources():
    found = []
    for k, (kind, src) in enumerate((("Internet", "the quick brown fox jumps over the lazy dog near the river"), ("Publication", "students measured water temperature every morning during seven weeks of summer before writing reports"))):
        blocks = [(b, p.start, p.end) for b, p in enumerate(passages(T.words_of(TEXT), src.split()))]
        found.append(Source(k, f"u{k}", f"t{k}", kind, blocks))
    return found


def test_report_groups_and_credit():
    r = build(TEXT, sources(), Filters())
    assert r["matched_words"] == 12 + 14 and sum(s["words"] for s in r["sources"]) == r["matched_words"] == sum(g["words"] for g in r["groups"])
    groups = {g["name"]: g["words"] for g in r["groups"]}
    assert groups["Cited and Quoted"] == 12 and groups["Not Cited or Quoted"] == 14
    assert [s["rank"] for s in r["sources"]] == [1, 2] and r["sources"][0]["id"] == 1


def test_filters_only_lower_the_index():
    full = build(TEXT, sources(), Filters())["matched_words"]
    for f in (Filters(exclude_quotes=True), Filters(exclude_bib=True), Filters(exclude_cited=True), Filters(exclude_small=13), Filters(excluded_sources=(0,)), Filters(excluded_matches=("1:0",))):
        assert build(TEXT, sources(), f)["matched_words"] <= full
    r = build(TEXT, sources(), Filters(excluded_sources=(1,)))
    assert r["sources"][-1]["excluded"] and r["matched_words"] == 12


def test_credit_ties_and_overshadowed_sources():
    import numpy as np

    def given(k, a, b):
        owned = np.full(20, -1)
        owned[a:b] = 0
        return Source(k, "", "", "Internet", [], owned, b - a)

    rank, order = report.credit([given(0, 0, 10), given(1, 6, 16), given(2, 2, 5)], 20)
    assert [s.id for s in order] == [0, 1] and (rank[:10] == 1).all() and (rank[10:16] == 2).all() and (rank[16:] == 0).all()


def test_windows_cover_every_sentence():
    assert authorship.windows([30, 30]) == [range(0, 2)]
    for words in ([20] * 40, [200, 10, 10, 300, 5], [74] * 9):
        got = authorship.windows(words)
        assert sorted({k for w in got for k in w}) == list(range(len(words)))


def test_dense_features_of_a_plain_passage():
    f = dict(zip(authorship.DENSE, authorship.dense_features("And we don't know. It is, however, pivotal! 12 cats?", {"we": 6.5, "cats": 4.0}), strict=True))
    assert len(authorship.DENSE) == 36 and f["contraction"] == 1.0 and f["ai_marker"] == 1.0 and f["conj_start"] == 1 / 3 and f["digit"] == 1.0


def test_evaluation_and_smoothing(spark):
    rows = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.1), (1, 2, 0.9), (1, 3, 0.82)], "doc_id long, sentence int, score double")
    got = {r.sentence: r.flagged for r in authorship.smooth(rows).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True}
    table = spark.createDataFrame([("a", True, 30), ("a", True, 0), ("a", False, 0), ("b", False, 0)], "grp string, available boolean, percent int")
    got = {r.grp: r for r in authorship.evaluate(table).collect()}
    assert (got["a"].docs, got["a"].scored, got["a"].ge20, got["a"].mean) == (3, 2, 50.0, 15.0) and got["b"].ge20 is None


def test_features_use_the_whole_lexicon(spark):
    rows = [(k, r.text) for k, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40).collect())]
    rows += [(None, rows[1][1]), (1, rows[1][1]), (90, None), (91, "It's the dog's and the cat's rareword that we don't know about in 12 more words here. " * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = {"the": 7.0, "it's": 0.0, "it": 6.2, "dog": 3.5, "rareword": 0.5} | {r.word: r.zipf for r in authorship.corpus_lexicon(docs.limit(20)).collect()}
    filler = spark.range(200_001).select(F.concat(F.lit("filler"), "id").alias("word"), F.lit(9.0).alias("zipf"))
    lexicon = filler.unionByName(spark.createDataFrame(list(few.items()), "word string, zipf double"))
    got = sorted(((r.doc_id, r.win, list(r.dense)) for r in authorship.featurize(docs, lexicon).collect()), key=lambda x: (repr(x[0]), x[1]))
    want = sorted(((d, k, authorship.dense_features(p, few)) for d, t in rows for k, (_, p) in enumerate(authorship.window_texts(t or ""))), key=lambda x: (repr(x[0]), x[1]))
    assert len(got) == len(want) > 20
    for (d, k, f), (d2, k2, f2) in zip(got, want, strict=True):
        assert (d, k) == (d2, k2) and all(abs(x - y) < 1e-8 for x, y in zip(f, f2, strict=True))


def test_training_reads_its_rows_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    lexicon = authorship.corpus_lexicon(docs)
    zipf = materialize(authorship.window_zipf(docs, lexicon), "zipf")
    rows = authorship.vectors(authorship.featurize(docs.mapInPandas(counted, docs.schema), lexicon, zipf=zipf)).withColumn("label", F.col("doc_id") % 2)
    authorship.train(rows, iterations=2)
    assert seen.value == 60


def test_features_without_terms(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20)
    lexicon = authorship.corpus_lexicon(docs)
    full, less = (sorted(map(tuple, authorship.featurize(docs, lexicon, terms=t).select("doc_id", "win", "words", "dense").collect())) for t in (True, False))
    assert full == less and not authorship.featurize(docs, lexicon, terms=False).where("size(terms) > 0").count()


ODD = [
    "It's - - odd -- isn't it? " * 40 + "We don't know, Dr. Foo said so. and then \u201cit\u201d went on \u2014 slowly. " * 40,
    "Heading without mark that goes on for many words here and there and everywhere so that it counts as prose of its own in the end\n" * 4,
    "Sh. A cat sat down on the mat here. Oh. \u0130stanbul \u03a3\u03a3 \u0430bc caf\u00e9 d\u2019\u00e9t\u00e9 12 34! " * 60,
    "", "no", "x" * 3000 + " one two three four five. " * 8,
]


def test_passages_equal_single_windows():
    zipf = {"it": 6.5, "we": 6.0, "cat": 4.2, "d": 2.0}
    held = authorship.Passages()
    for k, text in enumerate(ODD):
        held.add(k, text)
    held.close()
    want = [(k, w, m, p) for k, t in enumerate(ODD) for w, (m, p) in enumerate(authorship.window_texts(t))]
    assert [x[:3] for x in want] == held.rows and len(want) > 8
    for (_, _, _, part), row in zip(want, held.dense(zipf.get), strict=True):
        assert all(abs(x - y) < 1e-7 for x, y in zip(row, authorship.dense_features(part, zipf), strict=True))


def test_only_rare_words_are_joined(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(30)
    lexicon = authorship.corpus_lexicon(docs)
    assert authorship.window_zipf(docs, lexicon).count() == 0  # all are among those shipped
    get = lambda: sorted((r.doc_id, r.win, *(round(x, 9) for x in r.dense)) for r in authorship.featurize(docs, lexicon, terms=False).collect())
    every = get()
    monkeypatch.setattr(authorship, "SHIPPED", 50)
    assert authorship.window_zipf(docs, lexicon).count() > 0 and get() == every


def test_terms_hashed_in_place_equal_those_of_vectors(spark):
    docs = spark.createDataFrame([(k, t, k % 2) for k, t in enumerate(ODD)], "doc_id long, text string, label int")
    docs = docs.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text", (F.col("doc_id") % 2).cast("int").alias("label")).orderBy("doc_id").limit(20))
    lexicon = materialize(authorship.corpus_lexicon(docs), "lexicon")
    common = authorship.shipped(lexicon)
    zipf = materialize(authorship.window_zipf(docs, lexicon, common), "zipf")
    full = authorship.vectors(authorship.featurize(docs, lexicon, zipf=zipf))
    every = lambda rows: sorted((list(r.dense_vec), list(zip(r.sparse_vec.indices.tolist(), r.sparse_vec.values.round(9).tolist(), strict=True))) for r in rows.collect())
    assert every(authorship.labelled(docs, common, zipf)) == every(full)
    model = authorship.train(authorship.labelled(docs, common, zipf), iterations=3)
    one, other = (sorted((r.doc_id, r.win, list(r.members), round(r.p, 8)) for r in rows.collect()) for rows in (authorship.score_texts(docs, model, common, zipf), authorship.score_windows(full, model)))
    assert len(one) == len(other) > 20 and all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-7 for a, b in zip(one, other, strict=True))
