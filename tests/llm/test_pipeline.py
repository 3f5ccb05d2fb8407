"""The corpus pipeline against planted cases, and the registered SQL of the operators."""

import random
import subprocess
import sys

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from palimpsest.llm import registry
from palimpsest.llm.common import materialize

from .test_operators import WORDS, sentence

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents with an exact copy, a near copy, a repeated passage, a benchmark passage and text without letters."""
    rng = random.Random(21)
    folder = str(tmp_path_factory.mktemp("sf"))
    lines = lambda n: "\n".join(sentence(rng, 25) for _ in range(n))
    clean = {k: lines(6) for k in range(30)}
    item, passage = sentence(rng, 30), sentence(rng, 60)
    docs = dict(clean)
    docs[100] = clean[3]
    near = clean[4].replace("\n", " ").split()
    near[40] = rng.choice(WORDS)
    docs[101] = " ".join(clean[4].split())
    docs[102] = " ".join(near)
    docs[103] = f"{lines(2)}\n{item}\n{lines(2)}"
    docs[104], docs[105] = (f"{lines(3)}\n{passage}\n{lines(3)}" for _ in range(2))
    docs[106] = "123 456 !!! ###"
    rows = [(k, t, "en" if k % 2 else None, "src0", len(t)) for k, t in docs.items()] + [(200, None, "en", "src0", 0), (201, "", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, passage


def test_stages_take_effect_and_keep_clean_documents(spark, planted):
    folder, docs, passage = planted
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/stage-{name}"
        stage(spark, kept, folder).write.parquet(path)
        kept = spark.read.parquet(path)
        seen[name] = kept
        if name != "packing":
            assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: {r.doc_id for r in d.select("doc_id").distinct().collect()} for n, d in seen.items()}
    assert ids["language"] == set(docs) - {106}
    assert ids["lines"] == ids["language"] - {100}
    texts = {r.doc_id: r for r in seen["lines"].collect()}
    assert passage in texts[104].text and passage not in texts[105].text and texts[105].n_chars == len(texts[105].text)
    assert 102 not in ids["near"] and 4 in ids["near"] and ids["benchmark"] == ids["near"] - {103}
    assert set(range(30)) - {4} <= ids["benchmark"]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen["benchmark"].collect()}
    assert {r.doc_id: r.n for r in seen["packing"].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want


def test_run_equals_the_stages(spark, planted):
    folder, *_ = planted
    one = corpus_pipeline.run(spark, folder).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    two = spark.read.parquet(f"{folder}/stage-packing").groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert sorted(one) == sorted(two)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_operator_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SMALL)
    want = con.execute(registry.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.fetchall())


def test_rest_works_without_these_folders(tmp_path):
    """The entry points import, with the other queries, where the subpackage is gone."""
    import os
    import shutil

    root = os.path.dirname(corpus_pipeline.__file__)
    for name in ("palimpsest", "__spark_entry__.py"):
        source = os.path.join(root, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "palimpsest" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'similarity_index' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=env, check=False)
    assert done.returncode == 0, done.stderr


def test_small_tables_are_written_to_few_files(spark, tmp_path):
    """211 partitions of small tables made 211 files each, and processes for every file; on the table with hot keys that took an executor's memory twice."""
    schema = ", ".join(f"{c} {t}" for c, t in zip(corpus_pipeline.COLUMNS, ("long", "string", "string", "string", "long"), strict=True))
    spark.createDataFrame([(k, f"{k} words of a text", "en", "s", 10) for k in range(3000)], schema).write.parquet(str(tmp_path / "docs"))
    docs, most, before = spark.read.parquet(str(tmp_path / "docs")), 4 * spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 211)
        out = materialize(docs.repartition(211), "many")
        assert out.count() == 3000 and 1 < len(out.inputFiles()) <= most
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == list(range(3000))
        assert corpus_pipeline.language(spark, docs.repartition(211), "").rdd.getNumPartitions() <= most
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
