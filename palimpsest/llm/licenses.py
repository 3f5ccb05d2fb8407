"""Licence scans (DataFrame and SQL functions only).

Lines of files (headers) and whole licence files are compared with templates by the cosine of sparse TF-IDF
vectors: lines with short notices, licence files with these and with full licence texts, their first lines with titles. A directory whose licence file is recognised passes its licence on: a file without a
licence of its own takes that of its nearest ancestor directory, found by joins on paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from importlib import resources
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import UPPER, ascii_lower, materialize, read, release, small

#: Short notices by licence. Fixed values; more can be given as a parameter.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0",
}
TITLES = {
    "AGPL-3.0": "GNU Affero General Public License Version 3, 19 November 2007",
    "Apache-2.0": "Apache License Version 2.0, January 2004",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International",
    "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 International",
    "CC-BY-NC-ND-4.0": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International",
    "CC-BY-NC-SA-4.0": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International",
    "CC-BY-ND-4.0": "Creative Commons Attribution-NoDerivatives 4.0 International",
    "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International",
    "CC0-1.0": "CC0 1.0 Universal",
    "GPL-2.0": "GNU General Public License Version 2, June 1991",
    "GPL-3.0": "GNU General Public License Version 3, 29 June 2007",
    "LGPL-2.1": "GNU Lesser General Public License Version 2.1, February 1999",
    "LGPL-3.0": "GNU Lesser General Public License Version 3, 29 June 2007",
    "MIT": "MIT License",
    "MPL-1.1": "Mozilla Public License Version 1.1",
    "MPL-2.0": "Mozilla Public License Version 2.0",
}
#: Lines at the head of a licence file, blank ones left out, that may make up its title.
TITLE_LINES = 3
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying)(\.[a-z]+)?$"
_SPLIT = "[^a-z0-9.]+"


def terms(text: str) -> list[str]:
    """Runs of letters a-z (A-Z count as these), digits and dots; one dot at the end is no part of a term."""
    low = text.translate(str.maketrans(UPPER, UPPER.lower()))
    return [t for t in (re.sub(r"[.]$", "", w) for w in re.split(_SPLIT, low)) if t]


def full_texts() -> dict[str, str]:
    """Full licence texts by licence, from the files beside this module."""
    return {p.name.removesuffix(".txt"): p.read_text("utf-8") for p in (resources.files(__package__) / "licence_texts").iterdir() if p.name.endswith(".txt")}


def _vector(text: str, idf: dict[str, float]) -> dict[str, float]:
    """A template's terms with their weights, of length 1."""
    own = Counter(terms(text))
    weight = {t: k * idf[t] for t, k in own.items()}
    norm = math.sqrt(sum(w * w for w in weight.values()))
    return {t: w / norm for t, w in weight.items()}


def _runs(text: Column) -> Column:
    return F.split(ascii_lower(text), _SPLIT, -1)


def _tokens(text: Column) -> Column:
    return F.filter(F.transform(_runs(text), lambda w: F.regexp_replace(w, "[.]$", "")), lambda t: t != "")


def _holds(text: Column, parts: list[str]) -> Column:
    """Whether any of some substrings occurs, lower-casing once."""
    return F.exists(F.array(ascii_lower(text)), lambda t: reduce(or_, (t.contains(p) for p in parts), F.lit(False)))


def term_counts(files: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``term, df``: number of files that hold each of the templates' terms, over all files.

    A file's words are joined with the vocabulary (its size is that of the templates) and grouped by file before anything is shuffled.
    """
    known = [(v, t) for t in vocabulary for v in (t, t + ".")]
    if not known:
        return files.sparkSession.createDataFrame([], "term string, df long")
    numbered = files.select(F.monotonically_increasing_id().alias("file"), "text")
    words = numbered.select("file", F.explode(_runs(F.col("text"))).alias("word"))
    held = words.join(F.broadcast(files.sparkSession.createDataFrame(known, "word string, term string")), "word")
    return held.groupBy("file", "term").agg(F.lit(1)).groupBy("term").agg(F.count("*").alias("df"))


def _licence_files(lines: DataFrame, idf: dict[str, float], unseen: float, texts: dict[str, str], titles: dict[str, str], threshold: float) -> DataFrame:
    """``row, licence, score, kind`` of licence files: whole files against full texts (``file``), their first lines, joined, against titles (``header``)."""
    spark = lines.sparkSession
    model = [(kind, name, t, w) for kind, given in (("file", texts), ("header", titles)) for name, text in given.items() for t, w in _vector(text, idf).items()]
    model = F.broadcast(spark.createDataFrame(model, "kind string, licence string, term string, tw double"))
    weights = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))
    named = lines.where(F.col("path").rlike(LICENCE_FILE) & F.col("text").isNotNull()).select("row", "text")
    first = f"slice(filter(split(text, '\\n'), x -> trim(BOTH ' \t\r' FROM x) <> ''), 1, {TITLE_LINES})"
    named = named.withColumn("first", F.expr(first))
    parts = named.select("row", F.explode(F.expr(
        "concat(array(named_struct('kind', 'file', 'part', text)),"
        " transform(sequence(1, greatest(size(first), 1)), k -> named_struct('kind', 'header', 'part', array_join(slice(first, 1, k), ' '))))"
    )).alias("p")).select("row", "p.kind", "p.part").distinct()
    parts = parts.withColumn("n", F.xxhash64("row", "kind", "part"))
    # a cosine is at most the length of the template's vector over the terms shared: only parts that can reach the threshold are weighed in full
    shared = parts.select("n", "kind", F.explode(F.array_distinct(_tokens(F.col("part")))).alias("term")).join(model, ["kind", "term"])
    able = shared.groupBy("n", "licence").agg(F.sum(F.col("tw") * F.col("tw")).alias("s")).where(F.col("s") >= threshold * threshold - 1e-6).select("n").distinct()
    able = materialize(parts.join(able, "n", "left_semi"), "able")
    bag = able.select("n", "kind", F.explode(_tokens(F.col("part"))).alias("term")).groupBy("n", "kind", "term").agg(F.count("*").alias("tf"))
    bag = bag.join(weights, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    norms = bag.groupBy("n").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = bag.join(model, ["kind", "term"]).groupBy("n", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norms, "n").select("n", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    return scored.join(able.select("n", "row", "kind"), "n").select("row", "licence", "score", "kind")


def scan(
    files: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.7, texts: dict[str, str] | None = None, titles: dict[str, str] | None = None
) -> DataFrame:
    """Licences of files: ``path, licence, score, found`` plus all other columns but ``text``.

    ``files`` needs ``path`` and ``text``. ``found`` is ``file`` (a licence file as a whole), ``header`` (a line, or the title of a licence file), ``inherited`` (``origin`` then names the directory) or ``none``.
    Weights are the terms' counts times ln((1 + files) / (1 + files with the term)) + 1; a term of no template weighs as one that no file has.
    Ties of the score go to the template first by name; of several licence files in a directory the best score holds, then the shorter path, then the first name.

    Lines and licence files are compared with ``templates``, licence files also with ``texts`` and their first lines with ``titles``, weighed by the terms of these two.
    Without ``templates`` all three have default values; with them, full texts and titles are those given, if any.

    Null and empty texts have no licence of their own; a null path has no directory and inherits nothing; repeated rows get a result each; an empty table gives no rows.
    """
    if templates is None:
        templates, texts, titles = TEMPLATES, full_texts() if texts is None else texts, TITLES if titles is None else titles
    texts, titles = texts or {}, titles or {}
    spark = files.sparkSession
    rest = [c for c in files.columns if c not in ("path", "text")]
    files = files.select("path", "text", *rest)
    vocabulary = sorted({t for text in templates.values() for t in terms(text)})
    wider = sorted({t for text in (*texts.values(), *titles.values()) for t in terms(text)})
    counts = {r.term: r.df for r in term_counts(files, sorted({*vocabulary, *wider})).collect()}  # at most one row for each term of the templates
    total = files.count()
    idf, wider_idf = ({t: math.log((1 + total) / (1 + counts.get(t, 0))) + 1 for t in known} for known in (vocabulary, wider))
    unseen = math.log(1 + total) + 1
    vectors, anchors = [], set()
    for name, text in templates.items():
        weight = _vector(text, idf)
        vectors += [(name, t, w) for t, w in weight.items()]
        left = 0.0  # a text that shares only the terms left out here has a smaller cosine than the threshold
        for t, w in sorted(weight.items(), key=lambda x: (x[1], x[0])):
            left += w**2
            if math.sqrt(left) >= threshold:
                anchors.add(t)
    model = spark.createDataFrame(vectors, "licence string, term string, tw double") if vectors else spark.createDataFrame([], "licence string, term string, tw double")
    weights = F.broadcast(spark.createDataFrame(list(idf.items()) or [("", 0.0)], "term string, idf double"))

    lines = files.select(F.struct("path", *rest, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text__")).alias("row"), "path", "text")
    # A part that shares an anchor has it as a substring, and so has its file: a cheap test first
    cues = sorted(anchors) or ["\0"]
    parts = lines.where(_holds(F.col("text"), cues)).select("row", F.explode(F.expr(
        f"concat(transform(split(coalesce(text, ''), '\\n'), x -> named_struct('kind', 'header', 'part', x)),"
        f" if(coalesce(path, '') rlike '{LICENCE_FILE.replace(chr(92), chr(92) * 2)}', array(named_struct('kind', 'file', 'part', coalesce(text, ''))), array()))"
    )).alias("p"))
    either = F.array(*(F.lit(v) for c in cues for v in (c, c + ".")))
    near = parts.select("row", "p.kind", "p.part").where(_holds(F.col("part"), cues)).where(F.arrays_overlap(_runs(F.col("part")), either))
    near = near.select("row", "kind", _tokens(F.col("part")).alias("t"))
    near = materialize(near.select("row", "kind", "t").distinct(), "parts").withColumn("n", F.monotonically_increasing_id())
    near = materialize(near, "numbered")
    bag = near.select("n", F.explode("t").alias("term")).groupBy("n", "term").agg(F.count("*").alias("tf"))
    bag = bag.join(weights, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    norms = bag.groupBy("n").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = bag.join(F.broadcast(model), "term").groupBy("n", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norms, "n").select("n", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc("licence"), F.asc("kind"))
    own = scored.join(near.select("n", "row", "kind"), "n").select("row", "licence", "score", "kind")
    if wider:
        own = own.unionByName(_licence_files(lines, wider_idf, unseen, texts, titles, threshold))
    own = own.withColumn("k", F.row_number().over(order)).where("k = 1").select("row", "licence", "score", "kind")
    own = materialize(own, "own")

    directory = "case when {0} is null then null when instr({0}, '/') > 0 then substring_index({0}, '/', size(split({0}, '/')) - 1) else '' end"
    listed = lines.select("row", "path", F.expr(directory.format("path")).alias("dir"))
    heads = own.where(F.col("row.path").rlike(LICENCE_FILE)).select(F.expr(directory.format("row.path")).alias("dir"), "licence", "score", F.col("row.path").alias("path"))
    heads = heads.groupBy("dir").agg(F.min_by("licence", F.struct(-F.col("score"), F.length("path"), F.col("licence"))).alias("licence"))
    heads = materialize(heads, "heads")
    above = "transform(sequence(0, size(split(dir, '/'))), k -> substring_index(dir, '/', k))"
    dirs = listed.select("dir").where("dir is not null").distinct()
    up = dirs.select("dir", F.posexplode(F.expr(f"array_distinct({above})")).alias("depth", "at"))
    given = up.join(heads.withColumnRenamed("dir", "at"), "at").groupBy("dir").agg(F.max_by(F.struct("licence", "at"), "depth").alias("from"))
    given = materialize(given, "given")
    out = listed.join(small(own), "row", "left").join(small(given), "dir", "left")
    mine = F.col("licence").isNotNull()
    out = out.select(
        "row.path", *(F.col(f"row.{c}").alias(c) for c in rest),
        F.coalesce("licence", "from.licence").alias("licence"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.when(mine, F.col("kind")).when(F.col("from.licence").isNotNull(), "inherited").otherwise("none").alias("found"),
        F.when(~mine, F.col("from.at")).alias("origin"),
    )
    release(near)
    return out


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: ``source/thousand/hundred/doc_id.txt``; every seventh is a ``LICENSE``, of its source, thousand or hundred in turn."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("source", F.lit("none")).alias("source"))
    thousand, hundred = F.expr("cast(doc_id div 1000 as string)"), F.expr("cast(doc_id div 100 as string)")
    place = F.pmod(F.expr("doc_id div 7"), F.lit(3))
    path = F.when(F.pmod("doc_id", F.lit(7)) != 0, F.concat_ws("/", "source", thousand, hundred, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    path = path.when(place == 0, F.concat_ws("/", "source", F.lit("LICENSE"))).when(place == 1, F.concat_ws("/", "source", thousand, F.lit("LICENSE")))
    path = path.otherwise(F.concat_ws("/", "source", thousand, hundred, F.lit("LICENSE")))
    return scan(docs.select(path.alias("path"), "text", "doc_id")).select("doc_id", "path", "licence", "score", "found", "origin")
