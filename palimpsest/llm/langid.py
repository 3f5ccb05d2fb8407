"""Language identification with string kernels.

Blended-spectrum presence kernel: a text is the set of its byte n-grams for n = 1, 2, 3; the kernel of two texts is the number of n-grams both have, divided
by the geometric mean of their own numbers. Nystroem landmarks from the training sample give
the feature map, one-versus-rest kernel ridge regression the weights. A batch of
texts is scored by the product of its (sparse) presence matrix, the landmarks' presence matrix and the weights; the latter two are multiplied beforehand.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_worker_caches, read, short_batches, small

#: First number of the n-grams of each length; an n-gram's bytes count from there.
BLOCKS = {1: 0, 2: 1 << 8, 3: (1 << 8) + (1 << 16)}
STEP = 1 << 20
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def spectrum(text: str) -> np.ndarray:
    """Sorted numbers of all n-grams of a whole text, each once; a megabyte at a time."""
    raw, out = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8), np.zeros(0, np.int32)
    for at in range(0, len(raw), STEP):
        b = raw[max(0, at - 2) : at + STEP].astype(np.int32)
        parts = [b]
        for n in (2, 3):
            parts.append((parts[-1][: max(len(b) - n + 1, 0)] << 8) + b[n - 1 :])
        codes = np.unique(np.concatenate([p + BLOCKS[n] for n, p in enumerate(parts, 1)]))
        out = np.union1d(out, codes) if len(out) else codes
    return out


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray  # sorted numbers of the landmarks' n-grams
    table: np.ndarray  # for each of these and each language: the sum of the weights of the landmarks that have it, over their norms

    def values(self, spectra: list[np.ndarray]) -> np.ndarray:
        """A row per text with one value per language, about -1 to 1."""
        flat = np.concatenate(spectra)
        place = np.minimum(np.searchsorted(self.grams, flat), len(self.grams) - 1)
        rows = np.where((self.grams[place] == flat)[:, None], self.table[place], np.float32(0))
        sizes = np.array([len(s) for s in spectra])
        return np.add.reduceat(rows, np.cumsum([0, *sizes[:-1]]), axis=0) / np.sqrt(sizes)[:, None]


def kernel(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Kernel of every text of ``a`` with every one of ``b``, which are given by their spectra."""
    grams = np.unique(np.concatenate(b))
    held = np.zeros((len(b), len(grams)), np.float32)
    for row, s in zip(held, b, strict=True):
        row[np.searchsorted(grams, s)] = 1 / np.sqrt(max(len(s), 1))
    out = np.empty((len(a), len(b)))
    for row, s in zip(out, a, strict=True):
        place = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
        row[:] = held[:, place[grams[place] == s]].sum(1) / np.sqrt(max(len(s), 1))
    return out


def fit_ridge(spectra: list[np.ndarray], labels: list[str], per_lang: int, ridge: float) -> Model:
    langs = sorted(set(labels))
    y = np.array(labels)
    marks = [int(k) for lang in langs for k in np.flatnonzero(y == lang)[:per_lang]]
    with_marks = kernel(spectra, [spectra[k] for k in marks])
    values, vectors = np.linalg.eigh(with_marks[marks])
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])  # the Nystroem map
    z = with_marks @ root
    target = np.where(y[:, None] == np.array(langs)[None], 1.0, -1.0)
    share = (target > 0).mean(0)
    w = np.where(target > 0, 0.5 / share, 0.5 / np.maximum(1 - share, 1e-9))  # each language against the rest, evenly
    weights = np.stack([np.linalg.solve(z.T @ (w[:, [k]] * z) + ridge * np.eye(z.shape[1]), z.T @ (w[:, k] * target[:, k])) for k in range(len(langs))], 1)
    weights = root @ weights
    grams = np.unique(np.concatenate([spectra[k] for k in marks]))
    table = np.zeros((len(grams), len(langs)))
    for k, weight in zip(marks, weights, strict=True):
        table[np.searchsorted(grams, spectra[k])] += weight / np.sqrt(max(len(spectra[k]), 1))
    return Model(langs, grams, table.astype(np.float32))


def folds(key: Column, n: int) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def fit(docs: DataFrame, sample_per_lang: int = 400, landmarks_per_lang: int = 40, ridge: float = 1e-2, max_bytes: int = 1 << 15) -> Model:
    """Fits on at most ``sample_per_lang`` labelled texts of each language of at most ``max_bytes`` bytes, the first by a hash of the id.

    Only ids and languages are ranked; what reaches the driver are the n-grams of each sampled text, a few thousand numbers, so it grows with the number of languages only.
    Null languages, null texts and texts without a letter are not learned from. Repeated rows, and rows that share an id and a language, are all learned from. Without any text the model knows no language.
    """
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), F.col("doc_id")))
    labelled = docs.where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("doc_id").isNotNull() & (F.octet_length("text") <= max_bytes))
    chosen = labelled.select("lang", "doc_id").distinct().withColumn("rank", rank).where(F.col("rank") <= sample_per_lang)
    texts = labelled.select("doc_id", "lang", "text").join(small(chosen.select("doc_id", "lang")), ["doc_id", "lang"], "left_semi")

    def spectra(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(lang, spectrum(text).astype("<i4").tobytes()) for lang, text in zip(batch["lang"], batch["text"], strict=True) if text and _LETTER.search(text)]
            yield pd.DataFrame(out, columns=["lang", "grams"])

    got = short_batches(texts).select("lang", "text").mapInPandas(spectra, "lang string, grams binary").collect()
    got.sort(key=lambda r: (r.lang, bytes(r.grams)))
    if not got:
        return Model([], np.zeros(0, np.int32), np.zeros((0, 0), np.float32))
    order = np.random.default_rng(0).permutation(len(got))
    return fit_ridge([np.frombuffer(bytes(got[k].grams), "<i4") for k in order], [got[k].lang for k in order], landmarks_per_lang, ridge)


def predict(docs: DataFrame, model: Model, keep: list[str], batch_rows: int = 256) -> DataFrame:
    """``keep`` columns plus ``lang_pred, score, claim``: ``claim`` is the best language's value against the rest, above 0 where that language claims the text.

    Texts that are null or have no letter are ``und`` with score and claim 0, and so is every text if nothing was learned. Ties go to the first language by name.
    Whole texts count, whatever their length. Repeated rows, and rows that share an id, get a result each; an empty table gives no rows.
    """
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        drop_worker_caches()
        for whole in batches:
            lang, score, claim = np.full(len(whole), UNKNOWN, object), np.zeros(len(whole)), np.zeros(len(whole))
            known = [k for k, t in enumerate(whole) if t and _LETTER.search(t)] if model.langs else []
            at = 0
            while at < len(known):
                some, spectra, size = [], [], 0
                while at < len(known) and len(some) < batch_rows and size < STEP:
                    some.append(known[at])
                    spectra.append(spectrum(whole.iat[known[at]]))
                    size += len(spectra[-1])
                    at += 1
                value = model.values(spectra)
                soft = np.exp(4 * (value - value.max(1, keepdims=True)))
                lang[some] = np.array(model.langs, object)[value.argmax(1)]
                score[some] = 1 / soft.sum(1)
                claim[some] = value.max(1)
            yield pd.DataFrame({"lang_pred": lang, "score": score, "claim": claim})

    # Only the texts go to Python. Not deterministic to the planner, so that a filter on the result does not run it twice.
    run = F.pandas_udf(scored, "lang_pred string, score double, claim double").asNondeterministic()
    return short_batches(docs).select(*keep, run("text").alias("scored__")).select(*keep, "scored__.lang_pred", "scored__.score", "scored__.claim")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; learns only from rows outside the held-out fold. Null ids are learned from as little."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.col("doc_id").isNotNull() & (folds(F.col("doc_id"), 5) == 0)
    model = fit(docs.where(~held))
    out = predict(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
