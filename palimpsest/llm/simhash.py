"""Document fingerprints by SimHash, and search of all fingerprints within a Hamming radius.

Terms are pairs of neighbouring words (with marks for the text's ends). A term's hash votes
with its weight on each bit: long words, which are rarer, weigh more. The search splits a fingerprint in radius + 1 blocks;
two fingerprints within the radius agree in one block at least, so a table per block, led by that
block, finds them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, short_batches, small

BITS = 256
GROUP = 1 << 20  # characters hashed at once
_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2) - 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _runs(b: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and unmixed hashes of the runs of bytes that are ``inside``."""
    n = len(b)
    up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _P, np.uint64))])
    sums = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n])])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    start, end = edge[::2], edge[1::2]
    down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _INV, np.uint64))])
    return start, end, (sums[end] - sums[start]) * down[start]


def _tally(word: np.ndarray, heavy: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Votes of n texts' term pairs, n x BITS, from their words' hashes, weights and texts, in order."""
    head = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    before = np.where(head, np.uint64(7), np.roll(word, 1))
    weight = heavy * np.where(head, 2.0, np.roll(heavy, 1))
    tail = np.roll(head, -1)
    term = np.concatenate([before * np.uint64(3) + word * _P, word[tail] * np.uint64(3) + np.uint64(11)])
    weight = np.concatenate([weight, heavy[tail] * 2])
    base = np.concatenate([doc, doc[tail]]) * 256
    out = np.empty((n, BITS))
    for k in range(BITS // 64):
        h = _mix(term + np.uint64((k + 1) * 0x632BE59BD9B4E019 % (1 << 64)))
        for j in range(8):
            byte = (h >> np.uint64(8 * j)).astype(np.uint8)
            held = np.bincount(base + byte, weights=weight, minlength=n * 256).reshape(-1, 256)
            out[:, k * 64 + j * 8 : k * 64 + j * 8 + 8] = held @ _SIGNS
    return out


def _votes(texts: list[str]) -> np.ndarray:
    """Votes of each text, texts x BITS."""
    raws = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) + 1 for r in raws])
    first = np.concatenate([[0], np.cumsum(sizes)])
    b = _FOLD[np.frombuffer(b"".join(r + b" " for r in raws), np.uint8)]
    inside = _WORD[b]
    have = np.add.reduceat(inside, first[:-1]) > 0
    for k in np.flatnonzero(~have & (sizes > 1)):  # no word: the whole text is one
        inside[first[k] : first[k + 1] - 1] = True
    start, end, value = _runs(b, inside)
    return _tally(_mix(value), np.minimum(end - start, 9).astype(np.float64), np.searchsorted(first, start, "right") - 1, len(texts))


def fingerprints(texts: list[str]) -> np.ndarray:
    """Packed fingerprints (texts x BITS / 8). A tie of votes is a zero bit; an empty text has only zeros."""
    out, at = [], 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) <= GROUP):
            size += len(texts[end])
            end += 1
        out.append(np.packbits((_long(texts[at]) if size > 8 * GROUP else _votes(texts[at:end])) > 0, axis=1))
        at = end
    return np.concatenate(out) if out else np.zeros((0, BITS // 8), np.uint8)


def _long(text: str) -> np.ndarray:
    """Votes of a very long text, the same as :func:`_votes`, added up over parts in bounded memory.

    A word that a cut goes through is put together again, and each part begins with the last word of the part before; that word's own two terms
    are taken off again.
    """
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    step = GROUP
    some = any(_WORD[_FOLD[raw[at : at + step]]].any() for at in range(0, len(raw), step))
    total, last = np.zeros((1, BITS)), None
    held, size = np.uint64(0), 0  # an open word's unmixed hash and bytes

    def feed(value: np.ndarray, sizes: np.ndarray) -> None:
        nonlocal total, last
        word, heavy = _mix(value), np.minimum(sizes, 9).astype(np.float64)
        if last is not None:
            word, heavy = np.concatenate([last[0], word]), np.concatenate([last[1], heavy])
            total -= _tally(*last, np.zeros(1, np.int64), 1)
        total += _tally(word, heavy, np.zeros(len(word), np.int64), 1)
        last = word[-1:], heavy[-1:]

    for at in range(0, len(raw), step):
        b = _FOLD[raw[at : at + step]]
        start, end, value = _runs(b, _WORD[b] if some else np.ones(len(b), bool))
        sizes = end - start
        if size and len(start) and start[0] == 0:
            shift = np.uint64(pow(int(_P), size, 1 << 64))
            value[:1] = held + shift * value[:1]
            sizes[0] += size
        elif size:
            value, sizes = np.concatenate([[held], value]), np.concatenate([[size], sizes])
        size = 0
        if len(end) and end[-1] == len(b):
            held, size = value[-1], int(sizes[-1])
            value, sizes = value[:-1], sizes[:-1]
        if len(value):
            feed(value, sizes)
    if size:
        feed(np.array([held], np.uint64), np.array([size]))
    return total


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.unpackbits(a ^ b, axis=1).sum(1) / BITS


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents and of their edited texts, in ascending order of ``doc_id``.

    Texts are shuffled once, by ranges of the id; a task walks through its range in order. What crosses ranges, one document each,
    is joined afterwards. Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    Null texts are empty; a null id comes first; ties of the id are ordered by a hash of the text. A single row is its own next one. Of repeated rows each is a document of its own. Texts of
    any length are fingerprinted whole. An empty table gives no rows.
    """
    keyed = short_batches(docs).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    columns = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split()[0] for c in columns.split(", ")]

    def result(ids: list, texts: list[str], marks: np.ndarray, following: list[str], next_marks: np.ndarray) -> dict[str, pa.Array]:
        new = [edited(t, f) for t, f in zip(texts, following, strict=True)]
        after = fingerprints(new)
        return {
            "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in new], pa.string()),
            "fingerprint": pa.array([m.tobytes().hex() for m in marks], pa.string()),
            "edited_fingerprint": pa.array([m.tobytes().hex() for m in after], pa.string()),
            "near_edited": pa.array(likeness(marks, after)), "near_next": pa.array(likeness(marks, next_marks)),
        }

    def filled(kind: str, part: int, text: str | None, found: dict[str, pa.Array], n: int = 1) -> pa.RecordBatch:
        got = {"kind": pa.array([kind] * n, pa.string()), "part": pa.array([part] * n, pa.int64()), "text": pa.array([text] * n, pa.string())} | found
        types = {"doc_id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
        return pa.RecordBatch.from_arrays([got[c] if c in got else pa.nulls(n, types.get(c, pa.string())) for c in ["kind", "part", "text", *names]], ["kind", "part", "text", *names])

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, begun = TaskContext.get().partitionId(), None, False
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < 4 * GROUP):
                    size += len(texts[end])
                    end += 1
                some, these, marks = texts[at:end], ids[at:end], fingerprints(texts[at:end])
                if not begun:
                    begun = True
                    yield filled("head", part, some[0], {})
                if held:
                    these, some, marks = [held[0], *these], [held[1], *some], np.concatenate([held[2], marks])
                if len(some) > 1:
                    yield filled("row", part, None, result(these[:-1], some[:-1], marks[:-1], some[1:], marks[1:]), len(some) - 1)
                held = these[-1], some[-1], marks[-1:]
                at = end
        if held:
            yield filled("tail", part, held[1], {"doc_id": pa.array([held[0]], pa.int64())})

    walked = materialize(ranged.select("doc_id", "text").mapInArrow(walk, f"kind string, part long, text string, {columns}"), "simhash")
    parts = sorted(r.part for r in walked.where("kind = 'head'").select("part").collect())  # a number per partition
    after = {p: parts[(k + 1) % len(parts)] for k, p in enumerate(parts)}
    order = docs.sparkSession.createDataFrame(list(after.items()), "part long, next_part long")

    def join_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, *texts in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "next_text")), strict=True):
                marks = fingerprints(texts)
                yield pa.RecordBatch.from_pydict(result([doc], texts[:1], marks[:1], texts[1:], marks[1:]))

    heads = walked.where("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    ends = walked.where("kind = 'tail'").select("part", "doc_id", "text").join(order, "part").join(heads, "next_part")
    return walked.where("kind = 'row'").select(*names).unionByName(ends.select("doc_id", "text", "next_text").mapInArrow(join_ends, columns))


def near_fingerprints(marks: DataFrame, queries: DataFrame, radius: int = 8) -> DataFrame:
    """All pairs of distinct fingerprints, one from ``queries`` and one from ``marks``, within ``radius`` bits.

    Both have a column ``fingerprint`` of hexadecimal digits; repeated ones count once, and a fingerprint is not paired with itself. Null fingerprints match nothing, and an empty table gives no rows.
    A fingerprint has the same length whatever the text's. Returns ``fingerprint, other, distance``. Each pair is kept by the first block in which it agrees.
    """
    digits = BITS // 4
    cuts = [round(k * digits / (radius + 1)) for k in range(radius + 2)]
    bounds = list(zip(cuts, cuts[1:], strict=False))

    def tables(df: DataFrame, name: str) -> DataFrame:
        blocks = F.array(*(F.substring("fingerprint", 1 + a, b - a) for a, b in bounds))
        return df.select("fingerprint").distinct().select(F.col("fingerprint").alias(name), F.posexplode(blocks).alias("table", "block"))

    def word(name: str, k: int) -> Column:
        return F.conv(F.substring(name, 1 + 8 * k, 8), 16, 10).cast("long")

    distinct = queries.select("fingerprint").distinct()
    a, b = tables(distinct, "q"), tables(marks, "m")
    distance = sum((F.bit_count(word("q", k).bitwiseXOR(word("m", k))) for k in range(digits // 8)), F.lit(0))
    sooner = F.lit(False)
    for k, (lo, hi) in enumerate(bounds):
        sooner = sooner | (F.lit(k) < F.col("table")) & (F.substring("q", 1 + lo, hi - lo) == F.substring("m", 1 + lo, hi - lo))
    joined = b.join(small(a), ["table", "block"])
    joined = joined.where((F.col("q") != F.col("m")) & ~sooner).withColumn("distance", distance).where(F.col("distance") <= radius)
    return joined.select(F.col("q").alias("fingerprint"), F.col("m").alias("other"), "distance")


def near_counts(marks: DataFrame, queries: DataFrame, radius: int = 8) -> DataFrame:
    """``fingerprint, n_near`` for the fingerprints of ``queries``: how many other documents have one within the radius. Equal fingerprints are found as one, and counted as many.

    Null fingerprints have no row; no queries, or no documents, give no rows.
    """
    sizes = marks.groupBy("fingerprint").agg(F.count("*").alias("c"))
    found = near_fingerprints(sizes, queries, radius).join(sizes.withColumnRenamed("fingerprint", "other"), "other")
    more = found.groupBy("fingerprint").agg(F.sum("c").alias("more"))
    asked = sizes.join(queries.select("fingerprint").distinct(), "fingerprint", "left_semi")
    return asked.join(more, "fingerprint", "left").select("fingerprint", (F.col("c") - 1 + F.coalesce("more", F.lit(0))).alias("n_near"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document, by :func:`with_next`."""
    return with_next(read(spark, sf_dir, "documents"))
