"""Line dedup by pairwise alignment.

Overlapping documents are found through shared hashes of lines and of runs of adjacent lines. Alignment is patience diff: lines that are
unique in both documents, in longest increasing order, are anchors; gaps between anchors are aligned in turn. Aligned common blocks of enough words
are deleted from the later document. The result is that of aligning all pairs, but few are aligned:

Of a line or run that several documents hold, the earliest holder (smallest id) is the first partner of all others. Each line of a block of enough words lies in one of the
block's shortest runs of enough words, from its left or right end, and that run is shared, whichever the earlier document. A diff with the earliest holder fails to align a shared run only where other blocks cross it,
or lines repeat. Only such runs (not yet deleted, but held earlier) go on to further holders: the one before the document, then the two before that, then four, until the run
is aligned or no holder is left.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import drop_worker_caches, materialize, read, release, short_batches, small

KEY = ["doc_id", "version"]
#: Rows that go to a Python worker at once; a row of a pair has all lines of both documents.
BATCH = 200


def _patience(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int, out: list[tuple[int, int]]) -> None:
    """Aligned index pairs of a[a0:a1] and b[b0:b1], appended in order."""
    stack = [(a0, a1, b0, b1)]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if a1 < 0:  # a pair that was put off until what stands before it was done
            out.append((a0, b0))
            continue
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        ends = []
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            ends.append((a1, b1))
        later = [(x, -1, y, -1) for x, y in ends]
        if a0 < a1 and b0 < b1:
            once: dict[int, list[int]] = {}
            for side, (seq, lo, hi) in enumerate(((a, a0, a1), (b, b0, b1))):
                for k in range(lo, hi):
                    seen = once.setdefault(seq[k], [0, 0, 0, 0])
                    seen[side] += 1
                    seen[2 + side] = k
            unique = sorted((v[2], v[3]) for v in once.values() if v[0] == v[1] == 1)
            tops, last, back = [], [], [-1] * len(unique)
            for k, (_, y) in enumerate(unique):
                at = bisect_left(tops, y)
                back[k] = last[at - 1] if at else -1
                if at == len(tops):
                    tops.append(y)
                    last.append(k)
                else:
                    tops[at], last[at] = y, k
            chain, k = [], last[-1] if last else -1
            while k >= 0:
                chain.append(unique[k])
                k = back[k]
            if chain:
                todo, x0, y0 = [], a0, b0
                for x, y in reversed(chain):
                    todo += [(x0, x, y0, y), (x, -1, y, -1)]
                    x0, y0 = x + 1, y + 1
                todo.append((x0, a1, y0, b1))
                stack += later
                stack += reversed(todo)
                continue
        stack += later


def aligned_blocks(early: list[int], late: list[int]) -> list[tuple[int, int]]:
    """Blocks ``[start, end)`` of line numbers of ``late`` whose lines run on equally in ``early``."""
    pairs: list[tuple[int, int]] = []
    _patience(early, late, 0, len(early), 0, len(late), pairs)
    blocks: list[list[int]] = []
    for k, (x, y) in enumerate(pairs):
        if k and pairs[k - 1] == (x - 1, y - 1):
            blocks[-1][1] = y + 1
        else:
            blocks.append([y, y + 1])
    return [(s, e) for s, e in blocks]


_WHITE = re.compile(rb"[ \t\r\x0b\x0c]+")


def _line_words(text: bytes, lines: list[bytes]) -> list[int]:
    """Words of each trimmed line of a text, as split at white space; blank lines have none."""
    if any(x in text for x in (b"  ", b"\t", b"\r", b"\x0b", b"\x0c")):
        return [1 + len(_WHITE.findall(x)) if x else 0 for x in lines]
    return [1 + x.count(b" ") if x else 0 for x in lines]


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, version, hashes, words`` per document: a hash of the text, a hash and a count of words for each line. Blank lines have hash 0."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        for batch in batches:
            lines: list[bytes] = []
            words: list[int] = []
            bounds = [0]
            for text in batch.column("text").to_pylist():
                own = [x.strip(b" \t\r") for x in text.split(b"\n")]
                words += _line_words(text, own)
                lines += own
                bounds.append(len(lines))
            count = np.array(words, "int32")
            hashes = np.where(count > 0, pd.util.hash_array(np.array(lines, object), categorize=False).astype("int64"), 0)
            columns = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x)) for x in (hashes, count)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), *columns], ["doc_id", "version", "hashes", "words"])

    text = F.coalesce("text", F.lit(""))
    schema = StructType([docs.schema["doc_id"], StructField("version", LongType()), StructField("hashes", ArrayType(LongType())), StructField("words", ArrayType(IntegerType()))])
    return docs.select("doc_id", F.xxhash64(text).alias("version"), text.cast("binary").alias("text")).mapInArrow(rows, schema)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _spread(bounds: np.ndarray) -> np.ndarray:
    """The number of its document for each line, where document ``k`` has the lines from ``bounds[k]`` to ``bounds[k + 1]``."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def _shortest_runs(hashes: np.ndarray, words: np.ndarray, bounds: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the shortest runs of at least ``min_words`` words from each line that is not blank, to the right and to the left, inside its document."""
    sums, full, doc = np.concatenate([[0], np.cumsum(words, dtype="int64")]), np.flatnonzero(hashes), _spread(bounds)
    ends = np.searchsorted(sums, sums[full] + min_words)
    right = ends <= bounds[1:][doc[full]]
    starts = np.searchsorted(sums, sums[full + 1] - min_words, "right") - 1
    left = starts >= bounds[:-1][doc[full]]
    return np.concatenate([full[right], starts[left]]), np.concatenate([ends[right], full[left] + 1])


def _span_hashes(hashes: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of runs of lines; equal lines in equal order have equal hashes wherever they stand."""
    h = np.asarray(hashes, "int64").astype("uint64")
    powers, back = (np.cumprod(np.concatenate([np.ones(1, "uint64"), np.full(max(len(h) - 1, 0), x, "uint64")]))[: len(h)] for x in (_BASE, _INVERSE))
    upto = np.concatenate([np.zeros(1, "uint64"), np.cumsum(h * powers)])
    run = (upto[e] - upto[s]) * back[s] + (e - s).astype("uint64") * np.uint64(_BASE)
    return ((run ^ (run >> np.uint64(29))) * np.uint64(_INVERSE)).astype("int64")


def _held_runs(hashes: np.ndarray, words: np.ndarray, bounds: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and hashes of runs of two and more lines with at least ``min_words`` words: the shortest from each line, runs of 2, 4, 8 ... lines, and whole documents."""
    sums, starts = np.concatenate([[0], np.cumsum(words, dtype="int64")]), np.flatnonzero(hashes)
    doc = _spread(bounds)
    last = bounds[1:][doc[starts]]
    pairs = [_shortest_runs(hashes, words, bounds, min_words)]
    size, most = 2, int(np.diff(bounds).max(initial=0))
    while size <= most:
        at = starts[starts + size <= last]
        pairs.append((at, at + size))
        size *= 2
    pairs.append((bounds[:-1], bounds[1:]))
    s, e = (np.concatenate(x) for x in zip(*pairs, strict=True))
    some = (sums[e] - sums[s] >= min_words) & (e > s + 1)
    s, e = s[some], e[some]
    return doc[s], _span_hashes(hashes, s, e)


def _run_hashes(hashes: np.ndarray, words: np.ndarray, min_words: int) -> np.ndarray:
    """Hashes of the runs of one document; see :func:`_held_runs`."""
    return np.unique(_held_runs(np.asarray(hashes, "int64"), words, np.array([0, len(hashes)]), min_words)[1])


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows' lists, and where each row's begin and end."""
    bounds = lists.offsets.to_numpy(zero_copy_only=False).astype("int64")
    return lists.flatten().to_numpy(zero_copy_only=False), bounds - bounds[0]


def _rows_of(batch: pa.RecordBatch, at: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    """``doc_id, version, h``: hashes with the keys of the rows ``at`` that have them, each once for a row."""
    order = np.lexsort((h, at))
    at, h = at[order], h[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (h[1:] != h[:-1])
    rows = pa.array(at[new], pa.int64())
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in KEY), pa.array(h[new], pa.int64())], [*KEY, "h"])


def _key_schema(table: DataFrame) -> StructType:
    return StructType([table.schema["doc_id"], table.schema["version"], StructField("h", LongType())])


def _runs_of(table: DataFrame, min_words: int, line_words: int) -> DataFrame:
    """``doc_id, version, h`` of lines with at least ``line_words`` words and of runs (:func:`_held_runs`); each once for a document."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        for batch in batches:
            (hashes, bounds), (words, _) = _flat(batch.column("hashes")), _flat(batch.column("words"))
            long = np.flatnonzero(words >= line_words)
            doc, h = _held_runs(hashes, words, bounds, min_words)
            yield _rows_of(batch, np.concatenate([_spread(bounds)[long], doc]), np.concatenate([hashes[long], h]))

    return table.select(*KEY, "hashes", "words").mapInArrow(runs, _key_schema(table))


def _counts(hashes: np.ndarray, words: np.ndarray, s: int, e: int, min_words: int, frequent: frozenset[int], share: float) -> bool:
    """Whether a block of lines is an overlap: enough words, and not just one line that is frequent, unless it has ``share`` of the document's words."""
    inner = np.flatnonzero(words[s:e]) + s
    return words[s:e].sum() >= min_words and (len(inner) > 1 or int(hashes[inner[0]]) not in frequent or words[inner[0]] >= share * words.sum())


def common_lines(early: np.ndarray, late: np.ndarray, words: np.ndarray, min_words: int, frequent: frozenset[int] = frozenset(), share: float = 0.5) -> list[int]:
    """Numbers of the lines of ``late`` in aligned blocks of at least ``min_words`` words; see :func:`_counts`."""
    gone = [k for s, e in aligned_blocks(early.tolist(), late.tolist()) if _counts(late, words, s, e, min_words, frequent, share) for k in range(s, e)]
    return [k for k in gone if late[k] != 0]


def open_runs(
    hashes: np.ndarray, words: np.ndarray, bounds: np.ndarray, drop: tuple[np.ndarray, np.ndarray], shared: tuple[np.ndarray, np.ndarray], min_words: int, frequent: frozenset[int], share: float
) -> tuple[np.ndarray, np.ndarray]:
    """Documents and hashes of the shortest runs of enough words that are ``shared`` and hold a line that is not in ``drop`` (each: values, and where a document's begin and end)."""
    kept = hashes != 0
    kept[drop[0] + bounds[:-1][_spread(drop[1])]] = False
    s, e = _shortest_runs(hashes, words, bounds, min_words)
    left = np.concatenate([[0], np.cumsum(kept)])
    some = left[e] > left[s]
    s, e = s[some], e[some]
    key, doc, known = np.where(e == s + 1, hashes[s], _span_hashes(hashes, s, e)), _spread(bounds)[s], np.unique(shared[0])
    if not len(known):
        return doc[:0], key[:0]
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    some = (known[at] == key) & np.isin(doc * len(known) + at, _spread(shared[1]) * len(known) + np.searchsorted(known, shared[0]))
    s, e, key, doc = s[some], e[some], key[some], doc[some]
    own = [slice(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    some = np.array([_counts(hashes[own[d]], words[own[d]], a - own[d].start, b - own[d].start, min_words, frequent, share) for d, a, b in zip(doc.tolist(), s.tolist(), e.tolist(), strict=True)], bool)
    return doc[some], key[some]


def _written(df: DataFrame, tag: str) -> DataFrame:
    """:func:`materialize`; where Spark joins small parts of shuffles by itself, they are not dealt anew."""
    return materialize(df, tag, deal=df.sparkSession.conf.get("spark.sql.adaptive.coalescePartitions.enabled") != "true")


def _ranked(held: DataFrame) -> DataFrame:
    """``h, doc_id, version, rank``: a written table of a line's or run's holders, numbered from 1 by id. Sorted by ranges, so that no task gets all holders of one."""
    order = ["h", *KEY]
    ranged = _written(held.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("h", "part").agg(F.count("*").alias("n"))  # a row for each run and partition that has it
    before = F.coalesce(F.sum("n").over(Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = ranged.withColumn("k", F.row_number().over(Window.partitionBy("h", "part").orderBy(*KEY)))
    out = _written(local.join(parts.select("h", "part", before.alias("before")), ["h", "part"]).select(*order, (F.col("before") + F.col("k")).alias("rank")), "ranked")
    release(ranged)
    return out


def repeated_lines(docs: DataFrame, min_words: int = 8, line_words: int = 4, rare: int = 50, share: float = 0.5, most: float = 0.5) -> DataFrame:
    """``doc_id, version, drop``: numbers of the lines that an earlier document has in an aligned block of at least ``min_words`` words.

    Lines of at least ``line_words`` words and runs of lines make candidates; see above for how few pairs stand for all. A frequent line alone is no overlap: a block of
    one line does not count where more than ``rare`` documents and more than ``most`` of all documents hold the line, unless it has at least ``share`` of the later document's words.

    ``version`` is a hash of the text. Null and empty texts have no lines; null ids take no part; rows that share an id are not compared with each other; of repeated rows each holds once.
    No documents, no rows. A text is held as a hash and a count for each of its lines.
    """
    short_batches(docs, BATCH)
    table = materialize(lines_of(docs.where("doc_id is not null")), "lines")
    total = table.select(*KEY).distinct().count()
    if total < table.count():
        table, rows = materialize(table.dropDuplicates(KEY), "lines"), table
        release(rows)
    held = materialize(_runs_of(table, min_words, line_words), "held", deal=False)  # no shuffle: as many files as lines
    # of rows that share the smallest id any may come first; all other holders are tried where it does not do. Numbers alone need no sort
    first = held.groupBy("h").agg(F.min("doc_id").alias("early"), F.min_by("version", "doc_id").alias("early_version"), F.max("doc_id").alias("last"), F.count("*").alias("df"))
    first = _written(first.where("df > 1 and early < last"), "first")  # written, so that a join can split a frequent line's holders
    # more than `most` of all documents hold each of these: at most 1 / most times the lines that a document has on average
    frequent = frozenset(r.h for r in first.where((F.col("df") > rare) & (F.col("df") > most * total)).select("h").collect())
    pair = [*KEY, "early", "early_version"]
    met = _written(held.join(first.select("h", "early", "early_version").hint("shuffle_hash"), "h").where("doc_id <> early").select(*pair, "h"), "met")

    def common(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        drop_worker_caches()
        for batch in rows:
            yield pd.Series([common_lines(*(np.asarray(x) for x in row), min_words, frequent, share) for row in zip(*batch, strict=True)])

    # Not deterministic to the planner, so that a filter on the result does not run it twice, in two workers.
    dropped = F.pandas_udf(common, "array<int>").asNondeterministic()

    def still_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (hashes, bounds), (words, _), drop, shared = (_flat(batch.column(c)) for c in ("hashes", "words", "drop", "shared"))
            yield _rows_of(batch, *open_runs(hashes, words, bounds, drop, shared, min_words, frequent, share))

    def aligned(pairs: DataFrame, lines: DataFrame) -> DataFrame:
        other = lines.select(F.col("doc_id").alias("early"), F.col("version").alias("early_version"), F.col("hashes").alias("early_hashes"))
        found = pairs.join(lines, KEY).join(other, pair[2:]).select(*KEY, dropped("early_hashes", "hashes", "words").alias("d"))
        return _written(found.where("size(d) > 0"), "aligned")

    def together(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts).groupBy(*KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("d")))).alias("drop"))

    def left_open(shared: DataFrame, lines: DataFrame, gone: DataFrame) -> DataFrame:
        state = shared.groupBy(*KEY).agg(F.collect_set("h").alias("shared")).join(lines, KEY).join(gone, KEY, "left")
        drop = F.coalesce("drop", F.array().cast("array<int>")).alias("drop")
        return state.select(*KEY, "hashes", "words", drop, "shared").mapInArrow(still_open, _key_schema(table))

    parts = [aligned(met.select(*pair).distinct(), table)]
    open_ = _written(left_open(met, table, together(parts)), "open")
    if not open_.isEmpty():
        ranked = _ranked(held.join(open_.select("h").distinct(), "h", "left_semi"))
        # from here on only the open runs' holders and what the documents with open runs have lost are read
        near = _written(table.join(ranked.select(*KEY).distinct(), KEY, "left_semi"), "near")
        lost = _written(parts[0].join(open_.select(*KEY).distinct(), KEY, "left_semi"), "lost")
        there = ranked.select("h", "rank", F.col("doc_id").alias("early"), F.col("version").alias("early_version"))
        reach = 1
        mine = _written(open_.join(ranked, ["h", *KEY]).where(F.col("rank") > reach), "mine")
        while not mine.isEmpty():
            steps = F.sequence(F.greatest(F.lit(1), F.col("rank") - 2 * reach + 1), F.col("rank") - reach)
            pairs = mine.select("h", *KEY, F.explode(steps).alias("rank")).join(there, ["h", "rank"]).where("early < doc_id").select(*pair).distinct()
            parts.append(aligned(pairs, near))
            reach *= 2
            old, more = mine, mine.where(F.col("rank") > reach)  # others have no holder left
            mine = _written(left_open(more, near, together([lost, *parts[1:]])).join(more, ["h", *KEY]), "mine")
            release(old)
        release(ranked, near, lost, mine)
    out = _written(together(parts), "drop")
    release(table, held, first, met, open_, *parts)
    return out


def dedup_lines(docs: DataFrame, **options: float) -> DataFrame:
    """The documents with repeated lines deleted, plus ``n_lines, n_dropped``.

    All columns are kept; ``text`` has the lines that stay. A null or empty text is left as it is and has no lines to repeat; a null ``doc_id`` takes no part and stays whole. Repeated rows
    lose the same lines; rows that share an id and differ in text lose each what documents of smaller ids hold. Equal lines within one document are not compared. Texts of any length are
    compared whole. An empty table stays empty.
    """
    gone = repeated_lines(docs.select("doc_id", "text"), **options)
    cut = small(gone.select(F.col("doc_id").alias("doc_id__"), F.col("version").alias("version__"), F.col("drop").alias("drop__")))
    text = F.coalesce(docs["text"], F.lit(""))
    joined = docs.join(cut, (docs["doc_id"] == F.col("doc_id__")) & (F.xxhash64(text) == F.col("version__")), "left")
    kept = F.expr("array_join(filter(split(text, '\\n', -1), (x, k) -> not array_contains(drop__, k)), '\\n')")
    return joined.select(
        *(F.when(F.col("drop__").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else docs[c] for c in docs.columns),
        F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop__"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every document, by :func:`dedup_lines`."""
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
