"""Near-duplicates by MinHash: a multi-index Hamming join over b-bit signatures.

A document's set of word shingles gives a signature of ``chunks * width`` positions of 16 bits. Signatures
are split in chunks, and of each chunk every choice of ``errors`` positions is left out in turn; the rest is a key. Two signatures that differ
in fewer than ``chunks * (errors + 1)`` positions have, by the pigeonhole principle, a chunk with at most ``errors`` errors and so
share a key. (With the defaults: 23 of 72. At a similarity of 0.8 each chunk is met with probability 0.66, so a pair is missed with
probability 4e-6, whatever its distance.)

Equal sets are one class from the start. Within a key's bucket, members are first compared with one centre each (links of
near copies grow as their number, not its square), their components found and buckets that lie within one component
dropped; only then are pairs across components compared, filtered by size and by a sketch of the signature. Members compared with the same centre are compared in blocks
inside tasks, so a dense group of texts that are just not similar enough gives no table of its pairs. Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_worker_caches, materialize, read, release, short_batches, small
from .components import components
from .simhash import _FOLD, _INV, _P, _mix

GROUP = 1 << 20
PLANES = 4
SKETCH = [f"k{k}" for k in range(PLANES)]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _hashed(raw: bytes, shingle: int) -> np.ndarray:
    """Hashes of the shingles of a text, in order and with repeats; the whole sequence where it has fewer words."""
    b = _FOLD[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ~_SPACE[b], [False]])))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    n = len(b)
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _P, np.uint64)]))
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _INV, np.uint64)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up)])
    word = _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    k = min(shingle, len(word))
    out = np.full(len(word) - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        out = _mix(out * np.uint64(0x9FB21C651E98DF25) + word[j : len(word) - k + 1 + j])
    return out


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a whole text's shingles."""
    return np.unique(_hashed((text or "").encode("utf-8", "replace"), shingle))


class Signer:
    def __init__(self, chunks: int, width: int, errors: int) -> None:
        rng = np.random.default_rng(5)
        self.size = chunks * width
        self.mult = rng.integers(0, 1 << 63, self.size, np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, self.size, np.uint64)
        self.keys = [
            [c * width + p for p in range(width) if p not in left_out]
            for c in range(chunks)
            for left_out in combinations(range(width), errors)
        ]

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """Signatures of non-empty sets, sets x positions."""
        flat, at = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
        out = np.empty((len(sets), self.size), np.uint64)
        for k in range(self.size):
            h = flat * self.mult[k] + self.add[k]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out[:, k] = np.minimum.reduceat(h, at) >> np.uint64(24) & np.uint64(0xFFFF)
        return out

    def sketches(self, sig: np.ndarray) -> np.ndarray:
        """Low bits of the first 64 positions, one row of 64 bits for each of ``PLANES`` bits."""
        out = []
        for k in range(PLANES):
            bits = (sig[:, :64] >> np.uint64(k) & np.uint64(1)).astype(np.uint8)
            out.append(np.packbits(np.pad(bits, ((0, 0), (0, 64 - bits.shape[1]))), axis=1).view("<i8").ravel())
        return np.stack(out)

    def bucket_keys(self, sig: np.ndarray) -> np.ndarray:
        out = np.empty((len(sig), len(self.keys)), np.uint64)
        for j, used in enumerate(self.keys):
            h = np.full(len(sig), np.uint64(j + 1), np.uint64)
            for p in used:
                h = _mix(h * np.uint64(0x9FB21C651E98DF25) + sig[:, p])
            out[:, j] = h
        return out.view(np.int64)


def sign(docs: DataFrame, shingle: int, chunks: int, width: int, errors: int) -> DataFrame:
    """``doc_id, n`` (size of the set), ``d1, d2`` (digest of the set), ``k0..k3`` (sketch), ``keys`` per document."""
    names = ["doc_id", "n", "d1", "d2", *SKETCH, "keys"]

    def signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        signer = Signer(chunks, width, errors)

        def batch_of(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            full = [s for s in sets if len(s)]
            have = np.array([len(s) > 0 for s in sets], bool)
            digest, sketch = np.zeros((2, len(sets)), np.int64), np.zeros((PLANES, len(sets)), np.int64)
            values, ends = np.zeros(0, np.int64), np.cumsum(have) * len(signer.keys)
            if full:
                flat, at = np.concatenate(full), np.cumsum([0, *(len(s) for s in full[:-1])])
                digest[0, have] = np.add.reduceat(_mix(flat + np.uint64(1)), at).view(np.int64)
                digest[1, have] = np.add.reduceat(_mix(flat ^ _P), at).view(np.int64)
                sig = signer.signatures(full)
                sketch[:, have] = signer.sketches(sig)
                values = signer.bucket_keys(sig).ravel()
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[0]), pa.array(digest[1]), *map(pa.array, sketch), keys], names
            )

        for batch in batches:
            ids, sets, size = [], [], 0
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids.append(doc)
                sets.append(shingle_set(text, shingle))
                size += len(sets[-1])
                if size > GROUP >> 2 or len(sets) >= 4096:
                    yield batch_of(ids, sets)
                    ids, sets, size = [], [], 0
            if ids:
                yield batch_of(ids, sets)

    return short_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(signed, "doc_id long, n long, d1 long, d2 long, " + "".join(f"{k} long, " for k in SKETCH) + "keys array<long>")


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        for batch in batches:
            ids, texts = batch["id"].to_pylist(), batch["text"].to_pylist()
            for at in range(0, len(ids), 256):
                sets = [shingle_set(t, shingle).view(np.int64) for t in texts[at : at + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 256], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "set"])

    named = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(small(ids), "id", "left_semi")
    return named.mapInArrow(made, "id long, set array<long>")


def _confirmed(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of a written table of pairs ``a, b`` whose full sets have the similarity asked for, as a written table."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = materialize(_sets(docs, ids, shingle).dropDuplicates(["id"]), "sets")
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    found = pairs.join(left, "a").join(right, "b").where(100 * common >= percent * (F.size("sa") + F.size("sb") - common))
    links = materialize(found.select("a", "b"), "links")
    release(sets, ids)
    return links


BLOCK = 256  # members of a home that are compared with as many others in one task


def _compare(left: list[tuple], right: list[tuple], same: bool, percent: int, apart: int) -> list[tuple[int, int]]:
    """Links between two blocks of members (id, label, n, sketch, set), from a product of their incidence matrices."""
    ids, labels, n, *sketch = (np.array([m[k] for m in left]) for k in range(3 + PLANES))
    ids2, labels2, n2, *sketch2 = (np.array([m[k] for m in right]) for k in range(3 + PLANES))
    differ = np.bitwise_count(np.bitwise_or.reduce([a[:, None] ^ b[None] for a, b in zip(sketch, sketch2, strict=True)]).view(np.uint64))
    wanted = (labels[:, None] != labels2[None]) & (100 * np.minimum(n[:, None], n2[None]) >= percent * np.maximum(n[:, None], n2[None])) & (differ <= apart)
    if same:
        wanted &= ids[:, None] > ids2[None]
    if not wanted.any():
        return []
    flat = [np.concatenate([m[-1] for m in side]) for side in (left, right)]
    who = [np.repeat(np.arange(len(side)), [len(m[-1]) for m in side]) for side in (left, right)]
    both = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]))
    common = np.zeros(wanted.shape)
    for at in range(0, len(both), 8192):  # some columns at a time: bounded whatever the texts' length
        part, made = both[at : at + 8192], []
        for f, w, side in zip(flat, who, (left, right), strict=True):
            place = np.minimum(np.searchsorted(part, f), len(part) - 1)
            hit = part[place] == f
            m = np.zeros((len(side), len(part)), np.float32)
            m[w[hit], place[hit]] = 1
            made.append(m)
        common += made[0] @ made[1].T
    linked = wanted & (100 * common >= percent * (n[:, None] + n2[None] - common))
    return [(int(ids[i]), int(ids2[j])) for i, j in np.argwhere(linked)]


def _within_homes(docs: DataFrame, members: DataFrame, shingle: int, percent: int, apart: int) -> DataFrame:
    """Links between members of one home that are not yet in one component; ``members``: ``id, label, home, n`` and the sketch.

    The component of most members is compared with the others, and these among themselves, block by block. A task holds two blocks, whatever the home's size, and returns links only.
    """
    members = materialize(members, "members")
    sizes = members.groupBy("home", "label").agg(F.count("*").alias("c"))
    main = sizes.groupBy("home").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("total")).where("total > m.c")
    plan = main.select("home", F.col("m.label").alias("main"), F.ceil(F.col("m.c") / BLOCK).cast("int").alias("nm"), F.ceil((F.col("total") - F.col("m.c")) / BLOCK).cast("int").alias("ns"))
    placed = members.join(plan, "home").withColumn("h", F.xxhash64("id"))
    inside = F.expr("pmod(h, if(label = main, nm, ns))")
    placed = placed.withColumn("k", inside.cast("int"))
    task = """if(label = main, transform(sequence(0, ns - 1), j -> named_struct('x', k, 'y', ns + j, 'side', 0)),
        concat(transform(sequence(0, nm - 1), i -> named_struct('x', i, 'y', ns + k, 'side', 1)),
               transform(sequence(0, ns - 1), j -> named_struct('x', -1 - least(j, k), 'y', greatest(j, k), 'side', if(j = k, 2, if(k < j, 0, 1))))))"""
    ids = materialize(placed.select("id").distinct(), "ids")
    sets = _sets(docs, ids, shingle).dropDuplicates(["id"])
    rows = placed.join(sets, "id").select("home", "id", "label", "n", *SKETCH, "set", F.explode(F.expr(task)).alias("t"))
    rows = rows.select("home", F.col("t.x").alias("x"), F.col("t.y").alias("y"), F.col("t.side").alias("side"), "id", "label", "n", *SKETCH, "set")

    def run(group: pa.Table) -> pa.Table:
        sides: dict[int, list[tuple]] = {0: [], 1: [], 2: []}
        columns = [group[c].to_numpy() for c in ("side", "id", "label", "n", *SKETCH)]
        for k, (side, *facts) in enumerate(zip(*(c.tolist() for c in columns), strict=True)):
            sides[side].append((*facts, np.asarray(group["set"][k].values)))
        if sides[2]:
            found = _compare(sides[2], sides[2], True, percent, apart)
        elif sides[0] and sides[1]:
            found = _compare(sides[0], sides[1], False, percent, apart)
        else:
            found = []
        return pa.table({"a": pa.array([max(p) for p in found], pa.int64()), "b": pa.array([min(p) for p in found], pa.int64())})

    links = materialize(rows.groupBy("home", "x", "y").applyInArrow(run, "a long, b long"), "inner")
    release(members, ids)
    return links


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, chunks: int = 12, width: int = 6, errors: int = 1, stars: int = 2
) -> DataFrame:
    """Components of documents linked by ``100 * intersection >= percent * union`` of their shingle sets.

    A row per row of ``docs``: ``doc_id, n_shingles, component_id`` (smallest id reachable, itself included), ``kept`` (the id is
    its component's). Words are lower-cased (A-Z) runs without white space. A text with fewer than ``shingle`` words has its whole sequence as its one
    shingle; a null, empty or blank text has an empty set, which is linked with nothing. A null id is linked with nothing and kept.
    Rows sharing an id are one document. Empty tables give no rows.
    """
    docs = docs.select("doc_id", "text")
    signed = materialize(sign(docs, shingle, chunks, width, errors), "signed")
    real = signed.where("n > 0 and doc_id is not null")
    classes = materialize(
        real.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("id"), *(F.first(k).alias(k) for k in SKETCH), F.first("keys").alias("keys")), "classes"
    )
    rows = classes.select("id", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    rows = materialize(rows.join(shared, "key", "left_semi"), "buckets")
    facts = materialize(classes.select("id", "n", *SKETCH), "facts")
    # positions of the sketch that differ, at the threshold: five standard deviations above the mean are let through
    share = (100 - percent) / 100 * (1 - 0.5**PLANES)
    apart = min(64, ceil(64 * share + 5 * sqrt(64 * share * (1 - share))))
    near = f"100 * least(na, nb) >= {percent} * greatest(na, nb) and bit_count({' | '.join(f'(a{k} ^ b{k})' for k in SKETCH)}) <= {apart}"
    fa = facts.select(F.col("id").alias("a"), F.col("n").alias("na"), *(F.col(k).alias(f"a{k}") for k in SKETCH))
    fb = facts.select(F.col("id").alias("b"), F.col("n").alias("nb"), *(F.col(k).alias(f"b{k}") for k in SKETCH))

    labels = homes = None  # id, label of the classes linked so far; id, home: a centre each one was compared with
    for star in range(stars + 1):
        if labels is None:
            held = rows.select("key", "id", F.col("id").alias("label"))
        else:
            held = rows.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
            mixed = held.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
            held = materialize(held.join(mixed, "key", "left_semi"), "held")
        if star < stars:
            centre = held.groupBy("key").agg(F.min(F.struct("label", "id")).alias("c")).select("key", F.col("c.id").alias("b"), F.col("c.label").alias("to"))
            pairs = held.join(centre, "key").where("label <> to").select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()
            pairs = materialize(pairs.join(fa, "a").join(fb, "b").where(near).select("a", "b"), "pairs")
            links = _confirmed(docs, pairs, shingle, percent)
            if homes is None:
                nearest = pairs.groupBy("a").agg(F.min("b").alias("b"))
                above = nearest.select(F.col("a").alias("b"), F.col("b").alias("c"))
                homes = materialize(nearest.join(above, "b", "left").select(F.col("a").alias("id"), F.coalesce("c", "b").alias("home")), "homes")
            release(pairs)
        else:
            shared = held.groupBy("id").agg(F.collect_list("key").alias("keys"))  # a document has as many keys as the signer at most
            known = held.join(facts, "id").join(shared, "id").join(homes, "id", "left").withColumn("home", F.coalesce("home", "id"))
            one = known.select("key", *(F.col(c).alias(d) for c, d in (("id", "a"), ("label", "la"), ("n", "na"), ("home", "ha"), ("keys", "sa"))), *(F.col(k).alias(f"a{k}") for k in SKETCH))
            two = known.select("key", *(F.col(c).alias(d) for c, d in (("id", "b"), ("label", "lb"), ("n", "nb"), ("home", "hb"), ("keys", "sb"))), *(F.col(k).alias(f"b{k}") for k in SKETCH))
            first = "array_min(array_intersect(sa, sb)) = key"  # of the buckets that two documents share, one gives the pair
            apart_pairs = one.join(two, "key").where(f"a > b and la <> lb and ha <> hb and {near} and {first}").select("a", "b")
            apart_pairs = materialize(apart_pairs, "pairs")
            links = _confirmed(docs, apart_pairs, shingle, percent)
            inner = _within_homes(docs, known.select("id", "label", "home", "n", *SKETCH).distinct(), shingle, percent, apart)
            links = links.unionByName(inner)
            release(apart_pairs)
        if labels is not None:
            old = labels
            ends = links.join(old.select(F.col("id").alias("a"), F.col("label").alias("la")), "a", "left").join(
                old.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b", "left"
            )
            merged = components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
            moved = merged.select(F.col("id").alias("label"), F.col("label").alias("new"))
            again = old.join(moved, "label", "left").select("id", F.coalesce("new", "label").alias("label"))
            fresh = merged.join(old, "id", "left_anti")
            labels = materialize(again.unionByName(fresh), "labels")
            release(held, old)
        else:
            labels = materialize(components(links), "labels")
        release(links)

    classed = classes.join(labels, "id", "left").select("n", "d1", "d2", F.coalesce("label", "id").alias("component"))
    out = signed.select("doc_id", "n", "d1", "d2").join(classed, ["n", "d1", "d2"], "left")
    own = F.coalesce(F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component")), F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=2)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
      ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
df AS (SELECT g, count(*) AS df FROM s GROUP BY g),
r AS (
  SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY df.df, s.g) AS k FROM s JOIN n USING (doc_id) JOIN df USING (g)
), p AS (SELECT * FROM r WHERE k <= n - ceil(n * 0.8) + 1),
c AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) * 10 >= greatest(a.n, b.n) * 8
), l AS (
  SELECT c.a, c.b FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.g = x.g
  GROUP BY c.a, c.b, c.na, c.nb HAVING 100 * count(*) >= 80 * (c.na + c.nb - count(*))
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS lo FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.lo, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(m.lo, w.doc_id)) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN m ON w.doc_id = m.a
"""
