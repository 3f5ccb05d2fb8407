"""Each operator against a brute-force version on small tables with nulls, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import chat, decontam, langid, licenses, linededup, minhash, packing, pii, quality, simhash
from palimpsest.llm.components import components

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.01"
WORDS = [a + b + c for a in "bdfgkl" for b in "aeiou" for c in ("n", "rt", "st", "")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_of(spark, rows):
    """A documents table with extra columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"h": F.lit(1), "key": F.lit("k"), "pos": F.lit(2), "d": F.lit(3), "n": F.lit(4), "label": F.lit("x")}).repartition(3)


# ---- decontamination ----


def words8(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_decontam(docs, items):
    out = []
    for doc, text in docs:
        w, hit, found = words8(text), set(), set()
        for item, it in items:
            iw = words8(it)
            k = min(8, len(iw))
            grams = {tuple(iw[a : a + k]) for a in range(len(iw) - k + 1)} if k else set()
            for a in range(len(w) - k + 1):
                if k and tuple(w[a : a + k]) in grams:
                    hit |= set(range(a, a + k))
                    found.add(str(item))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=repr)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(1)
    items = [(k, sentence(rng, 20)) for k in range(12)] + [(12, None), (13, " !! "), (14, "Short item here"), (15, "the"), (2, "again " + sentence(rng, 9)), (20, "the the the the the the the the the")]
    items += [(30, items[0][1]), (31, items[0][1])]
    docs = [(k, sentence(rng, 30)) for k in range(40)] + [(50, None), (51, ""), (52, "the " * 12), (None, items[3][1])]
    docs += [(60 + k, "Éa " + sentence(rng, 5) + ", " + items[k % 12][1].upper() + "! x") for k in range(20)]
    docs += [(90, " ".join(words8(items[1][1])[5:13]) + " " + items[4][1] + " short ITEM-here"), (91, " ".join(words8(items[1][1])[5:12]))]
    got = decontam.decontaminate(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    mine = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()), key=repr)
    assert mine == brute_decontam(docs, items)


def test_decontamination_proximity_and_repeated_rows(spark):
    item = sentence(random.Random(4), 16)
    w = item.split()
    docs = [(1, " ".join(w[:9] + ["zzz"] + w[9:])), (1, " ".join(w[:9] + ["zzz"] + w[9:])), (2, "nothing here")]
    got = decontam.decontaminate(docs_of(spark, docs), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_items, r.n_near) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 0, 0)]


def test_proximity_equals_brute_force(spark):
    rng = random.Random(3)
    items = [(k, sentence(rng, 8 if k < 6 else 25)) for k in range(10)] + [(20, "the"), (21, None), (None, sentence(rng, 12))]
    docs = []
    for k, (_, it) in enumerate(items[:10]):
        w = it.split()
        swapped, inserted, replaced = list(w), [*w[:4], "zzz", *w[4:]], list(w)
        swapped[1], swapped[6] = w[6], w[1]
        for edit in range(8):
            one = list(w)
            one[edit] = "qqq"
            docs.append((100 * k + edit, f"{sentence(rng, 20)} {' '.join(one)} {sentence(rng, 20)}"))
        replaced[2] = replaced[5] = "qqq"
        halves = [*w[: len(w) // 2], *["far"] * rng.randrange(12), *w[len(w) // 2 :]]
        docs += [(100 * k + 20 + n, f"{sentence(rng, 9)} {' '.join(x)}") for n, x in enumerate((swapped, inserted, replaced, halves, rng.sample(w, len(w))))]
    docs += [(5000, None), (5001, "the end"), (None, items[-1][1])]
    got = decontam.decontaminate(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    want = {}
    for doc, text in docs:
        w, want[doc] = words8(text), 0
        for _, it in items:
            own = set(words8(it))
            span = len(words8(it)) + 8
            want[doc] += bool(own) and any(10 * len(own & set(w[a : a + span])) >= 8 * len(own) for a in range(len(w)))
    assert {r.doc_id: r.n_near for r in got.collect()} == want
    assert all(want[100 * k + e] >= 1 for k in range(10) for e in [*range(8), 20, 21, 24])


# ---- fingerprints ----


def test_simhash_edits_and_order(spark):
    rng = random.Random(2)
    docs = [(k * 3, sentence(rng, rng.randrange(1, 60))) for k in range(50)] + [(1, None), (2, ""), (4, "!!!"), (7, "Same text"), (8, "Same text"), (10, "é" * 11)]
    got = {r.doc_id: r for r in simhash.with_next(docs_of(spark, docs)).collect()}
    order = sorted(docs)
    for (k, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        t, following = t or "", following or ""
        want = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(want.encode()).hexdigest())
        assert r.edited_fingerprint == simhash.fingerprints([want])[0].tobytes().hex() and 0 <= r.near_edited <= 1
    assert got[7].fingerprint == got[8].fingerprint and simhash.with_next(docs_of(spark, docs[:1])).count() == 1
    long = [r for r in got.values() if r.n_chars > 100]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.9


def brute_fingerprint(text):
    """SimHash, a bit and a term at a time."""
    mask = (1 << 64) - 1

    def mix(h):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & mask
        return h ^ (h >> 31)

    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    words = re.findall(rb"[0-9a-z\x80-\xff]+", raw) or ([raw] if raw else [])
    hashes = [mix(sum((c + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(w)) & mask) for w in words]
    heavy = [min(len(w), 9) for w in words]
    terms = [(7 * 3 + hashes[0] * 0x9E3779B97F4A7C15, 2 * heavy[0]), (hashes[-1] * 3 + 11, 2 * heavy[-1])] if words else []
    terms += [(a * 3 + b * 0x9E3779B97F4A7C15, x * y) for a, b, x, y in zip(hashes, hashes[1:], heavy, heavy[1:], strict=False)]
    bits = []
    for k in range(4):
        mixed = [(mix((t + (k + 1) * 0x632BE59BD9B4E019) & mask), w) for t, w in terms]
        bits += [sum(w if h >> (8 * (j // 8) + 7 - j % 8) & 1 else -w for h, w in mixed) > 0 for j in range(64)]
    return np.packbits(bits).tobytes().hex()


def test_simhash_equals_brute_force(spark):
    rng = random.Random(20)
    docs = [(k, sentence(rng, rng.randrange(0, 40))) for k in range(30)] + [(40, "É à, b!"), (41, "?? !"), (42, None), (43, "Same"), (44, "same")]
    got = {r.doc_id: r for r in simhash.with_next(docs_of(spark, docs)).collect()}
    marks = {k: brute_fingerprint(t or "") for k, t in docs}
    assert {k: r.fingerprint for k, r in got.items()} == marks
    equal = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 256
    for (k, t), (n, following) in zip(docs, docs[1:] + docs[:1], strict=True):
        t, following = t or "", following or ""
        new = brute_fingerprint(t[: len(t) - len(t) // 2] + following[: len(t) // 2])
        assert (got[k].near_next, got[k].edited_fingerprint, got[k].near_edited) == (equal(marks[k], marks[n]), new, equal(marks[k], new))


def test_simhash_of_very_long_texts_is_that_of_the_whole(monkeypatch):
    rng = random.Random(21)
    monkeypatch.setattr(simhash, "GROUP", 50)
    for text in [sentence(rng, 300), "a" * 500, "a" * 120 + " b" * 300, "?" * 430, "é, " * 200, sentence(rng, 60) + "!" * 200, "x" + " " * 700 + "y"]:
        assert (simhash._long(text) == simhash._votes([text])).all()


def test_simhash_search_finds_all_within_radius(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (40, simhash.BITS // 8), dtype=np.uint8)
    near = base.copy()
    for k, row in enumerate(near):
        for bit in rng.choice(simhash.BITS, k % 12, replace=False):
            row[bit // 8] ^= 1 << (bit % 8)
    marks = [m.tobytes().hex() for m in np.concatenate([base, near, base[:3]])]
    df = spark.createDataFrame([(m,) for m in marks], "fingerprint string")
    got = {(r.fingerprint, r.other, r.distance) for r in simhash.near_fingerprints(df, df.limit(40)).collect()}
    dist = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    assert got == {(a, b, dist(a, b)) for a in set(marks[:40]) for b in set(marks) if a != b and dist(a, b) <= 8}
    counts = {r.fingerprint: r.n_near for r in simhash.near_counts(df, df.limit(40)).collect()}
    assert counts == {a: sum(dist(a, b) <= 8 for b in marks) - 1 for a in set(marks[:40])}


# ---- packing ----


def test_packing_is_an_exact_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(5)
    docs = [(k, sentence(rng, rng.choice([3, 200, 900, 6000]))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "Don't ΣΑΣ İ <|endoftext|> we'll é é 12\x1cx​"), (None, "no id"), (5, "twice"), (103, "x " * 30000)]
    rows = packing.pack(docs_of(spark, docs), path).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    by = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or at & (at - 1) == 0
    want = Counter((k, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for k, t in docs if k != 5)
    pieces = {}
    for r in sorted((r for r in rows if r.doc_id != 5), key=lambda r: r.start):
        pieces.setdefault(r.doc_id, []).append(r)
    assert Counter((k, b"".join(bytes(r.ids) for r in p)) for k, p in pieces.items()) == want
    assert all(sum(r.length for r in p) == p[0].doc_tokens for p in pieces.values())


def test_fast_merges_give_the_tokenizers_ids():
    tok, rng = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), keep=5000), random.Random(22)
    words = [w.removesuffix("</w>") for w in tok.tok.get_vocab() if w.isascii()]
    odd = ["".join(rng.choice("ab'sdté中1٣ -_.…😀́ﬁẞǅ\t\n") for _ in range(rng.randrange(30))) for _ in range(3000)]
    odd += ["".join(rng.sample(words, 2)) + rng.choice("aeiou.!5") * rng.randrange(3) for _ in range(5000)] + ["x" * 3000, "ab" * 400]
    for text in words + odd:
        assert tok.ids_of(text).tolist() == tok.tok.encode(text, add_special_tokens=False).ids
    assert len(tok) <= 5000


def test_best_fill_is_optimal():
    rng = random.Random(6)
    for _ in range(200):
        sizes = [rng.randrange(1, 15) for _ in range(rng.randrange(9))]
        room = rng.randrange(0, 40)
        take = packing.best_fill(Counter(sizes), room)
        assert all(take[s] <= Counter(sizes)[s] for s in take)
        assert sum(s * n for s, n in take.items()) == max(sum(c) for k in range(len(sizes) + 1) for c in combinations(sizes, k) if sum(c) <= room)


# ---- licences ----


def test_licences_by_line_file_and_directory(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    rows = [("a/LICENSE", mit), ("a/x.py", "plain text"), ("a/b/y.py", None), ("a/b/z.py", "words\n" + gpl + ".\nmore"), ("a/b/c/COPYING.txt", gpl), ("a/b/c/q.py", ""), ("r.py", "no licence"), (None, "nothing"), ("a/x.py", "plain text"), ("aa/x.py", "other")]
    df = spark.createDataFrame(rows, "path string, text string").withColumns({"licence_": F.lit(1), "doc_id": F.lit(2), "term": F.lit(3)})
    got = Counter((r.path, r.licence, r.found, r.origin) for r in licenses.scan(df).collect())
    assert got == Counter([("a/LICENSE", "MIT", "file", None), ("a/x.py", "MIT", "inherited", "a"), ("a/x.py", "MIT", "inherited", "a"), ("a/b/y.py", "MIT", "inherited", "a"), ("a/b/z.py", "GPL-3.0", "header", None),
                           ("a/b/c/COPYING.txt", "GPL-3.0", "file", None), ("a/b/c/q.py", "GPL-3.0", "inherited", "a/b/c"), ("r.py", None, "none", None), (None, None, "none", None), ("aa/x.py", None, "none", None)])


def test_real_licence_files_pass_their_licence_on(spark):
    texts = licenses.full_texts()
    wrap = lambda t: "\n".join(f"  {x}  " for x in t.split("\n"))
    rows = [(f"{n}/LICENSE", wrap(t).replace("<year>", "2019").replace("<copyright holders>", "A. N. Author")) for n, t in texts.items()]
    rows += [(f"{n}/sub/x.py", "print(1)") for n in texts]
    heads = {"MIT": "MIT License\n\nCopyright 2020 Somebody", "GPL-3.0": "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nof our project", "GPL-2.0": "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991",
             "Apache-2.0": "   Apache License\n   Version 2.0, January 2004\n  http://www.apache.org/licenses/", "MPL-2.0": "Mozilla Public License Version 2.0\n====", "CC-BY-4.0": "Attribution 4.0 International"}
    rows += [(f"t/{n}/LICENSE", t) for n, t in heads.items()] + [("n/LICENSE", "All rights reserved by the owner"), ("e/LICENSE", ""), ("f/LICENSE", None)]
    got = {r.path: (r.licence, r.found) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    want = {f"{n}/LICENSE": n for n in texts} | {f"{n}/sub/x.py": n for n in texts} | {f"t/{n}/LICENSE": n for n in heads} | {f"{x}/LICENSE": None for x in "nef"}
    assert {p: n for p, (n, _) in got.items()} == want
    assert {p: f for p, (_, f) in got.items() if p.endswith("x.py")} == {f"{n}/sub/x.py": "inherited" for n in texts}


def test_licence_scores_equal_brute_force(spark):
    rng = random.Random(7)
    lines = [" ".join(rng.sample(licenses.terms(t) + ["some", "other", "words"], rng.randrange(3, 8))) for t in licenses.TEMPLATES.values() for _ in range(12)]
    rows = [(f"f{k}", line) for k, line in enumerate(lines)]
    df = Counter(t for _, line in rows for t in set(licenses.terms(line)))
    known = {t for text in licenses.TEMPLATES.values() for t in licenses.terms(text)}
    weigh = lambda text: {t: c * (math.log((1 + len(rows)) / (1 + (df[t] if t in known else 0))) + 1) for t, c in Counter(licenses.terms(text)).items()}
    want = {}
    for path, line in rows:
        a = weigh(line)
        best = (0.0, "")
        for name, text in sorted(licenses.TEMPLATES.items()):
            b = weigh(text)
            c = sum(a[t] * b[t] for t in a if t in b) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
            if round(c, 6) > best[0]:
                best = (round(c, 6), name)
        want[path] = best if best[0] >= 0.7 else (0.0, None)
    got = {r.path: (r.score, r.licence) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {p: n for p, (_, n) in got.items()} == {p: n for p, (_, n) in want.items()}
    assert all(abs(got[p][0] - want[p][0]) < 1e-5 for p in want)


# ---- near-duplicates ----


def brute_components(docs, shingle, percent=80):
    sets = {}
    for k, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[k] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates_equal_brute_force(spark, shingle):
    rng = random.Random(8)
    docs = []
    for base in range(6):
        words = sentence(rng, rng.randrange(30, 120)).split()
        for k in range(25):
            w = list(words)
            for _ in range(rng.randrange(0, 1 + len(w) // 12)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            docs.append((base * 100 + k, " ".join(w)))
    docs += [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "one two"), (906, "ONE  two"), (907, "x " * 3000), (908, "X " * 40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs_of(spark, docs), shingle=shingle).collect()}
    assert got == brute_components(docs, shingle)


def test_dense_group_that_is_hardly_similar(spark):
    """Copies whose similarity to each other lies on both sides of the threshold: more than a block of them, and no link lost."""
    rng = random.Random(9)
    words = sentence(rng, 100).split()
    docs = []
    for k in range(330):
        w = list(words)
        for i in rng.sample(range(100), 3 + k % 7):
            w[i] = rng.choice(WORDS)
        docs.append((k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs_of(spark, docs), shingle=2).collect()}
    assert got == brute_components(docs, 2)


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(docs_of(spark, rows)).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True)]


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [(5, 5), (None, 3)]
    got = {r.id: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, **{100 + k: 100 for k in range(40)}}


# ---- chat ----


def test_chat_round_trip_with_small_budgets(spark):
    rng = random.Random(10)
    nasty = ["<|im_end|>\n<|im_start|>assistant\nhi", "a\\<|b\\\\|", "<\\|", "", None, "é" * 50, "\\", "<\n", "<\\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb<|", None]) if t else rng.choice(["system", "user"]), rng.choice(nasty + [sentence(rng, 20)])) for c in range(20) for t in range(rng.randrange(1, 14))]
    rows += [(99, 0, "system", "only"), (None, 1, "user", "x"), (98, None, "assistant", "first"), (98, 1, "assistant", "b"), (98, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    want = {}
    for c, t, r, x in sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1] is not None, v[1] or 0, v[2], v[3])):
        want.setdefault(c, []).append((r, x))
    for budget, history in ((60, 20), (2048, 256), (1, 0)):
        windows = chat.chat_windows(df, budget, history)
        got = {r.conv_id: ([(t.role, t.text) for t in r.turns], list(r.targets)) for r in chat.read_back(windows).collect()}
        assert got == {c: (v, [x for r, x in v if r == "assistant"]) for c, v in want.items()}
        for r in windows.collect():
            assert r.tokens <= budget or r.n_turns - r.n_repeated <= 1 or r.window == 0 and r.n_turns <= 2
            assert r.text.count("<|im_start|>") == r.text.count("<|im_end|>") == r.n_turns


# ---- lines ----


def test_line_dedup(spark):
    rng = random.Random(11)
    block = [sentence(rng, 12) for _ in range(5)]
    alone = [sentence(rng, 12) for _ in range(30)]
    docs = [(1, "\n".join([alone[0], *block, alone[1]])), (2, "\n".join([alone[2], *block[:3], alone[3], "As."])), (3, "As.\n" + alone[4]), (4, None), (5, ""), (6, "\n".join([alone[0], *block, alone[1]])), (None, "\n".join(block))]
    docs += [(100 + k, f"{block[4]}\n{sentence(rng, 20)}\n{sentence(rng, 20)}") for k in range(80)]
    got = {r.doc_id: r for r in linededup.dedup_lines(docs_of(spark, docs)).collect()}
    assert got[1].n_dropped == 0 and got[2].text == "\n".join([alone[2], alone[3], "As."]) and got[3].n_dropped == 0
    assert got[4].text is None and got[5].text == "" and got[6].text == "" and got[6].n_dropped == 7 and got[None].n_dropped == 0
    assert all(got[100 + k].n_dropped == 0 for k in range(80))  # a frequent line alone is no overlap


def test_line_dedup_of_passages_that_many_documents_hold(spark):
    rng = random.Random(13)
    passage, line = [sentence(rng, 30) for _ in range(2)], sentence(rng, 9)
    own = lambda: "\n".join(sentence(rng, 40) for _ in range(4))
    docs = [(k, "\n".join([own(), *passage, own()])) for k in range(70)] + [(100 + k, f"{own()}\n{line}\n{own()}") for k in range(60)]
    got = {r.doc_id: r.n_dropped for r in linededup.dedup_lines(docs_of(spark, docs)).collect()}
    assert got == {k: 2 * (k > 0) for k in range(70)} | {100 + k: int(k > 0) for k in range(60)}


def test_run_hashes_do_not_depend_on_the_place():
    rng = np.random.default_rng(15)
    h = rng.integers(-(2**63), 2**63 - 1, 300)
    full = linededup._run_hashes(h, np.full(300, 5), 8)
    assert len(full) == 299 + 297 + 293 + 285 + 269 + 237 + 173 + 45 + 1
    for s in range(0, 290, 7):
        assert set(linededup._run_hashes(h[s : s + 8], np.full(8, 5), 8)) <= set(full)
        assert not set(linededup._run_hashes(h[s : s + 8][::-1], np.full(8, 5), 8)) & set(full)


def test_line_dedup_finds_copies_and_blocks_behind_other_holders(spark):
    rng = random.Random(14)
    x, y, a, b, z = (sentence(rng, n) for n in (12, 12, 5, 5, 60))
    own = lambda: sentence(rng, 40)
    docs = [(1, f"{x}\n{y}"), (2, f"{y}\n{x}"), (3, f"{y}\n{x}"), (11, f"{a}\n{own()}"), (12, f"{b}\n{own()}"), (13, f"{own()}\n{a}\n{b}"), (14, f"{own()}\n{a}\n{b}\n{own()}")]
    short = ["un do", "tri kat", "pen", "sis sep ok non"]
    docs += [(21, "\n".join([own(), *short, own()])), (22, "\n".join([z, *short]))]
    got = {r.doc_id: r for r in linededup.dedup_lines(docs_of(spark, docs)).collect()}
    assert got[2].n_dropped == 1 and got[3].n_dropped == 2 and got[13].n_dropped == 0 and got[14].n_dropped == 2
    assert got[21].n_dropped == 0 and got[22].text == z


def brute_lines(docs, min_words=8):
    """Lines that go when every document is aligned with every earlier one."""
    lines = {k: [x.strip(" \t\r") for x in (t or "").split("\n")] for k, t in docs}
    size = lambda x: len(re.split(r"\s+", x)) if x else 0
    held = Counter(x for v in lines.values() for x in set(v))
    number = {x: n for n, x in enumerate(sorted(held), 1)}
    number[""] = 0
    out = {}
    for k, late in lines.items():
        gone = set()
        for early in (v for i, v in lines.items() if i < k):
            for s, e in linededup.aligned_blocks([number[x] for x in early], [number[x] for x in late]):
                inner = [x for x in late[s:e] if x]
                alone = len(inner) == 1 and held[inner[0]] > 50 and 2 * held[inner[0]] > len(lines) and 2 * size(inner[0]) < sum(map(size, late))
                if sum(map(size, inner)) >= min_words and not alone:
                    gone |= {x for x in range(s, e) if late[x]}
        out[k] = sorted(gone)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_the_alignment_of_all_pairs(spark, seed):
    """Few distinct lines in random orders, many of them repeated: blocks cross, and often no early holder aligns them."""
    rng = random.Random(seed)
    pool = [sentence(rng, rng.choice([2, 3, 5, 9, 14])) for _ in range(14)] + ["", " \t"]
    docs = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for k in range(70)]
    docs += [(100 + k, f"{pool[0]} {pool[1]} {pool[4]}\n{sentence(rng, 30)}") for k in range(100)]
    want = brute_lines(docs)
    got = {r.doc_id: list(r.drop) for r in linededup.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert {k: got.get(k, []) for k in want} == want and any(want.values())


def test_line_dedup_of_rows_that_share_an_id(spark):
    rng = random.Random(16)
    a, b, c = (sentence(rng, 12) for _ in range(3))
    rows = [(1, f"{a}\n{b}"), (5, f"{c}\n{a}\n{b}"), (5, f"{a}\n{c}"), (5, f"{a}\n{c}"), (6, f"{c}\n{c}")]
    got = sorted((r.doc_id, r.n_dropped, r.text) for r in linededup.dedup_lines(docs_of(spark, rows)).collect())
    assert got == sorted([(1, 0, f"{a}\n{b}"), (5, 2, c), (5, 1, c), (5, 1, c), (6, 2, "")])  # one c of 6 is aligned with each version of 5
    long = "\n".join(sentence(rng, 9) for _ in range(20000))
    kept = {r.doc_id: r.n_dropped for r in linededup.dedup_lines(docs_of(spark, [(1, long), (2, f"x\n{long}\ny")])).collect()}
    assert kept == {1: 0, 2: 20000}


def test_line_dedup_rounds_read_only_holders_of_open_runs(spark, monkeypatch):
    """Held runs are written without a shuffle, and rounds after the first do not read all lines again."""
    written, write = [], linededup.materialize

    def noted(df, tag, **options):
        written.append((tag, {re.split(r"-[0-9a-f]{32}/", x)[0].rsplit("/", 1)[-1] for x in df.inputFiles()}, options))
        return write(df, tag, **options)

    monkeypatch.setattr(linededup, "materialize", noted)
    rng = random.Random(17)
    x, y = (sentence(rng, 12) for _ in range(2))
    docs = [(1, f"{x}\n{y}"), (2, f"{y}\n{x}"), (3, f"{y}\n{x}")] + [(10 + k, sentence(rng, 20)) for k in range(50)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    for coalesced in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
        written.clear()
        try:
            got = {r.doc_id: list(r.drop) for r in linededup.repeated_lines(docs_of(spark, docs)).collect()}
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        assert {k: len(v) for k, v in got.items() if v} == {2: 1, 3: 2}
        rounds = [names for tag, names, _ in written if tag == "aligned"]
        assert len(rounds) > 1 and "lines" in rounds[0] and not any("lines" in names for names in rounds[1:])
        assert [options.get("deal", True) for tag, _, options in written if tag == "held"] == [False]


def test_lines_of_counts_words_as_split_at_white_space(spark):
    rng = random.Random(18)
    texts = ["".join(rng.choice(["a", "é", "\u00a0", " ", " ", "  ", "\t", "\r", "\n", "\x0b", "\f", "bc"]) for _ in range(rng.randrange(40))) for _ in range(300)] + ["one two\nthree", "", None]
    got = {r.doc_id: r for r in linededup.lines_of(docs_of(spark, list(enumerate(texts)))).collect()}
    number = {}
    for k, text in enumerate(texts):
        lines = [x.strip(" \t\r") for x in (text or "").split("\n")]
        assert list(got[k].words) == [len(re.split(r"[ \t\n\x0b\f\r]+", x)) if x else 0 for x in lines]
        assert [h == 0 for h in got[k].hashes] == [not x for x in lines]
        assert all(number.setdefault(x, h) == h for x, h in zip(lines, got[k].hashes, strict=True))
    assert len(set(number.values())) == len(number)


def test_runs_of_a_batch_are_those_of_each_document():
    rng = np.random.default_rng(19)
    size = rng.integers(0, 9, 60)
    bounds = np.concatenate([[0], np.cumsum(size)])
    words = rng.integers(0, 7, bounds[-1])
    hashes = np.where(words > 0, rng.integers(1, 6, bounds[-1]), 0)
    doc, h = linededup._held_runs(hashes, words, bounds, 8)
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        assert sorted(set(h[doc == k].tolist())) == linededup._run_hashes(hashes[a:b], words[a:b], 8).tolist()


def test_patience_alignment_is_a_common_subsequence():
    rng = random.Random(12)
    for _ in range(1500):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(10))] for _ in range(2))
        pairs = []
        linededup._patience(a, b, 0, len(a), 0, len(b), pairs)
        assert all(a[x] == b[y] for x, y in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert linededup.aligned_blocks([1, 2, 3, 4, 5], [9, 1, 2, 3, 8, 4, 5]) == [(1, 4), (5, 7)]


# ---- personal data ----

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def valid(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(p) <= 255 for p in v.split("."))
        if kind == "card":
            doubled = [int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))]
            return 13 <= len(d) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(BASE[k], text or "") if valid(k, m[0])]


def test_pii_base_equals_brute_force(spark):
    rng = random.Random(13)
    docs = [(k, "".join(rng.choice("ab1.2@+-_ ()é😀%5\n,255") for _ in range(rng.randrange(45)))) for k in range(2500)]
    docs += [(3000, None), (3001, ""), (3002, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 +1234567890 4111 1111 1111 1111 a@b@c.d"), (3003, "x 001.02.3.255 999.1.1.1"), (None, "z a@b.c"), (3004, "a" * 20000 + "@b.c " + "1" * 20000)]
    got = {r.doc_id: [(pii.KINDS[s.k], s.s, s.e) for s in r.base] for r in pii.find_pii(docs_of(spark, docs)).collect()}
    assert got == {k: base_spans(t) for k, t in docs}


def test_pii_contexts_find_unseen_identifiers(spark):
    rng = random.Random(14)
    docs = [(k, f"{sentence(rng, 8)} telephone: +1 (0{k:02d}) 555-{1000 + k} {sentence(rng, 5)}") for k in range(12)]
    docs += [(50, f"{sentence(rng, 5)} telephone: 555-0199-77 {sentence(rng, 3)}"), (51, f"{sentence(rng, 5)} room 555-0199-77 end"), (52, "telephone: soon"), (53, "version 3. of 12345678")]
    got = {r.doc_id: [(pii.KINDS[s.k], s.s, s.e) for s in r.found] for r in pii.find_pii(docs_of(spark, docs)).collect()}
    text = dict(docs)[50]
    at = text.index("555-0199-77")
    assert got[50] == [("phone", at, at + 11)] and all(not v for k, v in got.items() if k != 50)


def test_pii_found_instances_induce_patterns(spark):
    """A number found behind one pattern makes another pattern, which finds the next number."""
    rng = random.Random(15)
    docs = [(k, f"{sentence(rng, 8)} telephone: +1 (0{k:02d}) 555-{1000 + k} {sentence(rng, 5)}") for k in range(12)]
    docs += [(40, f"{sentence(rng, 5)} telephone: 555-0099-77 {sentence(rng, 3)}"), (41, f"room 101 {sentence(rng, 3)} 555-0099-77")]
    docs += [(50 + k, f"{sentence(rng, 6)} handset: 555-0099-77 {sentence(rng, 4)}") for k in range(4)]
    docs += [(60, f"{sentence(rng, 5)} handset: 555-0042-11 {sentence(rng, 3)}"), (61, f"{sentence(rng, 5)} item 555-0042-99 {sentence(rng, 3)}"), (62, "handset: 12")]
    docs += [(70 + k, "serial 4444-1111-22 copied") for k in range(9)] + [(90, "serial 9999-1111-22 copied")]
    got = {r.doc_id: [(pii.KINDS[s.k], s.s, s.e) for s in r.found] for r in pii.find_pii(docs_of(spark, docs)).collect()}
    want = {k: [("phone", t.index(x), t.index(x) + 11)] for k, t in docs for x in ("555-0099-77", "555-0042-11") if x in t and k != 41}
    assert {k: v for k, v in got.items() if v} == want and len(want) == 6


def test_pii_of_rows_that_share_an_id(spark):
    rows = [(1, "a@b.c x"), (1, "x 1.2.3.4"), (1, "x 1.2.3.4"), (2, None)]
    got = sorted((r.doc_id, [(pii.KINDS[s.k], s.s, s.e) for s in r.base]) for r in pii.find_pii(docs_of(spark, rows)).collect())
    assert got == [(1, [("email", 0, 5)]), (1, [("ip", 2, 9)]), (1, [("ip", 2, 9)]), (2, [])]


# ---- classifiers ----


def test_language_kernel_equals_brute_force():
    rng = random.Random(18)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    sets = [{(t.lower().encode()[k : k + n]) for n in (1, 2, 3) for k in range(len(t.encode()) - n + 1)} for t in texts]
    spectra = [langid.spectrum(t) for t in texts]
    assert [len(s) for s in spectra] == [len(s) for s in sets]
    want = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    assert np.allclose(langid.kernel(spectra, spectra), want)
    model = langid.fit_ridge(spectra, ["x", "y"] * 20, 8, 0.01)
    marks = [k for r in (0, 1) for k in range(r, 40, 2)[:8]]
    weights = np.linalg.lstsq(want[:, marks], model.values(spectra), rcond=None)[0]
    assert np.allclose(want[:, marks] @ weights, model.values(spectra), atol=1e-4)  # values are sums over landmarks' kernels
    long = "ab" * 700000 + "ç"
    assert set(langid.spectrum(long)) == set(langid.spectrum("abab" + "ç"))


def test_language_accuracy_on_held_out_rows(spark):
    from palimpsest.llm.langid import op8_langid

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op8_langid(spark, SF).join(docs, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_language_of_odd_texts(spark):
    train = docs_of(spark, [(k, "the cat is here and " * 3) for k in range(9)] + [(20, None), (21, "le chat est ici et la " * 3)]).withColumn("lang", F.when(F.col("doc_id") > 20, "fr").when(F.col("doc_id") < 10, "en"))
    model = langid.fit(train)
    rows = docs_of(spark, [(1, None), (2, ""), (3, "123 !!"), (4, "the cat and the"), (4, "le chat et la"), (None, "the " * 100000), (7, "² ½ ①")])
    got = Counter((r.doc_id, r.lang_pred) for r in langid.predict(rows, model, ["doc_id", "label"]).collect())
    assert got == Counter([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "fr"), (None, "en"), (7, "und")])
    none = langid.fit(train.where("false"))
    assert [r.lang_pred for r in langid.predict(rows, none, ["doc_id"]).collect()] == ["und"] * 7


def test_quality_on_held_out_rows(spark):
    rows = quality.op10_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows)
    good, bad = [[r.score for r in held if r.quality == q] for q in (1, 0)]
    assert np.mean([a > b for a in good for b in bad]) > 0.9


def test_quality_covers_the_whole_text_and_odd_rows(spark):
    net = quality.train(["good words here"] * 6 + ["bad!!! ###"] * 6, np.array([1] * 6 + [0] * 6), np.ones(12), epochs=3)
    rows = quality.score(docs_of(spark, [(1, None), (2, ""), (3, "x" * 700000), (None, "é")]), net).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    text = "calm words " * 3000
    top = quality.pooled(quality.blocks(net, quality._padded(text + "#" * 30)))
    assert len(top) == len(quality.chunk_starts(-(-len(text + "#" * 30) // 64))) and quality.score(docs_of(spark, [(1, "a")]), None).first().score == 0.5


# ---- empty tables ----


def test_empty_tables(spark):
    none = docs_of(spark, [(1, "a")]).where("false")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontam.decontaminate(none, items).count() == 0
    assert [r.n_items for r in decontam.decontaminate(docs_of(spark, [(1, "a b c")]), items.where("false")).collect()] == [0]
    assert simhash.with_next(none).count() == 0
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert licenses.scan(none.withColumn("path", F.lit("p"))).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert linededup.dedup_lines(none).count() == 0
    assert pii.find_pii(none).count() == 0
    assert langid.predict(none, langid.fit(none.withColumn("lang", F.lit("en"))), ["doc_id"]).count() == 0
    assert quality.score(none, None).count() == 0
    assert chat.chat_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_line_dedup_aligns_each_pair_in_one_python_worker(spark, monkeypatch):
    """A filter on the diff's result once ran the diff a second time, in a second worker of the same task."""
    plans, write = [], linededup.materialize

    def noted(df, tag, **options):
        if tag == "aligned":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag, **options)

    monkeypatch.setattr(linededup, "materialize", noted)
    rng = random.Random(31)
    block = sentence(rng, 20)
    got = {r.doc_id: r.n_dropped for r in linededup.dedup_lines(docs_of(spark, [(1, block), (2, f"{sentence(rng, 9)}\n{block}")])).collect()}
    assert got == {1: 0, 2: 1} and plans
    assert {p.split("Initial Plan")[0].count("ArrowEvalPython") for p in plans} == {1}


def test_workers_give_dropped_caches_back_to_the_system():
    """Idle workers stay beside a stage's JVM memory; freed blocks below one that is held once stayed theirs."""
    code = """
import re
from palimpsest.llm import common
held = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10
cache = {k: bytes(1000) for k in range(100_000)}
pin = bytes(1000)
common.WORKER_CACHES.append(cache)
full = held()
common.drop_worker_caches()
print(full - held(), len(cache))
"""
    freed, left = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT).stdout.split())
    assert freed > 80 and left == 0


def test_line_dedup_sends_short_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        docs = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "x")], "doc_id long, text string")
        assert linededup.dedup_lines(docs).count() == 2
        assert int(spark.conf.get(name)) <= linededup.BATCH
    finally:
        spark.conf.set(name, before)
