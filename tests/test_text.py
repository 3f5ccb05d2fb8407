import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators.align import content_words, passages

ALPHABET = st.text(alphabet="ab.!?\"') \n“”'Dr1,’", max_size=60)


def test_tokens_fold_lookalikes_and_drop_invisible_characters():
    assert T.words_of("Don't 'quote' pаper ze​ro ÉTÉ rock'n'roll'") == ["don't", "quote", "paper", "zero", "été", "rock'n'roll"]


def test_expression_and_python_tokens_agree(spark):
    texts = ["Don't 'quote' pаper ze​ro x_y 12a", "", "’tis ΑΣ İx — ٣٤ é"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", T.norms(F.col("text")).alias("w")).collect()
    assert {r.k: r.w for r in rows} == {k: T.words_of(t) for k, t in enumerate(texts)}


def test_sentences_stop_at_marks_but_not_after_abbreviations():
    text = 'Dr. Smith went. "Hi there." He said e.g. this! Really?) J. Doe 3.14 is pi.\nNew line'
    parts = [text[a:b] for a, b in T.sentence_spans(text)]
    assert parts == ["Dr. Smith went.", '"Hi there."', "He said e.g. this!", "Really?)", "J. Doe 3.14 is pi.", "New line"]


@settings(max_examples=200, deadline=None)
@given(ALPHABET)
def test_sentences_cover_all_that_is_not_space(text):
    spans = T.sentence_spans(text)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    rest = list(text)
    for a, b in spans:
        rest[a:b] = " " * (b - a)
    assert not "".join(rest).strip(T.SPACE)


def test_quotes_citations_and_references():
    text = 'He said "one" and “two” x.\n"open only\nIt is so (Doe, 2019). See [3, 4].\nReferences\nDoe, J.'
    assert [text[a:b] for a, b in T.quote_spans(text)] == ['"one"', "“two”"]
    spans = T.sentence_spans(text)
    cited = [text[a:b] for (a, b), c in zip(spans, T.cited_flags(text, spans), strict=True) if c]
    assert "It is so (Doe, 2019)." in cited and "See [3, 4]." in cited
    assert text[T.bibliography_start(text) :].startswith("References")
    assert T.bibliography_start("References\n" + "x " * 50) == -1


def test_replaced_characters():
    assert T.replaced_spans("pаper ze​ro мо") == [(1, 2), (8, 9)]


def test_passages_tolerate_small_edits():
    src = "the quick brown fox jumps over the lazy dog near the quiet river bank today".split()
    sub = "intro words here the quick brown fox jumps across the lazy dog near the quiet river bank today".split()
    found = passages(sub, src)
    assert [(p.start, p.end) for p in found] == [(3, 18)]
    assert passages(src[:6], src) == [] and passages(src[:4], src) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("alpha beta gamma delta omega kappa".split()), max_size=40), st.lists(st.sampled_from("alpha beta gamma delta omega kappa".split()), max_size=40))
def test_passage_properties(sub, src):
    found = passages(sub, src)
    assert all(p.end - p.start >= 7 and content_words(sub[p.start : p.end]) >= 3 for p in found)
    assert all(x.end <= y.start for x, y in zip(found, found[1:], strict=False))
    for p in found:
        assert sub[p.start : p.start + 5] == src[p.src_start : p.src_start + 5]


def test_self_match_is_one_passage():
    words = re.findall(r"\w+", "many different content words stand here in a row without any repeats")
    assert [(p.start, p.end) for p in passages(words, words)] == [(0, len(words))]
