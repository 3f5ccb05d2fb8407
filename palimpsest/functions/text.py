"""Scalar text functions: Catalyst expressions where they can say it, plain Python for what is sequential.

Offsets of the Python functions are UTF-8 bytes, half-open, as in the report's data model.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lists

APOSTROPHES = "'’"
TOKEN = rf"[\p{{L}}\p{{Nd}}][\p{{L}}\p{{Nd}}{APOSTROPHES}{lists.INVISIBLE}]*"
#: Letters whose general lower case depends on the place or has two characters are replaced first.
FROM = "".join(lists.LOOKALIKES) + "İΣ’"
TO = "".join(lists.LOOKALIKES.values()) + "iσ'"
SPACE = " \t\n\r\f\v"

# ---- expressions ----


def norms(text: Column) -> Column:
    """Normal forms of a text's tokens: invisible characters dropped, look-alikes folded, lower case, no apostrophes at the ends."""
    return F.transform(tokens(text), lambda w: F.rtrim(w, F.lit("'")))


def tokens(text: Column) -> Column:
    """As :func:`norms`, with the apostrophes at the ends."""
    folded = F.lower(F.translate(text, FROM + lists.INVISIBLE, TO))  # what has no counterpart is dropped
    return F.regexp_extract_all(folded, F.lit(rf"[\p{{L}}\p{{Nd}}][\p{{L}}\p{{Nd}}']*"), F.lit(0))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, although ``f`` uses it in loops."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def grams(tokens: Column, k: int = 5) -> Column:
    """All runs of ``k`` tokens as strings joined by spaces; none where there are fewer tokens."""

    def runs(t: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, k), " "))
        return F.when(F.size(t) >= k, every).otherwise(F.array().cast("array<string>"))

    return let(tokens, runs)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves away from zero; 0 of nothing."""
    return F.when(whole > 0, F.floor(100 * part / whole + 0.5)).otherwise(0).cast("long")


def one_decimal(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def heading_pattern() -> str:
    return rf"(?imd)^[ \t]*({lists.HEADINGS})[ \t]*:?[ \t]*$"


def mattr(tokens: Column, window: int = 40, step: int = 5) -> Column:
    """Moving-average type-token ratio."""

    def ratio(t: Column) -> Column:
        n = F.size(t)
        starts = F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)), F.lit(step))
        parts = F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(t, i, window))) / F.lit(float(window)))
        moving = let(parts, lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.size(p))
        return F.when(n == 0, 0.0).when(n <= window, F.size(F.array_distinct(t)) / n).otherwise(moving)

    return let(tokens, ratio)


# ---- Python ----

_TOKEN = regex.compile(TOKEN)
_TRANSLATED = str.maketrans(FROM, TO, lists.INVISIBLE)
_FOLD = dict(zip(FROM, TO, strict=True)) | dict.fromkeys(lists.INVISIBLE, "")
_ASCII_TOKEN = re.compile("[a-z0-9][a-z0-9']*")
_HIDDEN = frozenset(lists.INVISIBLE)
_FOLDING = re.compile(f"[{FROM}{lists.INVISIBLE}]")
_ABBREVIATIONS = frozenset(lists.ABBREVIATIONS)
_END = re.compile(r"""\n|[.!?][.!?"')\]]*[”’]*""")
_LAST = re.compile(_END.pattern.split("|", 1)[1] + r"\Z")
_CLOSERS = frozenset(""".!?"')]”’""")
_BEFORE = re.compile(r"[A-Za-z0-9.]*\Z")
_CITATION = re.compile(lists.CITATION, re.ASCII)
_HEADING = re.compile(rf"^[ \t]*({lists.HEADINGS})[ \t]*:?[ \t]*$", re.IGNORECASE | re.MULTILINE)
_SMALL = re.compile(r"[ \t\r\f\v]*[a-z]")
_LONGEST = max(map(len, lists.ABBREVIATIONS)) + 1  # what is as long is no abbreviation
_INITIAL = re.compile(r"[a-z]\Z")


class Bytes:
    """Byte offsets of the characters of a text."""

    def __init__(self, text: str) -> None:
        self.at = None if text.isascii() else [0, *accumulate(len(c.encode()) for c in text)]

    def __call__(self, k: int) -> int:
        return k if self.at is None else self.at[k]


@lru_cache(1 << 16)
def _norm(token: str) -> str:
    return token.translate(_TRANSLATED).lower().strip("'")


@lru_cache(1)
def _folded_token() -> re.Pattern:
    """Tokens of a folded text. ``re`` is faster than ``regex``, but has no such classes: their letters and digits are listed."""
    every = "".join(map(chr, range(0x110000)))
    kinds = "".join(f"{every[a]}-{every[b - 1]}" for a, b in (m.span() for m in regex.finditer(r"[\p{L}\p{Nd}]+", every)))
    return re.compile(f"[{kinds}][{kinds}']*")


def _folded(text: str) -> tuple[str, re.Pattern] | None:
    """The text with each character folded as in :func:`_norm`, and the pattern of its tokens; nothing where places would shift."""
    if text.isascii():
        return text.lower(), _ASCII_TOKEN
    if _FOLDING.search(text):
        kinds = set(text) & _FOLD.keys()
        if not _HIDDEN.isdisjoint(kinds):
            return None
        for c in kinds:  # few, so faster than translate
            text = text.replace(c, _FOLD[c])
    return text.lower(), _folded_token()


def token_spans(text: str) -> list[tuple[str, int, int]]:
    """(norm, start, end) of each token, in characters."""
    if found := _folded(text):
        return [(m[0].rstrip("'"), *m.span()) for m in found[1].finditer(found[0])]
    out = []
    for m in _TOKEN.finditer(text):
        word = _norm(m[0])
        if word:
            out.append((word, *m.span()))
    return out


def words_of(text: str) -> list[str]:
    return [w for w, _, _ in token_spans(text)]


def word_set(text: str) -> set[str]:
    """The different words of a text."""
    if found := _folded(text):
        return {w.rstrip("'") for w in set(found[1].findall(found[0]))}
    return set(words_of(text))


def paragraph_spans(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for line in text.split("\n"):
        inner = line.strip(SPACE)
        if inner:
            start = at + len(line) - len(line.lstrip(SPACE))
            out.append((start, start + len(inner)))
        at += len(line) + 1
    return out


def _ends_sentence(text: str, mark: re.Match) -> bool:
    if mark[0] == "\n":
        return True
    end = mark.end()
    if end < len(text) and text[end] not in SPACE:
        return False
    if mark[0][0] != ".":
        return True
    before = _BEFORE.search(text[max(0, mark.start() - _LONGEST) : mark.start()])[0].lower()
    if before in _ABBREVIATIONS or _INITIAL.match(before):
        return False
    return not _SMALL.match(text, end)


#: What becomes of a sentence when another follows.
GOES_ON, ENDS, ENDS_BEFORE_CAPITAL = range(3)


def sentence_end(sentence: str) -> int:
    """Whether a single sentence ends when another follows after a space, by the rules of :func:`sentence_spans`."""
    mark = _LAST.search(sentence) if sentence[-1] in _CLOSERS else None
    if mark is None:
        return GOES_ON
    if mark[0][0] != ".":
        return ENDS
    return ENDS_BEFORE_CAPITAL if _ends_sentence(sentence + " A", mark) else GOES_ON


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Sentences, in characters. A line break always ends one; a full stop does not after an abbreviation or initial or before a small letter."""
    cuts = [0]
    for m in _END.finditer(text):
        if _ends_sentence(text, m):
            cuts += [m.start(), m.end()] if m[0] == "\n" else [m.end(), m.end()]
    cuts.append(len(text))
    out = []
    for a, b in zip(cuts[::2], cuts[1::2], strict=True):
        part = text[a:b]
        inner = part.strip(SPACE)
        if inner:
            start = a + len(part) - len(part.lstrip(SPACE))
            out.append((start, start + len(inner)))
    return out


def quote_spans(text: str) -> list[tuple[int, int]]:
    """Text in quotation marks within a paragraph. A new opening mark replaces an open one; a straight mark also closes a curly one."""
    out = []
    for a, b in paragraph_spans(text):
        opened = None
        for m in re.finditer('[“«”»"]', text[a:b]):
            mark, k = m[0], a + m.start()
            if mark in "“«" or mark == '"' and opened is None:
                opened = k
            elif opened is not None:
                out.append((opened, k + 1))
                opened = None
    return out


def is_cited(sentence: str) -> bool:
    return bool(_CITATION.search(sentence.lower()) or _CITATION.search(sentence))


def cited_flags(text: str, sentences: list[tuple[int, int]]) -> list[bool]:
    """Whether a sentence has a citation, or a short next one opens with it."""
    parts = [text[a:b] for a, b in sentences]
    follow = [*parts[1:], ""][: len(parts)]
    return [is_cited(p) or len(n.encode()) < 40 and bool(_CITATION.search(n)) for p, n in zip(parts, follow, strict=True)]


def bibliography_start(text: str) -> int:
    """Character where a list of references begins, or -1: the last heading, if it is beyond two fifths of the bytes."""
    last = None
    for last in _HEADING.finditer(text):  # noqa: B007
        pass
    if last is None or len(text[: last.start()].encode()) < len(text.encode()) * 2 // 5:
        return -1
    return last.start()


def _latin(c: str) -> bool:
    return c < "\u0250" and c.isalpha()


def replaced_spans(text: str) -> list[tuple[int, int]]:
    """Look-alike letters and invisible characters next to a Latin letter."""
    return [
        (k, k + 1)
        for k, c in enumerate(text)
        if (c in lists.LOOKALIKES or c in lists.SUSPICIOUS) and (_latin(text[k - 1 : k] or " ") or _latin(text[k + 1 : k + 2] or " "))
    ]


def inside(spans: list[tuple[int, int]]) -> Callable[[int], bool]:
    """A test whether a place lies in any of some spans that do not overlap."""
    starts = [a for a, _ in spans]

    def test(k: int) -> bool:
        i = bisect_right(starts, k) - 1
        return i >= 0 and k < spans[i][1]

    return test
