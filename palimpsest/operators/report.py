"""Similarity reports: exclusions, exclusive credit of matched words, groups, highlights.

Blocks are computed once; a report applies filters to them, so many filter settings can be tried without matching again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lists
from ..functions import text as T


@dataclass(frozen=True)
class Filters:
    exclude_quotes: bool = False
    exclude_bib: bool = False
    exclude_cited: bool = False
    exclude_small: int = 0
    excluded_sources: tuple[int, ...] = ()
    excluded_matches: tuple[str, ...] = ()  # "source:block"


@dataclass
class Source:
    id: int
    url: str
    title: str
    type: str
    blocks: list[tuple[int, int, int]]  # block, from, to
    owned: np.ndarray = field(default=None)  # block of each token, -1 for none
    total: int = 0


def pct(a: float, b: float) -> int:
    return floor(100 * a / b + 0.5) if b > 0 else 0


def tenth(x: float) -> float:
    return floor(x * 10 + 0.5) / 10


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches of equal values."""
    if not len(values):
        return []
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(values)], strict=True))


def credit(sources: list[Source], n: int) -> tuple[np.ndarray, list[Source]]:
    """Gives every matched token to one source: again and again the one with most tokens not yet given, of equal ones that with the larger total, then the earlier.

    Returns the rank of each token's source (0 for none) and the sources by rank.
    """
    rank, order, rest = np.zeros(n, np.int64), [], list(sources)
    while rest:
        gain = [int(((s.owned >= 0) & (rank == 0)).sum()) for s in rest]
        k = max(range(len(rest)), key=lambda i: (gain[i], rest[i].total, -i))
        if gain[k] == 0:
            break
        chosen = rest.pop(k)
        order.append(chosen)
        rank[(chosen.owned >= 0) & (rank == 0)] = len(order)
    return rank, order


def build(text: str, sources: list[Source], f: Filters) -> dict:
    """The report of one text. Sources come in a fixed order (type, then key), which settles ties."""
    tokens = T.token_spans(text)
    n, at = len(tokens), T.Bytes(text)
    bib = T.bibliography_start(text)
    quotes, sentences = T.quote_spans(text), T.sentence_spans(text)
    cited_spans = [s for s, c in zip(sentences, T.cited_flags(text, sentences), strict=True) if c]
    in_quote, in_cited = T.inside(quotes), T.inside(cited_spans)
    quoted = np.array([in_quote(s) for _, s, _ in tokens], bool)
    cited = np.array([in_cited(s) for _, s, _ in tokens], bool)
    out = np.zeros(n, bool)
    if f.exclude_bib and bib >= 0:
        out |= np.array([s >= bib for _, s, _ in tokens], bool)
    if f.exclude_quotes:
        out |= quoted
    if f.exclude_cited:
        out |= cited
    span = lambda a, b: (at(tokens[a][1]), at(tokens[b - 1][2]))

    active, dropped = [], []
    for s in sources:
        owned = np.full(n, -1, np.int64)
        for block, lo, hi in s.blocks:
            if f"{s.id}:{block}" not in f.excluded_matches:
                owned[lo:hi] = np.where(out[lo:hi], owned[lo:hi], block)
        for a, b in runs(owned):
            if owned[a] >= 0 and b - a < f.exclude_small:
                owned[a:b] = -1
        s.owned, s.total = owned, int((owned >= 0).sum())
        if s.total:
            (dropped if s.id in f.excluded_sources else active).append(s)

    by_type = {t: pct(int(np.any([s.owned >= 0 for s in active if s.type == t] or [np.zeros(n, bool)], axis=0).sum()), n) for t in lists.SOURCE_TYPES}
    rank, order = credit(active, n)
    given = rank > 0
    block_of = np.full(n, -1, np.int64)
    for r, s in enumerate(order, 1):
        block_of[rank == r] = s.owned[rank == r]
    pieces = np.stack([rank, block_of, quoted.astype(np.int64)]) if n else np.zeros((3, 0), np.int64)
    highlights, groups = [], {g: [0, 0] for g in lists.GROUPS}
    change = np.flatnonzero((pieces[:, 1:] != pieces[:, :-1]).any(0)) + 1 if n else []
    bounds = [0, *[int(c) for c in change], n]
    for a, b in zip(bounds, bounds[1:], strict=False):
        if a < b and given[a]:
            name = lists.GROUPS[2 * bool(quoted[a]) + bool(cited[a:b].any())]
            groups[name][0] += 1
            groups[name][1] += b - a
            s, e = span(a, b)
            highlights.append({"start": s, "end": e, "source": int(rank[a]), "src_id": order[int(rank[a]) - 1].id, "block": int(block_of[a]), "grp": name, "words": b - a})
    counted = {r: sum(1 for h in highlights if h["source"] == r) for r in range(1, len(order) + 1)}
    listed = [
        {"rank": r, "id": s.id, "url": s.url, "title": s.title, "type": s.type, "words": int((rank == r).sum()), "percent": tenth(100 * int((rank == r).sum()) / max(1, n)), "blocks": counted[r], "total": s.total, "excluded": False}
        for r, s in enumerate(order, 1)
    ]
    plain = lambda s, gone: {"rank": 0, "id": s.id, "url": s.url, "title": s.title, "type": s.type, "words": 0, "percent": 0.0, "blocks": 0, "total": s.total, "excluded": gone}
    listed += [plain(s, False) for s in active if all(s is not o for o in order)]
    listed += [plain(s, True) for s in sorted(dropped, key=lambda s: -s.total)]
    matched = int(given.sum())
    return {
        "total_words": n, "matched_words": matched, "index_percent": pct(matched, n), "index_exact": 100 * matched / max(1, n),
        "by_type": by_type, "bib_start": at(bib) if bib >= 0 else -1,
        "quotes": [{"start": at(a), "end": at(b)} for a, b in quotes],
        "excluded": [dict(zip(("start", "end"), span(a, b), strict=True)) for a, b in runs(out) if out[a]],
        "groups": [{"name": g, "count": c, "words": w, "percent": tenth(100 * w / max(1, n))} for g, (c, w) in groups.items()],
        "highlights": highlights, "sources": listed,
    }


SPAN = "array<struct<start:int,end:int>>"
REPORT = (
    "doc_id long, total_words int, matched_words int, index_percent int, index_exact double, by_type map<string,int>, bib_start int, "
    f"quotes {SPAN}, excluded {SPAN}, groups array<struct<name:string,count:int,words:int,percent:double>>, "
    "highlights array<struct<start:int,end:int,source:int,src_id:long,block:int,grp:string,words:int>>, "
    "sources array<struct<rank:int,id:long,url:string,title:string,type:string,words:int,percent:double,blocks:int,total:int,excluded:boolean>>"
)
_FIELDS = [c.strip().split(" ")[0] for c in "doc_id,total_words,matched_words,index_percent,index_exact,by_type,bib_start,quotes,excluded,groups,highlights,sources".split(",")]


def similarity_reports(docs: DataFrame, blocks: DataFrame, sources: DataFrame, filters: Filters = Filters()) -> DataFrame:  # noqa: B008
    """A report per document. ``blocks`` as from the passage matcher; ``sources``: ``src_id, url, title, type``.

    Blocks are gathered by document (bounded by the document's own passages) and joined to the texts once.
    """
    order = F.expr("array_position(array('Internet', 'Publication', 'Student Paper'), type)")
    per = blocks.groupBy("sub_id", "src_id").agg(F.sort_array(F.collect_list(F.struct("block", "tok_from", "tok_to"))).alias("blocks"))
    per = per.join(sources.select("src_id", "url", "title", "type"), "src_id")
    per = per.groupBy(F.col("sub_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "src_id", "url", "title", "type", "blocks"))).alias("found"))
    joined = docs.select("doc_id", "text").join(per, "doc_id", "left").select("doc_id", "text", F.to_json("found").alias("found"))
    settings = asdict(filters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Filters(**settings)
        for batch in batches:
            out = []
            for doc, text, found in zip(batch["doc_id"], batch["text"], batch["found"], strict=True):
                given = [
                    Source(s["src_id"], s.get("url", ""), s.get("title", ""), s.get("type", ""), [(b["block"], b["tok_from"], b["tok_to"]) for b in s["blocks"]])
                    for s in (json.loads(found) if isinstance(found, str) else [])
                ]
                out.append({"doc_id": doc} | build(text or "", given, f))
            yield pd.DataFrame(out, columns=_FIELDS)

    return joined.mapInPandas(run, REPORT)


def source_state() -> Column:
    """Display state of a source row: excluded, ranked or overshadowed."""
    return F.when(F.col("excluded"), "excluded").when(F.col("rank") > 0, "ranked").otherwise("overshadowed")
