"""Functions callable from SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from ..operators import align
from . import text as T

_SPANS = "array<struct<start:int,end:int>>"


def _spans(find):  # noqa: ANN001, ANN202
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> list:
            at = T.Bytes(t or "")
            return [{"start": at(a), "end": at(b)} for a, b in find(t or "")]

        return s.map(one)

    return run


def register(spark: SparkSession) -> None:
    """Registers ``tokenize, sentences, quote_spans, replaced_spans, html_to_text, bibliography_start`` and the table function ``match_passages(sub, src)``."""
    from ..sources.html import html_to_text

    spark.udf.register("tokenize", F.pandas_udf(lambda s: s.map(lambda t: T.words_of(t or "")), "array<string>"))
    for name, find in (("sentences", T.sentence_spans), ("quote_spans", T.quote_spans), ("replaced_spans", T.replaced_spans)):
        spark.udf.register(name, F.pandas_udf(_spans(find), _SPANS))
    spark.udf.register("html_to_text", F.pandas_udf(lambda s: s.map(html_to_text), "string"))
    spark.udf.register("bibliography_start", F.pandas_udf(lambda s: s.map(lambda t: T.bibliography_start(t or "")), "int"))

    @F.udtf(returnType="block int, tok_from int, tok_to int, src_from int, src_to int")
    class MatchPassages:
        def eval(self, sub: str, src: str):  # noqa: ANN201
            for k, p in enumerate(align.passages(T.words_of(sub or ""), T.words_of(src or ""))):
                yield Row(k, p.start, p.end, p.src_start, p.src_end)

    spark.udtf.register("match_passages", MatchPassages)
