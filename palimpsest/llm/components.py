"""Connected components of a link table, with DataFrame joins only.

Alternating large-star and small-star steps: each node's larger (then smaller) neighbours are hung on the
smallest node it sees, until nothing changes. Minima are aggregated before they are joined, so
a hub never gathers in one task, and every step is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``id, label`` for every node of ``links(a, b)``; a label is the smallest node that can be reached.

    Self-links and nulls are ignored, repeated links count once; no links, no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "edges")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        release(edges, large)
        edges = small
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("label"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots)
