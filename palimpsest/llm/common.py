"""Helpers shared by the training-data operators.

Conventions that hold for every operator of this subpackage:

* Inputs are reduced to the named columns first, so extra columns never clash.
* A null text counts as an empty text. A null id is an id like any other.
* Ids are expected to be unique. Each row gets a result row of its own text, also where rows share an id:
  operators that compare documents tell such rows apart by a hash of the text.
* Intermediate tables go to ``spark.checkpoint.dir`` (:func:`materialize`), which
  executors share, so a lost executor never takes the only copy with it.
"""

from __future__ import annotations

import gc
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from ..shared import few_files, give_back, materialize, release, shared_dir, short_batches  # noqa: F401

#: Measured bytes up to which a side is broadcast; beyond it joins shuffle.
BROADCAST_BYTES = 32 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Caches that Python workers keep between tasks, as workers are used again.
WORKER_CACHES: list[dict] = []


def drop_worker_caches() -> None:
    """Frees what another operator's tasks have left in this worker."""
    for cache in WORKER_CACHES:
        if cache:
            cache.clear()
            gc.collect()
    give_back()


def _width(column: Column, kind: DataType) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, StructType):
        return reduce(add, (_width(column[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StringType | BinaryType | StructType | ArrayType):
            return F.coalesce(F.aggregate(column, F.lit(16).cast("long"), lambda a, x: a + _width(x, kind.elementType).cast("long")), F.lit(8))
        return F.coalesce(16 + 8 * F.size(column), F.lit(8))
    if isinstance(kind, StringType | BinaryType):
        return 16 + F.coalesce(F.octet_length(column), F.lit(0))
    return F.lit(8)


def measured(df: DataFrame) -> int:
    """Bytes of a table's rows, about, by reading it once."""
    width = reduce(add, (_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return int(df.agg(F.sum(width.cast("long"))).first()[0] or 0)


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint if the table, read once for that, has at most ``BROADCAST_BYTES``; without it the join shuffles."""
    return F.broadcast(df) if measured(df) <= BROADCAST_BYTES else df


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` is the fast way where every character is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
