"""Bounded, deterministic samples of rows to fit models on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; null ids count as bucket 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)), F.lit(0))


def spread(df: DataFrame, n: int) -> DataFrame:
    """``n`` distinct ids of ``df(doc_id, ...)`` at most, in the order of a hash."""
    return df.filter(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
