"""Deterministic stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _lot(key: str, seed: int) -> Column:
    """The place of a row in the draw: a hash of its key and the seed that any engine computes alike."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def stratified(df: DataFrame, strata: list[str], key: str, per_stratum: int, seed: int = 42) -> DataFrame:
    """At most ``per_stratum`` rows of every stratum, null strata included, chosen by the hash of ``key`` and the seed.

    The choice does not depend on the order or partitioning of the rows. Each task first keeps its own best rows of a
    stratum (a limit pushed below the shuffle), so a stratum of a third of all rows is no burden.
    """
    order = Window.partitionBy(*strata).orderBy(_lot(key, seed), key)
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_stratum).drop("_rank")


def capped(df: DataFrame, strata: list[str], key: str, limit: int, seed: int = 42) -> DataFrame:
    """At most ``limit`` rows in all: an equal cap per stratum, at least one row, then a uniform cap."""
    groups = df.select(*strata).distinct().count()
    some = stratified(df, strata, key, max(1, limit // max(groups, 1)), seed)
    return some.orderBy(_lot(key, seed + 1), key).limit(limit)


def long_enough(df: DataFrame, column: str, more_than: int) -> DataFrame:
    return df.where(F.length(column) > more_than)
