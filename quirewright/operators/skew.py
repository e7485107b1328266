"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one part in HOT_PARTS of all rows, so there are fewer than HOT_PARTS hot keys.
HOT_PARTS = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row per key and the number of its rows in ``size``.

    Hot keys, fewer than HOT_PARTS by definition whatever the input, are broadcast and joined where the rows lie; the
    others are shuffled, no key of them holding more than one row in HOT_PARTS of the ``total``. No row is dropped.
    """
    limit = total // HOT_PARTS
    hot = F.broadcast(groups.where(F.col(size) > limit))
    cold = groups.where(F.col(size) <= limit)
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def with_group_columns(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of ``rows`` with ``groups`` on one 128-bit ``key``: the columns of ``groups``, null where there is none.

    Rows of hot keys get their group by broadcast. For the shuffled join they are given a key of their own, which
    matches nothing, so they spread over all tasks.
    """
    values = [c for c in groups.columns if c != key]
    limit = total // HOT_PARTS
    hot = F.broadcast(groups.where(F.col(size) > limit).select(key, F.struct(*values).alias("_hot")))
    cold = groups.where(F.col(size) <= limit).select(F.col(key).alias("_key"), F.struct(*values).alias("_cold"))
    marked = rows.join(hot, key, "left")
    spread = F.when(F.col("_hot").isNotNull(), F.unhex(F.md5(F.concat(key, F.monotonically_increasing_id().cast("string"))))).otherwise(F.col(key))
    joined = marked.withColumn("_spread", spread).join(cold, F.col("_spread") == F.col("_key"), "left")
    got = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *(got[c].alias(c) for c in values))
