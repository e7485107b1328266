"""Most frequent items in bounded memory, by exact refinement of hash prefixes.

Counts of hash prefixes bound the counts of the items below them. Prefixes whose count cannot reach the lower bound
are dropped, the others are lengthened, until whole values remain; their counts are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirewright.session import broadcast_if_small, written

#: Lengths of the prefixes in bits; a level has at most 4096 times as many groups as prefixes were kept.
LEVELS = (12, 24, 36)


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("h", 64 - bits)


def hashed(items: DataFrame) -> DataFrame:
    """(field_name, item, h), written once: every level reads the hashes only. Null items are none; '' is one."""
    rows = items.where("item IS NOT NULL").select("field_name", "item", F.xxhash64("field_name", "item").alias("h"))
    return written(rows, "hashed")


def _kept(rows: DataFrame, keep: DataFrame | None, bits: int) -> DataFrame:
    """The rows under the kept prefixes, which are broadcast only after their number was checked."""
    if keep is None:
        return rows
    prefixed = rows.withColumn("prefix", _prefix(bits))
    return prefixed.join(broadcast_if_small(keep.select("field_name", "prefix")), ["field_name", "prefix"], "left_semi").drop("prefix")


def _refine(rows: DataFrame, choose) -> DataFrame:
    """Exact (field_name, item, n) under the prefixes that ``choose`` keeps at each level."""
    keep, last = None, 0
    for bits in LEVELS:
        counts = _kept(rows, keep, last).groupBy("field_name", _prefix(bits).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        keep, last = written(choose(counts), f"prefix{bits}"), bits
    return _kept(rows, keep, last).groupBy("field_name", "item").agg(F.count(F.lit(1)).alias("n"))


def totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("field_name").agg(F.count(F.lit(1)).alias("total"))


def items_above(rows: DataFrame, share: float) -> DataFrame:
    """(field_name, item, n, total) of the items that make up at least ``share`` of their field's values.

    At most 1/share prefixes a field can be kept, however many distinct items there are. ``rows`` comes from ``hashed``.
    """
    bound = F.broadcast(written(totals(rows), "totals"))  # a row per field

    def choose(counts: DataFrame) -> DataFrame:
        return counts.join(bound, "field_name").where(F.col("n") >= share * F.col("total")).drop("total")

    return _refine(rows, choose).join(bound, "field_name").where(F.col("n") >= share * F.col("total"))


def top_items(rows: DataFrame, k: int) -> DataFrame:
    """(field_name, item, n, rank) of the ``k`` most frequent items of each field; ties go to the smaller item.

    First a beam down the fullest prefixes gives exact counts of some items; the k-th of them is a lower bound of the
    k-th of all. Then every prefix that could still beat it is refined. A field with fewer than k items gives them all.
    """
    by_count = Window.partitionBy("field_name").orderBy(F.desc("n"), "prefix")

    def beam(counts: DataFrame) -> DataFrame:
        return counts.withColumn("r", F.row_number().over(by_count)).where(F.col("r") <= 4 * k).drop("r")

    some = _refine(rows, beam)
    kth = some.withColumn("r", F.row_number().over(Window.partitionBy("field_name").orderBy(F.desc("n"), "item"))).where(F.col("r") == k)
    bound = F.broadcast(written(kth.select("field_name", F.col("n").alias("least")), "bound"))  # a row per field

    def choose(counts: DataFrame) -> DataFrame:
        return counts.join(bound, "field_name", "left").where(F.col("n") >= F.coalesce("least", F.lit(1))).drop("least")

    exact = _refine(rows, choose).join(bound, "field_name", "left").where(F.col("n") >= F.coalesce("least", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("field_name").orderBy(F.desc("n"), "item"))
    return exact.select("field_name", "item", "n", rank.alias("rank")).where(F.col("rank") <= k)
