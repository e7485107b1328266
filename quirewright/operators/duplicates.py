"""Duplicate rules: counted and flagged, never removed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirewright.operators.skew import join_groups
from quirewright.session import written

#: The rules by flag and the columns that make their keys; the date is the raw text, null counts as ''.
RULES = {
    "duplicate_goid": ("goid",),
    "duplicate_exact_title_date_publication": ("title", "date", "publication_title"),
    "duplicate_normalized_title_date_publication": ("title_normalized", "date", "publication_title_normalized"),
    "duplicate_title_date": ("title_normalized", "date"),
}
CONSERVATIVE = "duplicate_normalized_title_date_publication"
EXTRA = "is_conservative_duplicate_extra"


def row_key(columns: tuple[str, ...]) -> Column:
    """128-bit fingerprint of the columns, null as ''; lengths keep neighbouring values apart."""
    parts = []
    for c in columns:
        text = F.coalesce(F.col(c), F.lit(""))
        parts += [F.length(text).cast("string"), text]
    return F.unhex(F.md5(F.concat_ws("|", *parts)))


def _keys(df: DataFrame, rules: dict[str, tuple[str, ...]], keep: list[str]) -> DataFrame:
    each = F.array(*(F.struct(F.lit(r).alias("rule"), row_key(c).alias("key")) for r, c in rules.items()))
    return df.select(*keep, F.inline(each))


def duplicate_summary(df: DataFrame, rules: dict[str, tuple[str, ...]] = RULES) -> DataFrame:
    """(duplicate_rule, duplicate_extra_rows, duplicate_groups, share_of_rows) of every rule, in one pass.

    A key held by a third of all rows, such as a missing id, is one row per task after the partial counts.
    """
    groups = _keys(df, rules, []).groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy(F.col("rule").alias("duplicate_rule")).agg(
        F.sum(F.col("n") - 1).alias("duplicate_extra_rows"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        (F.sum(F.col("n") - 1) / F.sum("n")).alias("share_of_rows"),
    )


def duplicate_flags(df: DataFrame, order: list[str], rules: dict[str, tuple[str, ...]] = RULES) -> DataFrame:
    """``df`` with a flag per rule (the whole group, its first row included) and the extra flag of the conservative rule.

    ``order`` names a row uniquely and says which one is first. Groups are counted with partial sums; only their rows
    are joined back, hot groups by broadcast, so no group is gathered in one task.
    """
    keyed = written(_keys(df, rules, order), "duplicate_keys")
    groups = keyed.groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first")).where("n > 1")
    total = keyed.count()
    members = join_groups(keyed, groups, ["rule", "key"], "n", total)
    extra = (F.col("rule") == CONSERVATIVE) & (F.struct(*order) != F.col("first"))
    flags = members.groupBy(*order).agg(
        *(F.max(F.col("rule") == r).alias(f"_{r}") for r in rules), F.max(extra).alias(f"_{EXTRA}")
    )
    named = flags.select(*(F.col(c).alias(f"_{c}") for c in order), *(f"_{r}" for r in [*rules, EXTRA]))
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in order))
    return df.join(named, on, "left").select(*df.columns, *(F.coalesce(f"_{r}", F.lit(False)).alias(r) for r in [*rules, EXTRA]))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in the given order; for small tables and for keys without hot groups."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
