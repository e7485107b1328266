"""Packed fields into rows: one row per value, with its position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewright.functions.packed import items

PACKED_FIELDS = ("subject_terms", "authors", "class_terms", "company_name")


def packed_arrays(df: DataFrame, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per record and field: the columns ``keep``, ``field_name`` and the array ``field_items``.

    A missing field gives an empty array. Needs no shuffle, whatever the skew: each row is split where it lies.
    """
    each = F.array(*(F.struct(F.lit(f).alias("field_name"), items(F.col(f)).alias("field_items")) for f in fields))
    return df.select(*keep, F.inline(each))


def packed_rows(df: DataFrame, fields: Sequence[str], keep: Sequence[str] = (), min_items: int = 1) -> DataFrame:
    """One row per item: ``keep``, ``field_name``, ``item_pos`` from 1, ``item``.

    ``min_items`` leaves out the fields that hold fewer items. Repeated items stay; nulls, missing tokens and empty
    tables give no rows; other columns of ``df`` are never read, so their names cannot clash.
    """
    arrays = packed_arrays(df, fields, keep).where(F.size("field_items") >= min_items)
    exploded = arrays.select(*keep, "field_name", F.posexplode("field_items").alias("item_pos", "item"))
    return exploded.withColumn("item_pos", (F.col("item_pos") + 1).cast("int"))
