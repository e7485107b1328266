"""The typed and normalised columns of the metadata records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewright.functions.geo import publisher_location
from quirewright.functions.text import (
    decade,
    list_items,
    metadata_text,
    nullif_missing,
    numeric,
    parse_date,
    partition_family,
    publication_display,
    publication_key,
)
from quirewright.functions.text import key as text_key
from quirewright.schema import SOURCE_COLUMNS, TEXT_COLUMNS, require


def with_missing_as_null(df: DataFrame, columns: list[str] = TEXT_COLUMNS) -> DataFrame:
    """The exact missing tokens of every text column made null."""
    return df.withColumns({c: nullif_missing(F.col(c)) for c in columns})


def renamed_source(df: DataFrame, what: str) -> DataFrame:
    """The 31 required source columns by their snake-case names; extra columns are dropped, a lacking one raises."""
    require(df.columns, list(SOURCE_COLUMNS), what)
    extra = [c for c in ("source_partition", "row_id") if c in df.columns]
    return df.select(*(F.col(f"`{raw}`").alias(name) for raw, name in SOURCE_COLUMNS.items()), *extra)


def prepared(df: DataFrame, language: str | None = None) -> DataFrame:
    """All derived columns beside the text columns, which hold null for missing tokens.

    With a ``language``, only its rows; the filter is on the column as it is stored, so it reaches the scan.

    Nothing is computed that is not selected later: the columns are plain expressions, so Catalyst prunes them.
    Null text gives '' or ``Unknown`` in the normalised columns and empty lists.
    """
    require(df.columns, [*TEXT_COLUMNS, "source_partition"], "the table")
    rows = with_missing_as_null(df if language is None else df.where(F.col("language") == language))
    date = parse_date(F.col("date"))
    place = publisher_location(F.col("publisher_city"), F.col("publisher_province"))
    rows = rows.withColumns(
        {
            "publication_day": date,
            "place": place,
            "author_items": list_items(F.col("authors")),
            "subject_items": list_items(F.col("subject_terms")),
            "class_items": list_items(F.col("class_terms")),
            "company_items": list_items(F.col("company_name")),
            "partition_family": partition_family(F.col("source_partition")),
            "title_normalized": text_key(F.col("title")),
            "publication_title_normalized": publication_key(F.col("publication_title")),
        }
    )
    return rows.withColumns(
        {
            "publication_date": F.date_format("publication_day", "yyyy-MM-dd"),
            "year": F.year("publication_day").cast("bigint"),
            "decade": decade(F.year("publication_day")).cast("bigint"),
            "publication_title_canonical": F.col("publication_title_normalized"),
            "publication_title_display": publication_display(F.col("publication_title"), F.col("publication_title_normalized")),
            "publisher_city_normalized": F.col("place.city"),
            "publisher_province_normalized": F.col("place.province"),
            "publisher_region": F.col("place.region"),
            "publisher_location_normalized": F.col("place.location"),
            "primary_author": F.get("author_items", F.lit(0)),
            "author_count": F.size("author_items").cast("smallint"),
            "subject_term_count": F.size("subject_items").cast("smallint"),
            "class_term_count": F.size("class_items").cast("smallint"),
            "company_count": F.size("company_items").cast("smallint"),
            "pages_numeric": numeric(F.col("pages")),
            "metadata_text": metadata_text(F.col("title"), F.col("subject_items"), F.col("class_items")),
        }
    )


def english(df: DataFrame) -> DataFrame:
    """Rows whose language is exactly ``English``; null is not."""
    return df.where(F.col("language") == "English")
