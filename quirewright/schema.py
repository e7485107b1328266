"""Column lists of the document metadata tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: The 31 source columns, in file order, and the snake-case name of each.
SOURCE_COLUMNS = {
    "GOID": "goid",
    "Title": "title",
    "Date": "date",
    "Source Type": "source_type",
    "Authors": "authors",
    "Publication ID": "publication_id",
    "Publication Title": "publication_title",
    "Publisher City": "publisher_city",
    "Publisher Province": "publisher_province",
    "ISBN": "isbn",
    "Publisher Name": "publisher_name",
    "Publisher ZipCode": "publisher_zipcode",
    "Object Type": "object_type",
    "Language": "language",
    "Pages": "pages",
    "Degree Date": "degree_date",
    "Degree": "degree",
    "Degree Type": "degree_type",
    "School Name": "school_name",
    "School Code": "school_code",
    "School Location": "school_location",
    "Department": "department",
    "Advisors": "advisors",
    "Committee Members": "committee_members",
    "Class Terms": "class_terms",
    "Subject Terms": "subject_terms",
    "Paper Categories": "paper_categories",
    "Paper Keywords": "paper_keywords",
    "Start Page": "start_page",
    "Company Name": "company_name",
    "Company NAIC": "company_naic",
}
RAW_COLUMNS = list(SOURCE_COLUMNS)
TEXT_COLUMNS = list(SOURCE_COLUMNS.values())
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])


class MissingColumns(ValueError):
    """An input lacks some of the required columns."""


def require(have: list[str], need: list[str], what: str) -> None:
    """Raise if a required column is absent; extra columns are allowed."""
    absent = [c for c in need if c not in have]
    if absent:
        raise MissingColumns(f"{what} lacks the columns {', '.join(absent)}")


#: The derived columns of the clean table, in order.
DERIVED_COLUMNS = [
    "source_partition",
    "partition_family",
    "publication_date",
    "year",
    "decade",
    "publisher_city_normalized",
    "publisher_province_normalized",
    "publisher_region",
    "publisher_location_normalized",
    "primary_author",
    "author_count",
    "subject_term_count",
    "class_term_count",
    "company_count",
    "pages_numeric",
]
CLEAN_COLUMNS = TEXT_COLUMNS + DERIVED_COLUMNS

#: The categories of the lexicon.
LEXICON_CATEGORIES = ("positive", "negative", "uncertainty", "litigious", "constraining", "strong_modal", "weak_modal")
#: The duplicate flags of the feature table, in order.
DUPLICATE_FLAGS = [
    "duplicate_goid",
    "duplicate_exact_title_date_publication",
    "duplicate_normalized_title_date_publication",
    "duplicate_title_date",
    "is_conservative_duplicate_extra",
]
#: The columns of the feature table, in order.
FEATURE_COLUMNS = [
    "goid",
    "source_partition",
    "partition_family",
    "date",
    "publication_date",
    "year",
    "decade",
    "source_type",
    "object_type",
    "language",
    "title_normalized",
    "publication_title",
    "publication_title_normalized",
    "publication_title_canonical",
    "publication_title_display",
    "publication_id",
    "publisher_name",
    "publisher_city_normalized",
    "publisher_province_normalized",
    "publisher_region",
    "publisher_location_normalized",
    "primary_author",
    "author_count",
    "subject_term_count",
    "class_term_count",
    "company_count",
    "pages_numeric",
    *DUPLICATE_FLAGS,
    "lm_token_count",
    *(f"lm_{c}{end}" for c in LEXICON_CATEGORIES for end in ("", "_rate")),
    "lm_net_tone",
    "topic_id",
    "topic_label",
    "topic_weight",
    "title_only_topic_id",
    "title_only_topic_label",
    "title_only_topic_weight",
]
