"""Completeness, frequencies, coverage and page statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewright.functions.text import canonical_term, ratio
from quirewright.schema import TEXT_COLUMNS

MISSING_LABEL = "<missing>"

#: The fields that matter for analysis.
USABLE_FIELDS = (
    "title",
    "date",
    "source_type",
    "authors",
    "publication_title",
    "publisher_name",
    "publisher_city",
    "publisher_province",
    "object_type",
    "pages",
    "subject_terms",
    "class_terms",
    "company_name",
)


def row_counts(df: DataFrame) -> DataFrame:
    """All rows and English rows of each partition."""
    return df.groupBy("source_partition").agg(F.count(F.lit(1)).alias("raw_rows"), F.count_if(F.col("language") == "English").alias("english_rows"))


def missing_profile(df: DataFrame, columns: list[str] = TEXT_COLUMNS) -> DataFrame:
    """(column_name, missing_rows, missing_share) of every column in one pass; the share is of all rows."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing_rows")) for c in columns))
    rows = counts.select("n", F.inline(each))
    return rows.select("column_name", "missing_rows", ratio(F.col("missing_rows"), F.col("n")).alias("missing_share"))


def usable_fields(missing: DataFrame) -> DataFrame:
    rows = missing.where(F.col("column_name").isin(*USABLE_FIELDS))
    return rows.select("column_name", (1 - F.col("missing_share")).alias("nonmissing_share"), "missing_rows", "missing_share")


def date_bounds(df: DataFrame, *groups: str) -> DataFrame:
    """First and last date and the number of dates that are invalid or missing, in all or by group."""
    return df.groupBy(*groups).agg(
        F.min("publication_date").alias("first_date"),
        F.max("publication_date").alias("last_date"),
        F.count_if(F.col("publication_date").isNull()).alias("invalid_or_missing_dates"),
    )


def frequencies(df: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """(dimension, value, documents) of several columns in one pass; a null value counts as ``<missing>``.

    The rows are unpivoted and pre-aggregated before the shuffle, so a value that most rows hold is one row per task.
    """
    each = F.array(
        *(F.struct(F.lit(d).alias("dimension"), F.coalesce(c.cast("string"), F.lit(MISSING_LABEL)).alias("value")) for d, c in dimensions.items())
    )
    return df.select(F.inline(each)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("documents"))


def all_row_frequencies(df: DataFrame) -> DataFrame:
    names = {"source_type": "source_type", "language": "language", "object_type": "object_type"}
    derived = {"publisher_region": "publisher_region", "publisher_location": "publisher_location_normalized", "source_partition": "source_partition"}
    return frequencies(df, {d: F.col(c) for d, c in (names | derived).items()})


def english_frequencies(df: DataFrame) -> DataFrame:
    """Publications as written and normalised, years and decades; null years are left out, null names are not."""
    columns = {"publication": "publication_title", "publication_normalized": "publication_title_normalized", "year": "year", "decade": "decade"}
    rows = frequencies(df, {d: F.col(c) for d, c in columns.items()})
    return rows.where(~(F.col("dimension").isin("year", "decade") & (F.col("value") == MISSING_LABEL)))


def final_counts(df: DataFrame) -> DataFrame:
    """The frequencies of the feature table: three keep the missing values, year and decade leave them out."""
    columns = ("source_type", "object_type", "publisher_region", "year", "decade")
    rows = frequencies(df, {c: F.col(c) for c in columns})
    return rows.where(~(F.col("dimension").isin("year", "decade") & (F.col("value") == MISSING_LABEL)))


def term_frequencies(df: DataFrame) -> DataFrame:
    """(dimension, value, documents): mentions of every subject term, class term and author, in canonical form."""
    each = F.array(
        *(
            F.struct(F.lit(d).alias("dimension"), F.transform(F.col(c), canonical_term).alias("terms"))
            for d, c in (("subject_terms", "subject_items"), ("class_terms", "class_items"), ("authors", "author_items"))
        )
    )
    terms = df.select(F.inline(each)).select("dimension", F.explode("terms").alias("value"))
    return terms.where("value <> ''").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("documents"))


def most_frequent(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent values of one dimension, ties by name."""
    return counts.orderBy(F.desc("documents"), "value").limit(k)


def page_statistics(df: DataFrame) -> DataFrame:
    """n, mean, population standard deviation, least and most pages."""
    p = F.col("pages_numeric")
    return df.agg(
        F.count(p).alias("n"),
        F.avg(p).alias("mean_pages"),
        F.stddev_pop(p).alias("sd_pages"),
        F.min(p).alias("min_pages"),
        F.max(p).alias("max_pages"),
    )


def author_coverage(df: DataFrame, *groups: str) -> DataFrame:
    """Documents, documents with an author and author mentions by decade and further groups; null decades are left out."""
    rows = df.where("decade IS NOT NULL")
    if "source_type" in groups:
        rows = rows.withColumn("source_type", F.coalesce("source_type", F.lit(MISSING_LABEL)))
    return _shares(
        rows.groupBy("decade", *groups).agg(
            F.count(F.lit(1)).alias("documents"),
            F.count_if(F.col("author_count") > 0).alias("documents_with_author"),
            F.sum(F.col("author_count").cast("bigint")).alias("author_mentions"),
        )
    )


def _shares(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "author_coverage_share": ratio(F.col("documents_with_author"), F.col("documents")),
            "mean_author_mentions": ratio(F.col("author_mentions"), F.col("documents")),
        }
    )


def coverage_since(by_decade_and_source: DataFrame, first_decade: int = 2000) -> DataFrame:
    """The coverage by source type of the decades from ``first_decade`` on, rolled up from the finer table."""
    rows = by_decade_and_source.where(F.col("decade") >= first_decade)
    return _shares(rows.groupBy("source_type").agg(*(F.sum(c).alias(c) for c in ("documents", "documents_with_author", "author_mentions"))))


def partition_quality(df: DataFrame, validation: DataFrame | None = None) -> DataFrame:
    """Rows, English share, first and last date and invalid dates of each partition, with the file validation."""
    out = df.groupBy("source_partition").agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(F.col("language") == "English").alias("english_rows"),
        F.min("publication_date").alias("first_date"),
        F.max("publication_date").alias("last_date"),
        F.count_if(F.col("publication_date").isNull()).alias("invalid_or_missing_dates"),
    )
    out = out.withColumn("english_share", ratio(F.col("english_rows"), F.col("raw_rows")))
    return out.join(validation, "source_partition", "left") if validation is not None else out


def _metric_rows(one_row: DataFrame, names: list[str]) -> DataFrame:
    """A single row turned into (metric, value), values as text."""
    each = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("string").alias("value")) for n in names))
    return one_row.select(F.inline(each))


def core_summary(df: DataFrame, sample: DataFrame | None = None, lexicon_source: str | None = None) -> DataFrame:
    """(metric, value): sizes, time range, invalid dates, number of source types and of English publications.

    With the ``sample`` that topics are fitted on and the ``lexicon_source``, also its size and where the lexicon is from.
    """
    isenglish = F.col("language") == "English"
    one = df.agg(
        F.count(F.lit(1)).alias("raw_documents"),
        F.count_if(isenglish).alias("english_documents"),
        F.min("publication_date").alias("time_range_start"),
        F.max("publication_date").alias("time_range_end"),
        F.count_if(F.col("publication_date").isNull()).alias("invalid_or_missing_dates"),
        F.count_distinct(F.coalesce("source_type", F.lit(MISSING_LABEL))).alias("source_type_count"),
        F.count_distinct(F.when(isenglish, F.col("publication_title_normalized"))).alias("normalized_publications"),
    )
    rows = _metric_rows(one, one.columns)
    if sample is not None:
        rows = rows.union(_metric_rows(sample.agg(F.count(F.lit(1)).alias("topic_sample_rows")), ["topic_sample_rows"]))
    if lexicon_source is not None:
        rows = rows.union(df.sparkSession.createDataFrame([("lexicon_source", lexicon_source)], "metric STRING, value STRING"))
    return rows


def coverage_metrics(df: DataFrame) -> DataFrame:
    """(metric, value): rows, English rows and share, first and last date, invalid dates."""
    one = df.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(F.col("language") == "English").alias("english_rows"),
        F.min("publication_date").alias("first_observed_date"),
        F.max("publication_date").alias("last_observed_date"),
        F.count_if(F.col("publication_date").isNull()).alias("invalid_or_missing_dates"),
    )
    share = F.round(ratio(F.col("english_rows"), F.col("raw_rows")), 6).alias("english_share")
    return _metric_rows(one.select("*", share), [*one.columns, "english_share"])


def metadata_depth(df: DataFrame) -> DataFrame:
    """By decade: documents, share with subject and class terms, mean length of the metadata text."""
    text = lambda c: (F.coalesce(F.length(c), F.lit(0)) > 0).cast("int")
    return (
        df.where("decade IS NOT NULL")
        .groupBy("decade")
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.avg(text("subject_terms")).alias("subject_term_coverage"),
            F.avg(text("class_terms")).alias("class_term_coverage"),
            F.avg(F.length("metadata_text")).alias("mean_text_length"),
        )
    )
