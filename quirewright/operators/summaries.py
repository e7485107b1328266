"""Grouped summaries, rankings, pivots and analysis of variance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirewright.functions.text import ratio
from quirewright.operators.running import running_sum
from quirewright.session import written



def top_values(df: DataFrame, groups: list[str], value: str, k: int) -> DataFrame:
    """(groups, value, documents, rank): the ``k`` most frequent non-null values of every group, ties by value.

    Counts are summed partially before the shuffle, and each task keeps only its ``k`` best per group before ranking.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("documents"))
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("documents"), value))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def _first_values(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The ``k`` smallest distinct values of every group, joined by '; '."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(value))
    some = df.where(F.col(value).isNotNull()).select(group, value).distinct().withColumn("r", rank).where(F.col("r") <= k)
    return some.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(value)), "; ").alias("values"))


#: Attributes of a publication of which the most frequent value is shown (ties: the smallest), and of which the first few are.
_MODES = {
    "display_publication_title": "publication_title_display",
    "top_source_type": "source_type",
    "top_publisher": "publisher_name",
    "top_publisher_region": "publisher_region",
}
_FIRSTS = {"normalized_variants": ("publication_title_normalized", 8), "publication_ids": ("publication_id", 5)}


def media_summary(df: DataFrame, group: str = "publication_title_canonical") -> DataFrame:
    """One row per publication: sizes, years, variants, ids, modes, authors and mean subject terms.

    One pass: every record gives a row per attribute, counted by publication, attribute and value before and after the
    shuffle, so a publication with a third of all records is spread over its values; of each attribute a task keeps the
    few best before they are ranked. Groups are never null after normalisation.
    """
    columns = {"_all": F.lit(""), "_author": F.col("primary_author")} | {n: F.col(c) for n, c in _MODES.items()} | {n: F.col(c) for n, (c, _) in _FIRSTS.items()}
    each = F.array(*(F.struct(F.lit(n).alias("attribute"), c.alias("value")) for n, c in columns.items()))
    rows = df.select(F.col(group).alias("name"), "year", "subject_term_count", F.inline(each)).where("value IS NOT NULL")
    counts = rows.groupBy("name", "attribute", "value").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("year").alias("low"),
        F.max("year").alias("high"),
        F.sum("subject_term_count").alias("terms"),
    )
    counts = written(counts, "publication_counts")  # read twice below; the records are read once
    by_rank = Window.partitionBy("name", "attribute").orderBy(F.when(F.col("attribute").isin(*_MODES), -F.col("n")).otherwise(F.lit(0)), "value")
    best = counts.where("attribute <> '_author'").withColumn("r", F.row_number().over(by_rank)).where(F.col("r") <= max(k for _, k in _FIRSTS.values()))
    of = lambda n, k=1: (F.col("attribute") == n) & (F.col("r") <= k)
    whole = lambda c: F.max(F.when(of("_all"), F.col(c)))
    text = {n: F.coalesce(F.max(F.when(of(n), F.col("value"))), F.lit("")) for n in _MODES}
    text |= {n: F.array_join(F.array_sort(F.collect_list(F.when(of(n, k), F.col("value")))), "; ") for n, (_, k) in _FIRSTS.items()}
    out = best.groupBy("name").agg(
        whole("n").alias("documents"),
        whole("low").alias("first_year"),
        whole("high").alias("last_year"),
        (whole("terms") / whole("n")).alias("avg_subject_terms"),
        *(c.alias(n) for n, c in text.items()),
    )
    authors = counts.where("attribute = '_author'").groupBy("name").agg(F.count(F.lit(1)).alias("unique_authors"))
    return out.join(authors, "name", "left").select(
        F.col("name").alias("publication_title_canonical"),
        "display_publication_title",
        "documents",
        "first_year",
        "last_year",
        "normalized_variants",
        "publication_ids",
        "top_source_type",
        "top_publisher",
        "top_publisher_region",
        F.coalesce("unique_authors", F.lit(0).cast("bigint")).alias("unique_authors"),
        "avg_subject_terms",
    )


def publication_examples(df: DataFrame, k: int = 3) -> DataFrame:
    """(publication_title_normalized, example_kind, value, documents, rank): most frequent titles, ids, publishers and source types."""
    kinds = {"publication_title": "publication_title", "publication_id": "publication_id", "publisher_name": "publisher_name", "source_type": "source_type"}
    each = F.array(*(F.struct(F.lit(n).alias("example_kind"), F.col(c).alias("value")) for n, c in kinds.items()))
    rows = df.select("publication_title_normalized", F.inline(each)).where("value <> ''")
    return top_values(rows, ["publication_title_normalized", "example_kind"], "value", k)


def canonical_rollup(media: DataFrame, mapping: DataFrame) -> DataFrame:
    """Documents summed, display name of the largest member, and the first five variants of every canonical name."""
    joined = media.alias("m").join(mapping.alias("c"), F.col("m.publication_title_canonical") == F.col("c.publication_title"), "left")
    rows = joined.select(
        F.coalesce("c.canonical_title", "m.publication_title_canonical").alias("canonical_title"),
        F.col("m.publication_title_canonical").alias("variant"),
        "m.documents",
        "m.display_publication_title",
    )
    largest = F.min_by("display_publication_title", F.struct(-F.col("documents"), "variant"))
    out = rows.groupBy("canonical_title").agg(F.sum("documents").alias("english_documents"), largest.alias("display_publication_title"))
    return out.join(_first_values(rows, "canonical_title", "variant", 5).withColumnRenamed("values", "normalized_variants"), "canonical_title")


def group_counts(df: DataFrame, *groups: str) -> DataFrame:
    """Documents of every group, null groups kept."""
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("documents"))


def pivot_shares(counts: DataFrame, row: str, column: str, values: list | None, name: str) -> DataFrame:
    """``row`` by the values of ``column``: each cell's share of its column's sum, 0 where there is nothing.

    Without ``values``, all that occur in ``column`` are taken, in order.
    """
    if values is None:
        counts = written(counts.where(F.col(column).isNotNull()), "counts")
        values = sorted(r[0] for r in counts.select(column).distinct().collect())  # a row per value that becomes a column
        if not values:
            return counts.select(row)
    total = F.sum("documents").over(Window.partitionBy(column))
    shares = counts.where(F.col(column).isin(*values)).withColumn("share", ratio(F.col("documents"), total))
    wide = shares.groupBy(row).pivot(column, values).agg(F.sum("share")).na.fill(0.0)
    return wide.select(row, *(F.col(f"`{v}`").alias(f"{name}_{v}") for v in values))


def ranked(df: DataFrame, by: str, ties: str, name: str) -> DataFrame:
    """A rank from 1, largest ``by`` first, nulls last, no equal ranks; a running sum of ones, so no task sees all rows."""
    rows = df.withColumns({"_null": F.col(by).isNull(), "_by": -F.col(by), "_ties": F.col(ties), "_one": F.lit(1)})
    numbered = running_sum(rows, [], ["_null", "_by", "_ties"], "_one", name)
    return numbered.select(*df.columns, F.col(name).cast("int").alias(name))


def anova(df: DataFrame, group: str, value: str, least: int = 30) -> DataFrame:
    """One-way analysis of variance over the groups of at least ``least`` rows: two rows, between groups and residual.

    From one aggregation by group; figures that are undefined (one group, no spread) are null.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    stats = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("s2")).where(F.col("n") >= least)
    mean = F.sum(F.col("n") * F.col("m")) / F.nullif(F.sum("n"), F.lit(0))
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum("n") * mean * mean
    one = stats.agg(
        F.greatest(between, F.lit(0.0)).alias("ssb"),
        F.coalesce(F.sum((F.col("n") - 1) * F.coalesce("s2", F.lit(0.0))), F.lit(0.0)).alias("ssw"),
        (F.count(F.lit(1)) - 1).alias("dfb"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("dfw"),
    )
    some = lambda c: F.nullif(c, F.lit(0))
    msb, msw = F.col("ssb") / some(F.greatest("dfb", F.lit(0))), F.col("ssw") / some("dfw")
    f = msb / F.nullif(msw, F.lit(0.0))
    eta = F.col("ssb") / F.nullif(F.col("ssb") + F.col("ssw"), F.lit(0.0))
    none = F.lit(None).cast("double")
    line = lambda name, ss, df_, ms, f_, eta_: F.struct(
        F.lit(name).alias("source"), ss.alias("sum_sq"), df_.cast("bigint").alias("df"), ms.alias("mean_sq"), f_.alias("f_stat"), eta_.alias("eta_squared")
    )
    return one.select(F.inline(F.array(line(group, F.col("ssb"), F.col("dfb"), msb, f, eta), line("residual", F.col("ssw"), F.col("dfw"), msw, none, none))))


def group_statistics(df: DataFrame, group: str, value: str, least: int = 30) -> DataFrame:
    """n, mean and sample standard deviation of the groups of at least ``least`` rows."""
    stats = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group)
    return stats.agg(F.count(F.lit(1)).alias("documents"), F.avg(value).alias("mean_value"), F.stddev_samp(value).alias("sd_value")).where(F.col("documents") >= least)
