"""The whole run: raw partitions to typed tables, summaries and report; and its second half alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewright.operators import duplicates, profiling, resolve, sampling, sentiment, summaries, topics
from quirewright.operators.prepare import prepared
from quirewright.plans.notebook import notebook
from quirewright.schema import CLEAN_COLUMNS, FEATURE_COLUMNS, require
from quirewright.session import written
from quirewright.sources import partitions, sinks

ORDER = ["source_partition", "row_id"]
FACETS = ["decade", "source_type", "partition_family"]


@dataclass
class Settings:
    """Sizes of the topic model; the sample per stratum bounds what it is fitted on."""

    n_topics: int = 12
    features: int = 8000
    min_df: int = 10
    rounds: int = 30
    per_stratum: int = 1200
    stop_words: tuple[str, ...] = topics.STOP_WORDS


def feature_rows(rows: DataFrame, lexicon: DataFrame, settings: Settings) -> tuple[DataFrame, topics.TopicModel, DataFrame]:
    """Prepared English records with flags, scores and topics; the model and the sample it is fitted on."""
    sample = sampling.stratified(sampling.long_enough(rows, "metadata_text", 5), ["decade", "source_type"], "row_id", settings.per_stratum)
    sample = written(sample.select("metadata_text"), "topic_sample")
    if sample.isEmpty():
        raise ValueError("no record has text to fit topics on")
    vectorizer = topics.fit_vectorizer(sample, "metadata_text", settings.features, settings.min_df, stop_words=settings.stop_words)
    model = topics.fit_topics(vectorizer.transform(sample, "metadata_text"), vectorizer.terms, settings.n_topics, settings.rounds)
    flagged = duplicates.duplicate_flags(rows, ORDER)
    scored = sentiment.scores(flagged, "metadata_text", sentiment.lexicon_members(lexicon))
    assigned = topics.assign(scored, "metadata_text", vectorizer, model)
    return topics.assign(assigned, "title", vectorizer, model, "title_only_"), model, sample


#: Counts that are tables of their own: name, frequencies they are taken from, dimension, name of the value, and how many.
COUNTS = (
    ("source_type_counts", "all", "source_type", "source_type", None),
    ("language_counts", "all", "language", "language", None),
    ("object_type_counts", "all", "object_type", "object_type", None),
    ("publisher_region_counts", "all", "publisher_region", "publisher_region", None),
    ("publisher_location_counts", "all", "publisher_location", "publisher_location", 200),
    ("top_publications_normalized", "english", "publication_normalized", "publication_title_normalized", 250),
    ("top_publications_raw", "english", "publication", "publication_title", 250),
    ("year_counts", "english", "year", "year", None),
    ("decade_counts", "english", "decade", "decade", None),
    ("top_subject_terms", "terms", "subject_terms", "subject_term", 1000),
    ("top_class_terms", "terms", "class_terms", "class_term", 1000),
    ("top_authors", "terms", "authors", "author", 1000),
)


def explored(rows: DataFrame, lexicon: DataFrame) -> dict[str, DataFrame]:
    """The tables of the exploration, from the prepared English records."""
    members = sentiment.lexicon_members(lexicon)
    long_ = sampling.long_enough(rows, "metadata_text", 10)
    by_source = profiling.author_coverage(rows, "source_type")
    types = rows.withColumn("object_type", F.coalesce("object_type", F.lit(profiling.MISSING_LABEL)))
    return {
        "author_coverage": profiling.author_coverage(rows).orderBy("decade"),
        "author_coverage_by_source": by_source.orderBy("decade", "source_type"),
        "author_coverage_since_2000": profiling.coverage_since(by_source).orderBy(F.desc("documents"), "source_type"),
        "metadata_depth": profiling.metadata_depth(rows).orderBy("decade"),
        "page_statistics": profiling.page_statistics(rows),
        "pages_anova": summaries.anova(rows, "object_type", "pages_numeric"),
        "object_type_by_decade_share": summaries.pivot_shares(summaries.group_counts(types, "object_type", "decade"), "object_type", "decade", None, "share").orderBy("object_type"),
        "group_sizes": sentiment.group_sizes(long_, FACETS).orderBy("facet", "group_value"),
        "group_terms": sentiment.group_terms(long_, "metadata_text", FACETS).orderBy("facet", "group_value", "rank"),
        "group_lexicon_totals": sentiment.group_lexicon_totals(long_, "metadata_text", FACETS, members).orderBy("facet", "group_value"),
        "lexicon_lookup": sentiment.category_lookup(members).select("word", F.array_join("categories", ",").alias("categories")).orderBy("word"),
        "publication_examples": summaries.publication_examples(rows).orderBy("publication_title_normalized", "example_kind", "rank"),
    }


def run(
    spark: SparkSession,
    raw_root: str,
    lexicon: DataFrame,
    out: str,
    manifest: dict[str, int] | None = None,
    settings: Settings | None = None,
    watch_list: DataFrame | None = None,
    lexicon_source: str = "",
) -> dict[str, str]:
    """Everything under ``out``: tables/, csv/ and report.md. Returns where the tables are."""
    settings = settings or Settings()
    parts = partitions.discover(spark, raw_root, manifest)
    validation = written(partitions.inspected(spark, parts), "validation")
    records = written(partitions.scan(spark, parts), "records")
    everything = prepared(records)
    in_english = written(prepared(records, "English").drop("place", "publication_day"), "prepared")
    csv = f"{out}/csv"
    sinks.write_csv(validation, f"{csv}/partition_validation")
    missing = written(profiling.missing_profile(everything), "missing")
    sinks.write_csv(missing.orderBy(F.desc("missing_share"), "column_name"), f"{csv}/column_completeness")
    sinks.write_csv(profiling.usable_fields(missing).orderBy("column_name"), f"{csv}/usable_fields")
    quality = written(profiling.partition_quality(everything, validation), "quality")
    sinks.write_csv(quality.orderBy("source_partition"), f"{csv}/partition_quality")
    sinks.write_csv(profiling.coverage_metrics(everything), f"{csv}/coverage_metrics")
    frequencies = {
        "all": written(profiling.all_row_frequencies(everything), "frequencies"),
        "english": written(profiling.english_frequencies(in_english), "frequencies"),
        "terms": written(profiling.term_frequencies(in_english), "frequencies"),
    }
    for dimension, table in frequencies.items():
        sinks.write_csv(table.orderBy("dimension", F.desc("documents"), "value"), f"{csv}/frequencies_{dimension}")
    for name, source, dimension, value, limit in COUNTS:
        sinks.write_counts(frequencies[source].where(F.col("dimension") == dimension), f"{csv}/{name}", value, limit)
    copies = written(duplicates.duplicate_summary(in_english), "copies")
    sinks.write_csv(copies, f"{csv}/duplicate_summary")
    for name, table in explored(in_english, lexicon).items():
        sinks.write_csv(table, f"{csv}/{name}")
    features, model, sample = feature_rows(in_english, lexicon, settings)
    core = written(profiling.core_summary(everything, sample, lexicon_source), "core")
    sinks.write_csv(core, f"{csv}/core_summary")
    clean_path, feature_path = f"{out}/tables/clean_metadata", f"{out}/tables/metadata_features"
    features = written(features.select(*dict.fromkeys([*CLEAN_COLUMNS, *FEATURE_COLUMNS])), "features")
    sinks.write_parquet(features, clean_path, CLEAN_COLUMNS)
    sinks.write_parquet(features, feature_path, FEATURE_COLUMNS)
    sinks.write_csv(topics.topic_terms(spark, model), f"{csv}/topic_terms")
    off = written(partitions.mismatches(validation), "mismatches")
    counted = lambda dimension: frequencies["all"].where(F.col("dimension") == dimension).select("value", "documents").orderBy(F.desc("documents"), "value")
    sections = {
        "Corpus": ("A record is one document of the raw partitions; the tables hold the English ones, wherever they were published.", core),
        "Partitions": quality.orderBy("source_partition"),
        "Partitions that disagree with the manifest or a side file": "None." if off.isEmpty() else off,
        "Duplicates": ("Duplicates are flagged and none is removed: which rule is right depends on the question asked.", copies),
        "Source types": counted("source_type"),
        "Languages": counted("language").limit(12),
    }
    return {"clean": clean_path} | finish(spark, feature_path, out, sections, watch_list)


def finish(
    spark: SparkSession, feature_path: str, out: str, sections: dict[str, str | DataFrame | tuple[str, DataFrame | None]] | None = None, watch_list: DataFrame | None = None
) -> dict[str, str]:
    """From the feature table on: canonical names, summaries, checks and report."""
    features = spark.read.parquet(feature_path)
    require(features.columns, FEATURE_COLUMNS, "the feature table")
    first = written(summaries.media_summary(features, "publication_title_normalized"), "media")
    audit = written(resolve.alias_audit(first), "audit")
    mapping = written(resolve.canonical_map(first, audit), "canonical")
    sinks.rewrite(spark, feature_path, lambda df: resolve.canonicalised(df, mapping).select(*FEATURE_COLUMNS))
    features = spark.read.parquet(feature_path)
    media = written(summaries.media_summary(features), "media")
    by_decade = written(summaries.group_counts(features, "decade", "topic_id", "topic_label"), "topics")
    toned = features.where("year >= 2000 AND lm_token_count > 0")
    tables = {
        "publication_alias_audit": audit.orderBy(F.desc("auto_merge"), F.desc("char_similarity"), F.desc("token_overlap"), "publication_left", "publication_right"),
        "canonical_rollup": summaries.canonical_rollup(first, mapping).orderBy(F.desc("english_documents"), "canonical_title"),
        "media_summary": media.orderBy(F.desc("documents"), "publication_title_canonical"),
        "topic_counts": summaries.group_counts(features, "topic_id", "topic_label").orderBy(F.desc("documents"), "topic_id"),
        "topic_by_decade": by_decade.orderBy("decade", "topic_id"),
        "topic_share_by_decade": summaries.pivot_shares(by_decade, "topic_label", "decade", None, "share").orderBy("topic_label"),
        "topic_by_source_type": summaries.group_counts(features, "source_type", "topic_id", "topic_label").orderBy("source_type", "topic_id"),
        "tone_by_decade_and_source": sentiment.tone_by_decade_and_source(features).orderBy("decade", "source_type"),
        "tone_by_decade": sentiment.tone_by_decade(features).orderBy("decade"),
        "tone_anova": summaries.anova(toned, "source_type", "lm_net_tone"),
        "tone_group_statistics": summaries.group_statistics(toned, "source_type", "lm_net_tone").orderBy(F.desc("documents"), "source_type"),
        "final_counts": profiling.final_counts(features).orderBy("dimension", F.desc("documents"), "value"),
        "data_dictionary": sinks.data_dictionary(spark),
    }
    if watch_list is not None:
        tables["watched_publications"] = resolve.watched(media, watch_list).orderBy("corpus_rank", "publication")
        tables["unobserved_publications"] = resolve.expected_but_unobserved(media, watch_list).orderBy("reference_publication")
    for name, df in tables.items():
        sinks.write_csv(df, f"{out}/csv/{name}")
    count = features.count()
    sections = (sections or {}) | {
        "Publications": tables["media_summary"],
        "Topics": ("Topics are of title, subject and class terms; those of the title alone stand beside them for comparison.", tables["topic_counts"]),
        "Tone by decade": tables["tone_by_decade"],
        "Tables": f"`tables/clean_metadata` and `tables/metadata_features`, {count} records each; every summary is a folder under `csv`.",
        "Limits": "The texts of the documents are not part of the records. Terms are the provider's. Names are merged only where words or shared metadata support it; the others are for review.",
    }
    sinks.write_text(spark, f"{out}/report.md", sinks.report("Document metadata", sections))
    extra = ("watched_publications", "unobserved_publications") if watch_list is not None else ()
    sinks.write_text(spark, f"{out}/exploration.ipynb", notebook("Document metadata", out, extra))
    checks = validated(spark, feature_path)
    sinks.write_csv(checks, f"{out}/csv/validation")
    summary = [("feature_rows", count), ("publications", media.count()), ("merged_names", mapping.where("publication_title <> canonical_title").count())]
    sinks.write_csv(spark.createDataFrame(summary, "metric STRING, value BIGINT"), f"{out}/csv/run_summary")
    sinks.write_csv(sinks.artifacts(spark, out), f"{out}/csv/artifacts")
    return {"features": feature_path, "csv": f"{out}/csv", "report": f"{out}/report.md"}


def resume(spark: SparkSession, out: str, watch_list: DataFrame | None = None) -> dict[str, str]:
    """Repeat the second half from the tables of an earlier run; counts are computed, never read from CSV."""
    for name in ("clean_metadata", "metadata_features"):
        if not partitions.exists(spark, f"{out}/tables/{name}"):
            raise FileNotFoundError(f"no {name} under {out}/tables")
    return {"clean": f"{out}/tables/clean_metadata"} | finish(spark, f"{out}/tables/metadata_features", out, watch_list=watch_list)


#: Outputs that are delivered.
DELIVERED = ("tables/clean_metadata", "tables/metadata_features", "csv/media_summary", "csv/publication_alias_audit", "csv/topic_terms", "csv/topic_counts", "csv/tone_by_decade", "csv/core_summary", "csv/partition_quality", "csv/duplicate_summary", "csv/data_dictionary", "report.md", "exploration.ipynb")


def deliver(spark: SparkSession, out: str, target: str) -> DataFrame:
    """Copy the outputs that are delivered to another folder; the run's own folder stays as it is."""
    return sinks.copied(spark, out, target, list(DELIVERED))


def validated(spark: SparkSession, feature_path: str) -> DataFrame:
    """(check, passed) of the written tables."""
    features = spark.read.parquet(feature_path)
    clean = spark.read.parquet(feature_path.replace("metadata_features", "clean_metadata"))
    n = features.count()
    groups = features.select(F.sum(F.col(duplicates.EXTRA).cast("bigint"))).first()[0] or 0
    summary = {r.duplicate_rule: r.duplicate_extra_rows for r in duplicates.duplicate_summary(features.withColumn("title", F.col("title_normalized"))).collect()}
    rows = [
        ("row counts of both tables agree", clean.count() == n),
        ("feature columns are complete", set(FEATURE_COLUMNS) <= set(features.columns)),
        ("clean columns are complete", set(CLEAN_COLUMNS) <= set(clean.columns)),
        ("only English records", features.where("language IS DISTINCT FROM 'English'").isEmpty()),
        ("extra flags add up to the extra rows", groups == summary[duplicates.CONSERVATIVE] if n else groups == 0),
    ]
    return spark.createDataFrame(rows, "check STRING, passed BOOLEAN")
