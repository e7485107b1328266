"""Queries of the metadata operators over the table ``master`` and its companions, with DuckDB SQL beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewright.functions import text as tx
from quirewright.operators import duplicates, profiling, resolve, sampling, sentiment, summaries, topics
from quirewright.operators.prepare import prepared
from quirewright.plans.pipeline import FACETS, Settings
from quirewright.schema import CLEAN_COLUMNS, LEXICON_CATEGORIES
from quirewright.session import new_path, written
from quirewright.sources import partitions
from quirewright.sources.tables import table

SETTINGS = Settings()


def records(spark: SparkSession, folder: str, language: str | None = None) -> DataFrame:
    """``master`` under the standard column names, with all derived columns."""
    master = table(spark, folder, "master").withColumnsRenamed({"date_text": "date", "language_name": "language"})
    return prepared(master, language)


def english_records(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder, "English")


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def clean_keys(spark, folder):
    rows = table(spark, folder, "master")
    return rows.select("row_id", tx.clean(F.col("title")).alias("title_clean"), tx.key(F.col("title")).alias("title_normalized"))


def publication_names(spark, folder):
    return records(spark, folder).select("row_id", "publication_title_normalized", "publication_title_display")


def canonical_terms(spark, folder):
    items = records(spark, folder).select("row_id", F.posexplode("subject_items").alias("pos", "term"))
    return items.select("row_id", "pos", tx.canonical_term(F.col("term")).alias("term"), tx.title_case(F.col("term")).alias("title_cased"))


def list_fields(spark, folder):
    return records(spark, folder).select(
        "row_id",
        "primary_author",
        *(F.col(c).cast("int").alias(c) for c in ("author_count", "subject_term_count", "class_term_count", "company_count")),
    )


def metadata_texts(spark, folder):
    return records(spark, folder).select("row_id", "metadata_text", F.size(tx.tokens(F.col("metadata_text"))).alias("n_tokens"), "partition_family")


def name_anchor_sets(spark, folder):
    names = records(spark, folder).select("publication_title_normalized").distinct()
    name = F.col("publication_title_normalized")
    return names.select(name, tx.joined_set(tx.name_tokens(name)).alias("tokens"), tx.joined_set(tx.name_anchors(name)).alias("anchors"))


def publisher_locations(spark, folder):
    columns = ("publisher_city_normalized", "publisher_province_normalized", "publisher_region", "publisher_location_normalized")
    return records(spark, folder).select("row_id", *columns)


def dates_and_pages(spark, folder):
    return records(spark, folder).select("row_id", "publication_date", "year", "decade", "pages_numeric")


def clean_table(spark, folder):
    """The 46 columns of the clean table, English records."""
    return english_records(spark, folder).select("row_id", *CLEAN_COLUMNS)


def missing_profile(spark, folder):
    return rounded(profiling.missing_profile(records(spark, folder)))


def row_counts(spark, folder):
    return profiling.row_counts(records(spark, folder))


def raw_partitions(spark: SparkSession, folder: str) -> list[partitions.Partition]:
    """``master`` written as raw partitions, with the rows that the manifest expects."""
    root = new_path(spark, "raw")
    master = table(spark, folder, "master").withColumnsRenamed({"date_text": "date", "language_name": "language"})
    partitions.write_raw(master, root)
    expected = table(spark, folder, "manifest").groupBy("dataset_name").agg(F.sum("document_count")).collect()  # a row per partition
    return partitions.discover(spark, root, dict(map(tuple, expected)))


def file_validation(spark, folder):
    """The raw files against the manifest: physical rows, widths and headers."""
    checked = partitions.inspected(spark, raw_partitions(spark, folder))
    return checked.select("source_partition", "manifest_rows", "master_rows", "master_columns", "schema_matches", "manifest_rows_match", "extended_rows_match")


def scanned_partitions(spark, folder):
    """Records, titles and ids of each raw partition, read back from its CSV file."""
    scanned = partitions.scan(spark, raw_partitions(spark, folder), ["goid", "title", "subject_terms"])
    return scanned.groupBy("source_partition").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("goid").alias("goids"), F.count_distinct("title").alias("titles"), F.count_distinct("subject_terms").alias("subjects")
    )


def topic_share_by_decade(spark, folder):
    """Topics by every decade that occurs, each cell as a share of its decade."""
    return rounded(summaries.pivot_shares(topic_by_decade(spark, folder), "topic_label", "decade", None, "share"))


def usable_fields(spark, folder):
    return rounded(profiling.usable_fields(profiling.missing_profile(records(spark, folder))))


def date_bounds(spark, folder):
    return profiling.date_bounds(records(spark, folder))


def partition_quality(spark, folder):
    return rounded(profiling.partition_quality(records(spark, folder)))


def manifest_check(spark, folder):
    return partitions.manifest_check(table(spark, folder, "master"), table(spark, folder, "manifest"))


def partition_quality_checked(spark, folder):
    """Partition quality with the manifest's verdict joined."""
    checks = manifest_check(spark, folder).groupBy(F.col("dataset_name").alias("source_partition"))
    validation = checks.agg(F.sum("document_count").alias("manifest_rows"), F.count_if(~F.col("matches")).alias("loads_off"))
    return rounded(profiling.partition_quality(records(spark, folder), validation))


def frequencies_all(spark, folder):
    return profiling.all_row_frequencies(records(spark, folder))


def frequencies_english(spark, folder):
    return profiling.english_frequencies(english_records(spark, folder))


def final_counts(spark, folder):
    return profiling.final_counts(english_records(spark, folder))


def term_frequencies(spark, folder):
    return profiling.term_frequencies(english_records(spark, folder))


def top_subject_terms(spark, folder):
    counts = profiling.term_frequencies(english_records(spark, folder)).where("dimension = 'subject_terms'")
    return profiling.most_frequent(counts, 1000).select("value", "documents")


def page_statistics(spark, folder):
    return rounded(profiling.page_statistics(english_records(spark, folder)), 6)


def core_summary(spark, folder):
    """Sizes, bounds and counts, the rows of the topic sample and the source of the lexicon."""
    english = english_records(spark, folder).select("row_id", "decade", "source_type", "metadata_text")
    return profiling.core_summary(records(spark, folder), topic_strata(english), "lexicon.parquet")


def coverage_metrics(spark, folder):
    return profiling.coverage_metrics(records(spark, folder))


def author_coverage(spark, folder):
    return rounded(profiling.author_coverage(english_records(spark, folder)))


def author_coverage_by_source(spark, folder):
    return rounded(profiling.author_coverage(english_records(spark, folder), "source_type"))


def author_coverage_since_2000(spark, folder):
    return rounded(profiling.coverage_since(profiling.author_coverage(english_records(spark, folder), "source_type")))


def metadata_depth(spark, folder):
    return rounded(profiling.metadata_depth(english_records(spark, folder)), 6)


def duplicate_summary(spark, folder):
    return rounded(duplicates.duplicate_summary(english_records(spark, folder)))


def duplicate_flags(spark, folder):
    rows = english_records(spark, folder)
    narrow = rows.select("source_partition", "row_id", *dict.fromkeys(c for r in duplicates.RULES.values() for c in r))
    flagged = duplicates.duplicate_flags(narrow, ["source_partition", "row_id"])
    return flagged.select("row_id", *duplicates.RULES, duplicates.EXTRA)


def stratum_sizes(spark, folder):
    """Sizes of a sample of at most 1200 records per decade and source type."""
    rows = sampling.long_enough(english_records(spark, folder), "metadata_text", 5)
    sample = sampling.stratified(rows.select("row_id", "decade", "source_type"), ["decade", "source_type"], "row_id", 1200)
    return summaries.group_counts(sample, "decade", "source_type")


def capped_sample(spark, folder):
    """A sample of 15,000 records with equal caps per stratum."""
    rows = sampling.long_enough(english_records(spark, folder), "metadata_text", 10).where("decade IS NOT NULL")
    return sampling.capped(rows.select("row_id", "decade", "source_type", "partition_family"), FACETS, "row_id", 15_000)


def lexicon_lookup(spark, folder):
    lookup = sentiment.category_lookup(sentiment.lexicon_members(table(spark, folder, "lexicon")))
    return lookup.select("word", F.array_join("categories", ",").alias("categories"))


def scored_records(spark: SparkSession, folder: str) -> DataFrame:
    members = sentiment.lexicon_members(table(spark, folder, "lexicon"))
    rows = english_records(spark, folder).select("row_id", "year", "decade", "source_type", "partition_family", "metadata_text")
    return sentiment.scores(rows, "metadata_text", members)


def lexicon_scores(spark, folder):
    names = [f"lm_{c}" for c in LEXICON_CATEGORIES]
    return rounded(scored_records(spark, folder).select("row_id", "lm_token_count", *names, *(f"{n}_rate" for n in names), "lm_net_tone"))


def tone_by_decade_and_source(spark, folder):
    return rounded(sentiment.tone_by_decade_and_source(scored_records(spark, folder)))


def tone_by_decade(spark, folder):
    return rounded(sentiment.tone_by_decade(scored_records(spark, folder)))


def sampled_tone(spark, folder):
    """Tone by decade of the records of a sample of 1200 per stratum."""
    scored = scored_records(spark, folder).where("decade IS NOT NULL")
    return rounded(sentiment.tone_by_decade(sampling.stratified(scored, ["decade", "source_type"], "row_id", 1200)))


def tone_anova(spark, folder):
    rows = scored_records(spark, folder).where("year >= 2000 AND lm_token_count > 0")
    return rounded(summaries.anova(rows, "source_type", "lm_net_tone"), 7)


def tone_group_statistics(spark, folder):
    rows = scored_records(spark, folder).where("year >= 2000 AND lm_token_count > 0")
    return rounded(summaries.group_statistics(rows, "source_type", "lm_net_tone"))


def pages_anova(spark, folder):
    return rounded(summaries.anova(english_records(spark, folder), "object_type", "pages_numeric"), 4)


def group_sizes(spark, folder):
    rows = sampling.long_enough(english_records(spark, folder), "metadata_text", 10)
    return sentiment.group_sizes(rows, FACETS)


def group_terms(spark, folder):
    rows = sampling.long_enough(english_records(spark, folder), "metadata_text", 10)
    return sentiment.group_terms(rows, "metadata_text", FACETS, 120)


def group_lexicon_totals(spark, folder):
    rows = sampling.long_enough(english_records(spark, folder), "metadata_text", 10)
    return sentiment.group_lexicon_totals(rows, "metadata_text", FACETS, sentiment.lexicon_members(table(spark, folder, "lexicon")))


def object_type_by_decade_share(spark, folder):
    """Object types by every decade that occurs, each cell as a share of its decade."""
    rows = english_records(spark, folder).withColumn("object_type", F.coalesce("object_type", F.lit("<missing>")))
    return rounded(summaries.pivot_shares(summaries.group_counts(rows, "object_type", "decade"), "object_type", "decade", None, "share"))


def media_summary(spark, folder):
    return rounded(summaries.media_summary(english_records(spark, folder)))


def publication_examples(spark, folder):
    return summaries.publication_examples(english_records(spark, folder))


def media_of(spark: SparkSession, folder: str) -> DataFrame:
    return written(summaries.media_summary(english_records(spark, folder)), "media")


def alias_pairs(spark, folder):
    """The word features and flags of every pair that the ladder can accept."""
    pairs = resolve.compared_names(resolve.candidate_pairs(media_of(spark, folder)), F.lit(0.0))
    columns = ("shared_anchor_tokens", "left_only_anchor_tokens", "right_only_anchor_tokens", "same_anchor_tokens", "shared_publication_id", "shared_top_publisher")
    return rounded(pairs.select("left", "right", "token_overlap", *columns))


def alias_audit(spark, folder):
    return rounded(resolve.alias_audit(media_of(spark, folder)))


def word_audit(media: DataFrame) -> DataFrame:
    """The outcome of the ladder for every candidate pair as if all characters agreed: what words and metadata alone decide."""
    return resolve.compared_names(resolve.candidate_pairs(media), F.lit(1.0)).withColumnsRenamed({"left": "publication_left", "right": "publication_right"})


def alias_decisions(spark, folder):
    return word_audit(media_of(spark, folder)).select("publication_left", "publication_right", "recommendation", "auto_merge", "needs_review")


def canonical_names_by_words(spark, folder):
    media = media_of(spark, folder)
    return resolve.canonical_map(media, word_audit(media))


def canonical_rollup_by_words(spark, folder):
    media = media_of(spark, folder)
    return summaries.canonical_rollup(media, resolve.canonical_map(media, word_audit(media)))


def canonical_media_by_words(spark, folder):
    """The media summary by the canonical names that words alone decide."""
    media = media_of(spark, folder)
    mapping = written(resolve.canonical_map(media, word_audit(media)), "canonical")
    return rounded(summaries.media_summary(resolve.canonicalised(english_records(spark, folder), mapping)))


def canonical_names(spark, folder):
    media = media_of(spark, folder)
    return resolve.canonical_map(media, resolve.alias_audit(media))


def canonical_components(spark, folder):
    """Publications joined when they share a publisher and a publication id: components of a larger graph."""
    rows = english_records(spark, folder).where("publication_id IS NOT NULL").select("publication_id", F.col("publication_title_normalized").alias("name")).distinct()
    first = rows.groupBy("publication_id").agg(F.min("name").alias("first"))
    edges = rows.join(first, "publication_id").where("name <> first").select(F.col("first").alias("src"), F.col("name").alias("dst"))
    return resolve.components(rows.select(F.col("name").alias("node")).distinct(), edges)


def canonical_media(spark, folder):
    """The media summary by canonical name: the second pass over the records."""
    media = media_of(spark, folder)
    mapping = written(resolve.canonical_map(media, resolve.alias_audit(media)), "canonical")
    return rounded(summaries.media_summary(resolve.canonicalised(english_records(spark, folder), mapping)))


def canonical_rollup(spark, folder):
    media = media_of(spark, folder)
    return summaries.canonical_rollup(media, resolve.canonical_map(media, resolve.alias_audit(media)))


def watched_publications(spark, folder):
    return resolve.watched(media_of(spark, folder), table(spark, folder, "watch_list"))


def unobserved_publications(spark, folder):
    return resolve.expected_but_unobserved(media_of(spark, folder), table(spark, folder, "watch_list"))


def topic_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = english_records(spark, folder).select("row_id", "decade", "source_type", "partition_family", "title", "metadata_text")
    return written(rows, "topic_rows")  # read for the vocabulary, the sample and the assignment


def topic_strata(rows: DataFrame) -> DataFrame:
    some = sampling.long_enough(rows, "metadata_text", 5)
    return sampling.stratified(some, ["decade", "source_type"], "row_id", SETTINGS.per_stratum)


def topic_sample(rows: DataFrame) -> DataFrame:
    return written(topic_strata(rows), "topic_sample")


def tfidf_vectors(spark, folder):
    """(row_id, term, weight) of every English record: words and pairs that 10 records and at most 65% hold."""
    return rounded(topics.exact_vectors(english_records(spark, folder), "metadata_text", ["row_id"]), 7)


def _fitted(rows: DataFrame):
    """Vocabulary and document frequencies of all English records, factors of the sample."""
    v = topics.fit_vectorizer(rows, "metadata_text", SETTINGS.features, SETTINGS.min_df, stop_words=SETTINGS.stop_words)
    vectors = v.transform(topic_sample(rows), "metadata_text")
    return v, topics.fit_topics(vectors, v.terms, SETTINGS.n_topics, SETTINGS.rounds)


def nmf_topic_terms(spark, folder):
    return topics.topic_terms(spark, _fitted(topic_rows(spark, folder))[1])


def nmf_topics(spark, folder):
    """Topics of every English record, by title and terms and by title alone."""
    rows = topic_rows(spark, folder)
    v, model = _fitted(rows)
    return topics.assign(topics.assign(rows, "metadata_text", v, model), "title", v, model, "title_only_").drop("title", "metadata_text", "partition_family")


def topic_counts(spark, folder):
    return summaries.group_counts(nmf_topics(spark, folder), "topic_id", "topic_label")


def topic_by_decade(spark, folder):
    return summaries.group_counts(nmf_topics(spark, folder), "decade", "topic_id", "topic_label")


def topic_by_source_type(spark, folder):
    return summaries.group_counts(nmf_topics(spark, folder), "source_type", "topic_id", "topic_label")


def topic_totals(spark, folder):
    """By decade and source type, the documents and how many of them have a topic by terms and by title: none is lost."""
    rows = nmf_topics(spark, folder).withColumn("source_type", F.coalesce("source_type", F.lit("<missing>")))
    has = lambda c: F.count_if(F.col(c) >= 0)
    return rows.groupBy("decade", "source_type").agg(
        F.count(F.lit(1)).alias("documents"), has("topic_id").alias("with_topic"), has("title_only_topic_id").alias("with_title_topic")
    )


def notebook_topic_terms(spark, folder):
    """The smaller model of the exploration: 10 topics over 5000 terms held by 8 records, on the capped sample."""
    rows = topic_rows(spark, folder)
    some = sampling.long_enough(rows, "metadata_text", 10).where("decade IS NOT NULL AND source_type IS NOT NULL")
    sample = written(sampling.capped(some, FACETS, "row_id", 15_000), "capped_sample")
    v = topics.fit_vectorizer(rows, "metadata_text", 5000, 8, stop_words=SETTINGS.stop_words)
    return topics.topic_terms(spark, topics.fit_topics(v.transform(sample, "metadata_text"), v.terms, 10, SETTINGS.rounds), 10)


def lda_topics(spark, folder):
    rows = topic_rows(spark, folder)
    return topics.lda_topics(topic_sample(rows), "metadata_text", corpus=rows)


QUERIES = {
    f.__name__: f
    for f in (
        clean_keys, publication_names, canonical_terms, list_fields, metadata_texts, name_anchor_sets, publisher_locations,
        dates_and_pages, clean_table, missing_profile, row_counts, usable_fields, date_bounds, partition_quality, manifest_check,
        partition_quality_checked, file_validation, scanned_partitions, frequencies_all, frequencies_english, final_counts, term_frequencies, top_subject_terms,
        page_statistics, core_summary, coverage_metrics, author_coverage, author_coverage_by_source,
        author_coverage_since_2000, metadata_depth, duplicate_summary, duplicate_flags, stratum_sizes, capped_sample,
        lexicon_lookup, lexicon_scores, tone_by_decade_and_source, tone_by_decade, sampled_tone, tone_anova,
        tone_group_statistics, pages_anova, group_sizes, group_terms, group_lexicon_totals, object_type_by_decade_share,
        media_summary, publication_examples, alias_pairs, alias_decisions, canonical_names_by_words, canonical_rollup_by_words, canonical_media_by_words,
        alias_audit, canonical_names, canonical_components, canonical_media,
        canonical_rollup, watched_publications, unobserved_publications, tfidf_vectors, nmf_topic_terms, nmf_topics,
        topic_counts, topic_by_decade, topic_by_source_type, topic_share_by_decade, topic_totals, notebook_topic_terms, lda_topics,
    )
}
