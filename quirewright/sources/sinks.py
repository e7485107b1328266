"""Sinks: compressed Parquet, sorted CSV tables, rewriting in place, a Markdown report and an artifact list."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewright.schema import CLEAN_COLUMNS, FEATURE_COLUMNS, LEXICON_CATEGORIES, SOURCE_COLUMNS
from quirewright.session import remove


def write_parquet(df: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns, zstd-compressed; an existing table is replaced."""
    df.select(*columns).write.mode("overwrite").option("compression", "zstd").parquet(path)


def rewrite(spark: SparkSession, path: str, change) -> None:
    """Replace the Parquet table at ``path`` by ``change(table)``: written beside it, then swapped by renaming.

    If the new table cannot take its place, the old one is put back; a crash in between leaves both beside the path.
    """
    jvm = spark.sparkContext._jvm
    new, old = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    change(spark.read.parquet(path)).write.option("compression", "zstd").parquet(new)
    at, made, kept = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, old))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(at, kept):
        raise OSError(f"could not set {path} aside; the new table is {new}")
    if not fs.rename(made, at):
        restored = fs.rename(kept, at)
        raise OSError(f"could not swap {path}; the new table is {new}" + ("" if restored else f", the old one {old}"))
    remove(spark, old)
    spark.catalog.refreshByPath(path)


def write_counts(counts: DataFrame, path: str, name: str, limit: int | None = None) -> None:
    """(value, documents) as a CSV table, most frequent first, ties by value; the first ``limit`` rows."""
    rows = counts.select(F.col("value").alias(name), "documents").orderBy(F.desc("documents"), name)
    write_csv(rows.limit(limit) if limit else rows, path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def markdown(df: DataFrame, limit: int = 25) -> str:
    """The first rows of a summary as a Markdown table."""
    rows = df.limit(limit).collect()
    text = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *([text(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def report(title: str, sections: dict[str, str | DataFrame | tuple[str, DataFrame | None]]) -> str:
    """A Markdown text: each section holds words, a table, or words and a table (none if there is nothing to show)."""
    parts = [f"# {title}"]
    for name, body in sections.items():
        words, df = body if isinstance(body, tuple) else (body, None) if isinstance(body, str) else ("", body)
        parts += [p for p in (f"## {name}", words, markdown(df) if df is not None else "") if p]
    return "\n\n".join(parts) + "\n"


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, modified) of every file under ``root``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    rows = []
    while files.hasNext():
        f = files.next()
        rows.append((f.getPath().toString(), f.getLen(), datetime.fromtimestamp(f.getModificationTime() / 1000, UTC).isoformat()))
    return spark.createDataFrame(rows, "path STRING, bytes BIGINT, modified STRING")


def copied(spark: SparkSession, source: str, target: str, names: list[str]) -> DataFrame:
    """Copy the named outputs of ``source`` that exist to ``target``; (name, copied). Nothing is moved or removed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for name in names:
        a, b = jvm.org.apache.hadoop.fs.Path(f"{source}/{name}"), jvm.org.apache.hadoop.fs.Path(f"{target}/{name}")
        there = a.getFileSystem(conf).exists(a)
        rows.append((name, there and jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)))
    return spark.createDataFrame(rows, "name STRING, copied BOOLEAN")


#: What the output tables hold, and their derived columns; source columns are described by the name they have in the raw files.
TABLES = {
    "clean_metadata": "English records: the source columns and the columns derived from one record alone.",
    "metadata_features": "English records: normalised names, duplicate flags, word-category scores and topics.",
}
COLUMNS = {
    "source_partition": "Raw partition that delivered the record.",
    "partition_family": "Family of the partition, read from its name.",
    "publication_date": "Date of publication as read from the date text; empty where that is no date.",
    "year": "Year of publication_date.",
    "decade": "First year of its decade.",
    "publisher_city_normalized": "City of the publisher, in title case, known spellings made one.",
    "publisher_province_normalized": "State or province as written in capitals, or the one a city's spelling tells.",
    "publisher_region": "Country group of the publisher's place; a note for review where it is unknown.",
    "publisher_location_normalized": "City and province together.",
    "primary_author": "First author of the list.",
    "author_count": "Authors in the list.",
    "subject_term_count": "Subject terms in the list.",
    "class_term_count": "Class terms in the list.",
    "company_count": "Companies in the list.",
    "pages_numeric": "Pages as a number; empty where the text is none.",
    "title_normalized": "Words of the title in lower case.",
    "publication_title_normalized": "Name key of the publication.",
    "publication_title_canonical": "Representative of the names merged with it.",
    "publication_title_display": "Name of the publication as written, without brackets and article.",
    "duplicate_goid": "The identifier stands in other records too.",
    "duplicate_exact_title_date_publication": "Title, date and publication stand in other records, letter for letter.",
    "duplicate_normalized_title_date_publication": "The same of their normalised forms.",
    "duplicate_title_date": "Normalised title and date stand in other records.",
    "is_conservative_duplicate_extra": "Every record after the first of a normalised title, date and publication.",
    "lm_token_count": "Words in title and terms.",
    "lm_net_tone": "Positive less negative words, per word.",
    "topic_id": "Heaviest topic of title and terms; -1 without text.",
    "topic_label": "Its five heaviest terms.",
    "topic_weight": "Its weight.",
    "title_only_topic_id": "Heaviest topic of the title alone.",
    "title_only_topic_label": "Its five heaviest terms.",
    "title_only_topic_weight": "Its weight.",
}


def _described(column: str) -> str:
    raw = {c: name for name, c in SOURCE_COLUMNS.items()}
    if column in raw:
        return f"Source column {raw[column]!r}, as text."
    for c in LEXICON_CATEGORIES:
        if column in (f"lm_{c}", f"lm_{c}_rate"):
            return f"Words of the category {c} in title and terms" + (", per word." if column.endswith("_rate") else ".")
    return COLUMNS[column]


def data_dictionary(spark: SparkSession) -> DataFrame:
    """(table_name, field, description): a row per table, with an empty field, and one per column of it."""
    rows = []
    for table, columns in zip(TABLES, (CLEAN_COLUMNS, FEATURE_COLUMNS), strict=True):
        rows += [(table, "", TABLES[table]), *((table, c, _described(c)) for c in columns)]
    return spark.createDataFrame(rows, "table_name STRING, field STRING, description STRING")
