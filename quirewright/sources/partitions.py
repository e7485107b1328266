"""Raw partitions: folders with a ``master.csv`` and zipped side files, and their checks against a manifest."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewright.operators.prepare import renamed_source
from quirewright.schema import RAW_COLUMNS, SOURCE_COLUMNS

MASTER = "master.csv"
SIDE_FILES = {"extended": "extended.csv.zip", "citation": "citation.csv.zip"}


@dataclass(frozen=True)
class Partition:
    """A raw partition: its name, folder, CSV file and the number of rows the manifest expects, if it is listed."""

    name: str
    path: str
    master_path: str
    expected_rows: int | None


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _fs(spark, path)
    return fs.exists(p)


def read_manifest(spark: SparkSession, *paths: str) -> dict[str, int]:
    """dataset name -> document count of the first manifest file that exists; empty if none does."""
    for path in paths:
        if exists(spark, path):
            rows = spark.read.csv(path, header=True).select("dataset_name", F.col("document_count").cast("bigint")).collect()
            return {r[0]: r[1] for r in rows if r[1] is not None}
    return {}


def discover(spark: SparkSession, root: str, manifest: dict[str, int] | None = None, names: dict[str, str] | None = None) -> list[Partition]:
    """Folders of ``root`` by name, hidden ones left out, that have a master file; raises if the root or all are absent.

    ``names`` maps folder names to the names used in the manifest, where they differ.
    """
    jvm, p, fs = _fs(spark, root)
    if not fs.exists(p):
        raise FileNotFoundError(f"no raw folder {root}")
    found = []
    for s in sorted(fs.listStatus(p), key=lambda s: s.getPath().getName()):
        name = s.getPath().getName()
        master = f"{root.rstrip('/')}/{name}/{MASTER}"
        if s.isDirectory() and not name.startswith(".") and fs.exists(jvm.org.apache.hadoop.fs.Path(master)):
            found.append(Partition(name, f"{root.rstrip('/')}/{name}", master, (manifest or {}).get((names or {}).get(name, name))))
    if not found:
        raise FileNotFoundError(f"no partition with a {MASTER} under {root}")
    return found


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file as text: header, quotes doubled, line breaks inside quotes, no inference."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)


def scan_partition(spark: SparkSession, part: Partition, columns: list[str] | None = None) -> DataFrame:
    """The required columns by name, with source_partition and the position ``row_id`` in the file.

    A multi-line file is one split, so the ids rise in file order; the rows are spread only after they are numbered.
    """
    raw = scan_csv(spark, part.master_path).withColumn("source_partition", F.lit(part.name)).withColumn("row_id", F.monotonically_increasing_id())
    rows = renamed_source(raw, f"partition {part.name}")
    return rows.select("source_partition", "row_id", *(columns or [c for c in rows.columns if c not in ("source_partition", "row_id")]))


def scan(spark: SparkSession, parts: list[Partition], columns: list[str] | None = None) -> DataFrame:
    """All partitions as one bag."""
    first, *rest = (scan_partition(spark, p, columns) for p in parts)
    for r in rest:
        first = first.unionByName(r)
    return first


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """The word table of a CSV file with a number per category; see ``operators.sentiment.lexicon_members``."""
    return scan_csv(spark, path)


def write_raw(records: DataFrame, root: str) -> None:
    """Raw partitions from a table with the text columns and source_partition: ``{root}/{partition}/master.csv``.

    One pass; the records of a partition are written by one task, in the order of ``row_id``, as a raw file is one file.
    """
    spark = records.sparkSession
    named = records.select("row_id", "source_partition", *(F.col(c).alias(raw) for raw, c in SOURCE_COLUMNS.items()))
    rows = named.repartition("source_partition").sortWithinPartitions("source_partition", "row_id").drop("row_id")
    rows.write.partitionBy("source_partition").csv(f"{root}/.written", header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    jvm, p, fs = _fs(spark, f"{root}/.written")
    for folder in fs.listStatus(p):
        name = folder.getPath().getName()
        if folder.isDirectory() and "=" in name:
            target = jvm.org.apache.hadoop.fs.Path(f"{root}/{unquote(name.split('=', 1)[1])}")
            fs.mkdirs(target)
            for part in fs.listStatus(folder.getPath()):
                if part.getPath().getName().endswith(".csv"):
                    fs.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(target, MASTER))
    fs.delete(p, True)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Newline bytes less one, and the header, of plain and zipped CSV files, read in pieces."""
    for b in batches:
        out = []
        for path, content in zip(b["path"], b["content"], strict=True):
            source, zipped = io.BytesIO(content), path.endswith(".zip")
            archive = zipfile.ZipFile(source) if zipped else None
            open_ = (lambda a=archive: a.open(next(n for n in a.namelist() if n.endswith(".csv")))) if zipped else (lambda s=content: io.BytesIO(s))
            lines = 0
            with open_() as f:
                while piece := f.read(1 << 20):
                    lines += piece.count(b"\n")
            with open_() as f:
                header = next(csv.reader(io.TextIOWrapper(f, "utf-8", errors="replace", newline="")), [])
            out.append((path, max(lines - 1, 0), header))
        yield pd.DataFrame(out, columns=["path", "physical_rows", "header"])


def file_facts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, physical_rows, header) of CSV files and of the first CSV member of zip files.

    Physical rows are line breaks less one: a quoted line break counts, a missing last one does not. Files are read
    whole on the executors, one task each.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(_counted, "path STRING, physical_rows BIGINT, header ARRAY<STRING>")


class _Pieces(io.RawIOBase):
    """A file of the Hadoop file system, fetched piece by piece."""

    def __init__(self, stream) -> None:
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        piece = bytes(self.stream.readNBytes(len(into)))
        into[: len(piece)] = piece
        return len(piece)


def _ends(spark: SparkSession, path: str) -> tuple[list[str], bool]:
    """The header of a plain file, and whether bytes follow its last line break; reads the two ends only."""
    _, p, fs = _fs(spark, path)
    size, stream = fs.getFileStatus(p).getLen(), fs.open(p)
    try:
        header = next(csv.reader(io.TextIOWrapper(io.BufferedReader(_Pieces(stream), 1 << 16), "utf-8", errors="replace", newline="")), [])
        if size:
            stream.seek(size - 1)
        return header, bool(size) and bytes(stream.readNBytes(1)) != b"\n"
    finally:
        stream.close()


def plain_facts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same for plain files of any size: line breaks are counted by Spark's text reader, in splits.

    Of a file only its header and its last byte reach the driver.
    """
    ends = [(path, *_ends(spark, path)) for path in paths]
    parts = [
        spark.read.text(path, lineSep="\n").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(path).alias("path"),
            F.greatest(F.col("n") - int(open_) - 1, F.lit(0)).cast("bigint").alias("physical_rows"),
            F.array(*map(F.lit, header)).cast("array<string>").alias("header"),
        )
        for path, header, open_ in ends
    ]
    return reduce(DataFrame.unionByName, parts)


def inspected(spark: SparkSession, parts: list[Partition]) -> DataFrame:
    """One row per partition: row counts of the master, manifest and side files, whether they agree, and widths.

    A count that is absent agrees with nothing; a partition without a manifest row is a mismatch.
    """
    wanted = [(p.name, kind, f"{p.path}/{f}") for p in parts for kind, f in (("master", MASTER), *SIDE_FILES.items())]
    wanted = [w for w in wanted if exists(spark, w[2])]
    places = spark.createDataFrame([(n, k, "/".join(f.rsplit("/", 2)[-2:])) for n, k, f in wanted], "source_partition STRING, kind STRING, tail STRING")
    tail = F.concat_ws("/", F.slice(F.split("path", "/"), -2, 2))
    found = plain_facts(spark, [f for _, k, f in wanted if k == "master"])
    if zips := [f for _, k, f in wanted if k != "master"]:
        found = found.unionByName(file_facts(spark, zips))
    facts = found.withColumn("tail", tail).join(F.broadcast(places), "tail")
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = facts.groupBy("source_partition").agg(
        *(of(k, "physical_rows").alias(f"{k}_rows") for k in ("master", "extended", "citation")),
        *(F.size(of(k, "header")).alias(f"{k}_columns") for k in ("master", "extended", "citation")),
        (of("master", "header") == F.array(*map(F.lit, RAW_COLUMNS))).alias("schema_matches"),
    )
    expected = spark.createDataFrame([(p.name, p.expected_rows) for p in parts], "source_partition STRING, manifest_rows BIGINT")
    out = expected.join(wide, "source_partition", "left")
    agrees = lambda c: F.coalesce(F.col("master_rows") == F.col(c), F.lit(False)).alias(f"{c}_match")
    return out.select("*", *(agrees(c) for c in ("manifest_rows", "extended_rows", "citation_rows")))


def mismatches(validation: DataFrame) -> DataFrame:
    """Partitions of which some check fails; an absent check fails."""
    checks = [c for c in validation.columns if c.endswith("_match") or c == "schema_matches"]
    good = F.lit(True)
    for c in checks:
        good = good & F.coalesce(F.col(c), F.lit(False))
    return validation.where(~good)


def manifest_check(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Records of each partition and load against the manifest: (dataset_name, load_id, document_count, records, matches)."""
    have = records.groupBy(F.col("source_partition").alias("dataset_name"), "load_id").agg(F.count(F.lit(1)).alias("records"))
    out = have.join(manifest.select("dataset_name", "load_id", "document_count"), ["dataset_name", "load_id"], "full")
    return out.select("dataset_name", "load_id", "document_count", "records", F.coalesce(F.col("document_count") == F.col("records"), F.lit(False)).alias("matches"))
