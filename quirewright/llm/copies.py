"""Duplicates hidden by formatting: an incremental ledger of canonical keys.

The ledger has a base (key, n, first) bucketed by key, and segments of the batches since. A batch is counted by key,
which is the only shuffle of its rows, and becomes a segment of the buckets it touches. When the segments have as many
rows as the base, their sums are joined with it full outer, bucket by matching bucket: counts add up, the smallest id
stays as the representative. A small batch on a large ledger thus writes itself only, and a row is rewritten about as
often as the ledger doubles.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quirewright.functions.packed import is_missing
from quirewright.operators.skew import join_groups
from quirewright.session import new_path, remove, shuffle_width, written
from quirewright.sources.sinks import write_text

def canonical(c: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def canonical_key(columns: Sequence[str]) -> Column:
    """128-bit key of the canonical values in whichever order they stand; null if one is missing or has no letter or digit.

    The values hold letters and digits only, so a separator keeps them apart; they are sorted, as fields may have
    changed places. Two different records share a key with probability 2**-128 per pair.
    """
    values = [canonical(F.col(c)) for c in columns]
    usable = ~is_missing(F.col(columns[0])) & (values[0] != "")
    for c, v in zip(columns[1:], values[1:], strict=True):
        usable = usable & ~is_missing(F.col(c)) & (v != "")
    return F.when(usable, F.unhex(F.md5(F.array_join(F.array_sort(F.array(*values)), "\x1f"))))


def _added(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two ledgers in one: a full outer join by key."""
    o, b = old.alias("o"), new.alias("b")
    return o.join(b, F.col("o.key") == F.col("b.key"), "full_outer").select(
        F.coalesce("o.key", "b.key").alias("key"),
        (F.coalesce("o.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"),
        F.least("o.first", "b.first").alias("first"),
    )


class CopyLedger:
    """Counts and earliest representatives of canonical keys, kept from batch to batch and from session to session.

    What stands under ``path`` is taken up. The state, a small file per change, names the segments, their rows and the
    batches that are in; it is written last, and what it no longer names is removed only then, so a failed change
    loses nothing. The catalog is used for the moment of a read or write only and left without any table.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path, self.change = spark, path.rstrip("/"), 0
        self.state = {"buckets": buckets or shuffle_width(spark), "base": None, "folder": "since-0", "segments": [], "batches": []}
        if names := self._listed("state"):
            self.change = int(names[-1].split(".")[0])
            self.state = json.loads(spark.read.text(f"{self.path}/state/{names[-1]}", wholetext=True).first()[0])
        for name in set(self._listed(self.state["folder"])) - {s["name"] for s in self.state["segments"]}:
            remove(spark, f"{self.path}/{self.state['folder']}/{name}")  # left by a batch that failed

    def _listed(self, folder: str) -> list[str]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n for n in names if not n.endswith(".new") and not n.startswith("."))

    def _commit(self, **changes) -> None:
        """Write the next state, then remove what it no longer names."""
        jvm, earlier, before = self.spark.sparkContext._jvm, self._listed("state"), self.state
        after, done = before | changes, f"{self.path}/state/{self.change + 1:09d}.json"
        write_text(self.spark, f"{done}.new", json.dumps(after))
        made, named = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{done}.new", done))
        if not made.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).rename(made, named):
            raise OSError(f"could not write {done}")
        self.change, self.state = self.change + 1, after
        gone = [f"state/{n}" for n in earlier]
        if after["base"] != before["base"]:
            gone += [before["folder"], *([before["base"]["name"]] if before["base"] else [])]
        for name in gone:
            remove(self.spark, f"{self.path}/{name}")

    def _read(self, name: str) -> DataFrame:
        """A folder of segments with its buckets; the table that tells Spark about them is dropped as soon as it is resolved."""
        table = f"ledger_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {table} (key BINARY, n BIGINT, first BIGINT) USING parquet OPTIONS (recursiveFileLookup 'true') "
            f"CLUSTERED BY (key) SORTED BY (key) INTO {self.state['buckets']} BUCKETS LOCATION '{self.path}/{name}'"
        )
        try:
            return self.spark.table(table)
        finally:
            self.spark.sql(f"DROP TABLE {table}")

    def _write(self, rows: DataFrame, name: str) -> int:
        """Write a segment; its number of rows."""
        table, seen = f"ledger_{uuid.uuid4().hex}", Observation()
        writer = rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("parquet").bucketBy(self.state["buckets"], "key").sortBy("key")
        writer.option("compression", "zstd").option("path", f"{self.path}/{name}").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")
        return seen.get["rows"]

    def _since(self) -> DataFrame:
        """The sums of all segments since the base."""
        rows = self._read(self.state["folder"])
        if len(self.state["segments"]) > 1:
            rows = rows.groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        return rows

    def rows(self) -> DataFrame:
        """(key, n, first), one row per key; read it before the next batch is added."""
        base, segments = self.state["base"], self.state["segments"]
        if not base:
            return self.spark.createDataFrame([], "key BINARY, n BIGINT, first BIGINT")
        return _added(self._read(base["name"]), self._since()) if segments else self._read(base["name"])

    def add(self, batch: DataFrame, label: str | None = None) -> None:
        """Add a batch (key, row_id): count it by key, write its segment, join the segments with the base if they are as large.

        Null keys are no copies of anything and are left out. A batch whose ``label`` is in already is left alone; one
        without a label counts again.
        """
        if label is not None and label in self.state["batches"]:
            return
        counted = batch.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))
        batches = [*self.state["batches"], *([label] if label is not None else [])]
        base, name = self.state["base"], uuid.uuid4().hex[:12]
        if not base:
            self._commit(base={"name": f"base-{name}", "rows": self._write(counted, f"base-{name}")}, batches=batches)
            return
        segments = [*self.state["segments"], {"name": name, "rows": self._write(counted, f"{self.state['folder']}/{name}")}]
        self._commit(segments=segments, batches=batches)
        if sum(s["rows"] for s in segments) >= base["rows"]:
            self._commit(base={"name": f"base-{name}", "rows": self._write(self.rows(), f"base-{name}")}, folder=f"since-{self.change}", segments=[])


def keyed_rows(df: DataFrame, columns: Sequence[str], id_column: str, batch_column: str) -> DataFrame:
    """(row_id, key, batch) of the rows with a canonical key, written once, one folder per batch."""
    rows = df.select(
        F.col(id_column).cast("bigint").alias("row_id"), canonical_key(columns).alias("key"), F.col(batch_column).cast("bigint").alias("batch")
    )
    return written(rows.where("key IS NOT NULL"), "keyed", ["batch"])


def ledger_of(keyed: DataFrame, path: str | None = None) -> CopyLedger:
    """The ledger after all batches of ``keyed``, one after the other: the one at ``path``, or a fresh one."""
    spark = keyed.sparkSession
    ledger = CopyLedger(spark, path or new_path(spark, "ledger"))
    for (batch,) in keyed.select("batch").distinct().orderBy("batch").collect():  # a row per load, not per record
        ledger.add(keyed.where(F.col("batch").eqNullSafe(batch)), str(batch))
    return ledger


def collapsed(df: DataFrame, columns: Sequence[str], id_column: str, batch_column: str) -> DataFrame:
    """(row_id, copies): the earliest record of each group and how many records the group has.

    Records without a usable key are not part of it. Ids are expected to be unique.
    """
    ledger = ledger_of(keyed_rows(df, columns, id_column, batch_column))
    return ledger.rows().select(F.col("first").alias("row_id"), F.col("n").alias("copies"))


def copy_links(df: DataFrame, columns: Sequence[str], id_column: str, batch_column: str) -> DataFrame:
    """(row_id_a, row_id_b): one row per further copy, with the earliest record of its group.

    A record with a null or unusable value in one of the columns is no copy. A row that is repeated with its id counts
    as another copy but gives no link to itself. Nulls in other columns, and other columns' names, do not matter.
    """
    keyed = keyed_rows(df, columns, id_column, batch_column)
    groups = written(ledger_of(keyed).rows().where("n > 1"), "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    links = join_groups(keyed.select("row_id", "key"), groups, ["key"], "n", total)
    return links.where("row_id <> first").select(F.col("first").alias("row_id_a"), F.col("row_id").alias("row_id_b"))
