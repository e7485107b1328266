"""Column profiles from maintained value counts.

``ValueCounts`` keeps, for each column and load, how often every value occurs. Each delivery adds a segment of signed,
pre-aggregated deltas (+ for rows that come, - for rows that go); the counts are the sum of all segments, and segments
of like size are merged when there are many. Every figure of a profile, the entropy included, is exact and comes from the counts:
the data are not read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirewright.functions.packed import folded, is_missing
from quirewright.session import broadcast_if_small

#: A value breaks the pattern if it holds U+FFFD or a control character but tab, CR and LF, or no letter.
BROKEN_CHARACTERS = r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F]"
_KEY = ["load_id", "column_name", "value"]
_SCHEMA = "load_id INT, column_name STRING, value STRING, n BIGINT"


def broken(value: Column) -> Column:
    return value.rlike(BROKEN_CHARACTERS) | ~value.rlike(r"\p{L}")


def value_deltas(df: DataFrame, columns: Sequence[str], load: str, sign: int = 1) -> DataFrame:
    """(load_id, column_name, value, n): ``sign`` times the count of every folded value; missing ones are one null value.

    A null load is kept as load null. Partial sums before the shuffle make a value held by a third of all rows one row
    per task.
    """
    each = F.array(
        *(F.struct(F.lit(c).alias("column_name"), F.when(~is_missing(F.col(c)), folded(F.col(c))).alias("value")) for c in columns)
    )
    rows = df.select(F.col(load).cast("int").alias("load_id"), F.inline(each))
    return rows.groupBy(*_KEY).agg((F.count(F.lit(1)) * sign).alias("n"))


class ValueCounts:
    """Persistent value counts in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, merge_at: int = 8) -> None:
        self.spark, self.path, self.merge_at = spark, path.rstrip("/"), merge_at

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def segments(self) -> list[str]:
        """Finished segments, oldest first; a half-written one has no success mark and is ignored.

        A merged segment ``a-b`` stands for the segments a to b, so those are ignored as soon as it is finished.
        """
        jvm, root, fs = self._fs()
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS"))]
        spans = sorted((int(a), int(b), n) for n in done for a, b in [n.split("-")])
        return [n for a, b, n in spans if not any((c, d) != (a, b) and c <= a and b <= d for c, d, _ in spans)]

    def apply(self, deltas: DataFrame, segment: int | None = None) -> None:
        """Add one segment of signed deltas; merge the newest ones when ``merge_at`` of them are of like size.

        So a small delivery on large counts writes itself only, and a row is rewritten a few times, however many come.

        With a ``segment`` number, which must rise from delivery to delivery, a delivery that is applied already is
        left alone, and one that was broken off is written anew.
        """
        have = self.segments()
        last = max((int(n.split("-")[1]) for n in have), default=0)
        k = last + 1 if segment is None else segment
        if k <= last:
            return
        deltas.select("load_id", "column_name", "value", F.col("n").cast("bigint").alias("n")).write.mode("overwrite").option("compression", "zstd").parquet(
            f"{self.path}/{k:09d}-{k:09d}"
        )
        names = [*have, f"{k:09d}-{k:09d}"]
        jvm, root, fs = self._fs()
        sizes = [fs.getContentSummary(jvm.org.apache.hadoop.fs.Path(root, n)).getLength() for n in names]
        like = 1  # the newest segments, back to the first that is larger than all after it
        while like < len(names) and sizes[-like - 1] <= sum(sizes[-like:]):
            like += 1
        if like >= self.merge_at:
            merged = f"{names[-like].split('-')[0]}-{k:09d}"
            self._sums(names[-like:]).where("n <> 0").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{merged}")
            for n in names[-like:]:
                fs.delete(jvm.org.apache.hadoop.fs.Path(root, n), True)

    def _sums(self, names: list[str]) -> DataFrame:
        """The signed sums of segments; negative where a withdrawal came before its addition."""
        if not names:
            return self.spark.createDataFrame([], _SCHEMA)
        rows = self.spark.read.schema(_SCHEMA).parquet(*(f"{self.path}/{n}" for n in names))
        return rows.groupBy(*_KEY).agg(F.sum("n").alias("n")) if len(names) > 1 else rows

    def counts(self) -> DataFrame:
        """(load_id, column_name, value, n) with n > 0; one row per value."""
        return self._sums(self.segments()).where("n > 0")


def profile(counts: DataFrame) -> DataFrame:
    """One row per load and column, from the counts alone.

    n_rows, n_missing, missing_share, n_distinct, distinct_ratio (per non-missing value), min_value, max_value,
    min_length, max_length, n_broken, broken_share, top_value (ties: the smallest), top_count, entropy in bits.
    Shares are null where nothing is counted.
    """
    v, n = F.col("value"), F.col("n")
    here = F.when(v.isNotNull(), n)
    out = counts.groupBy("load_id", "column_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("n_missing"),
        F.count("value").alias("n_distinct"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.min(F.length("value")).alias("min_length"),
        F.max(F.length("value")).alias("max_length"),
        F.coalesce(F.sum(F.when(broken(v), n)), F.lit(0)).alias("n_broken"),
        F.min(F.when(v.isNotNull(), F.struct((-n).alias("m"), v.alias("value")))).alias("top"),
        F.sum(here * F.log2(here)).alias("nlogn"),
    )
    present = F.nullif(F.col("n_rows") - F.col("n_missing"), F.lit(0))
    return out.select(
        "load_id",
        "column_name",
        "n_rows",
        "n_missing",
        (F.col("n_missing") / F.nullif(F.col("n_rows"), F.lit(0))).alias("missing_share"),
        "n_distinct",
        (F.col("n_distinct") / present).alias("distinct_ratio"),
        "min_value",
        "max_value",
        "min_length",
        "max_length",
        "n_broken",
        (F.col("n_broken") / present).alias("broken_share"),
        F.col("top.value").alias("top_value"),
        (-F.col("top.m")).alias("top_count"),
        (F.log2(present) - F.col("nlogn") / present).alias("entropy"),
    )


def _loads(counts: DataFrame) -> DataFrame:
    """(load_id, next_load): one row per load, without the null load."""
    loads = counts.where("load_id IS NOT NULL").select("load_id").distinct()
    return loads.select("load_id", F.lead("load_id").over(Window.orderBy("load_id")).alias("next_load"))


def shifts(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(load_id, column_name, shift): half the sum of the absolute differences of the values' shares, against the load before.

    Each value's share counts + for its own load and - for the next one, so that one aggregation gives all differences.
    Only loads that have a load before, and non-missing values in both, come out.
    """
    rows = counts.where(F.col("column_name").isin(*columns) & F.col("value").isNotNull())
    totals = rows.groupBy("load_id", "column_name").agg(F.sum("n").alias("present"))
    totals = broadcast_if_small(totals.join(_loads(counts), "load_id"))
    shares = rows.join(totals, ["load_id", "column_name"]).withColumn("share", F.col("n") / F.col("present"))
    own = shares.select("load_id", "column_name", "value", "share", F.lit(1).alias("side"))
    before = shares.where("next_load IS NOT NULL").select(
        F.col("next_load").alias("load_id"), "column_name", "value", (-F.col("share")).alias("share"), F.lit(2).alias("side")
    )
    per_value = own.union(before).groupBy("load_id", "column_name", "value").agg(
        F.abs(F.sum("share")).alias("gap"), F.bit_or("side").alias("sides")
    )
    per_column = per_value.groupBy("load_id", "column_name").agg((F.sum("gap") / 2).alias("shift"), F.bit_or("sides").alias("sides"))
    return per_column.where("sides = 3").select("load_id", "column_name", "shift")


def compared(counts: DataFrame, shift_columns: Sequence[str] = ()) -> DataFrame:
    """The profile with the figures of the load before (``*_before``) and the shift."""
    before = Window.partitionBy("column_name").orderBy("load_id")
    out = profile(counts)
    for c in ("n_rows", "missing_share", "distinct_ratio", "entropy"):
        out = out.withColumn(f"{c}_before", F.when(F.col("load_id").isNotNull(), F.lag(c).over(before)))
    if shift_columns:
        out = out.join(shifts(counts, shift_columns), ["load_id", "column_name"], "left")
    return out


def findings(
    counts: DataFrame,
    shift_columns: Sequence[str] = (),
    pattern_share: float = 0.05,
    missing_gap: float = 0.10,
    distinct_factor: float = 0.5,
    shift_limit: float = 0.25,
) -> DataFrame:
    """(load_id, column_name, finding): pattern, missing, distinct and shift, one row each; an undefined figure finds nothing."""
    c = compared(counts, shift_columns)
    rules = {
        "pattern": F.col("broken_share") > pattern_share,
        "missing": F.abs(F.col("missing_share") - F.col("missing_share_before")) > missing_gap,
        "distinct": F.col("distinct_ratio") < distinct_factor * F.col("distinct_ratio_before"),
    }
    if shift_columns:
        rules["shift"] = F.col("shift") > shift_limit
    found = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return c.select("load_id", "column_name", F.explode(found).alias("finding"))
