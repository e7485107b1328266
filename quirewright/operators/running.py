"""Running sums over a total order, spread over all executors."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirewright.session import broadcast_if_small, shuffle_width, written


def _scan(n_groups: int, value: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, held, so_far = TaskContext.get().partitionId(), None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for g in range(n_groups):
                c = b.column(g)
                new[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
            head = tuple(b.column(g)[0].as_py() for g in range(n_groups))
            base = so_far if held == head else 0
            new[0] = False
            total = np.cumsum(b.column(value).to_numpy(zero_copy_only=False))
            starts = np.flatnonzero(new)
            before = np.zeros(n, total.dtype)
            before[starts] = total[starts - 1]
            before = np.maximum.accumulate(before)
            local = total - before
            local[: starts[0] if len(starts) else n] += base
            held, so_far = tuple(b.column(g)[n - 1].as_py() for g in range(n_groups)), int(local[-1])
            yield pa.record_batch([*b.columns, pa.array(np.full(n, part), pa.int32()), pa.array(local, pa.int64())], names=[*b.schema.names, "_part", "_local"])

    return run


def running_sum(df: DataFrame, groups: list[str], order: list[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` (a whole number, not negative or null) up to each row of its group.

    The rows are range-partitioned and sorted by group and order, so a group may be as large as it likes: each
    partition sums what it has, and the sums of the partitions before are added. Only one row per partition and group
    is gathered for that. ``groups`` must not be null.
    """
    keys = [*groups, *order]
    rest = [c for c in df.columns if c not in keys and c != value]
    rows = df.select(*keys, F.col(value).cast("bigint").alias(value), *rest)
    ranged = rows.repartitionByRange(partitions or shuffle_width(df.sparkSession), *keys).sortWithinPartitions(*keys)
    schema = ranged.withColumns({"_part": F.lit(0).cast("int"), "_local": F.lit(0).cast("bigint")}).schema
    local = written(ranged.mapInArrow(_scan(len(groups), len(keys)), schema), "running")
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = local.groupBy(*groups, "_part").agg(F.max("_local").alias("_sum"))
    offsets = sums.select(*groups, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    joined = local.join(broadcast_if_small(written(offsets, "offsets")), [*groups, "_part"])
    return joined.select(*df.columns, (F.col("_local") + F.col("_before")).alias(out))
