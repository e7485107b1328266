"""Session helpers: the shared folder, written intermediate tables, checked broadcasts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []
_OWN: dict[str, str] = {}

#: Rows up to which a side whose size is not fixed by its definition may be broadcast.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a session of this machine alone gets a temporary one; on a cluster, whose executors would each
    see a folder of their own, that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(-cluster)?(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        application = spark.sparkContext.applicationId
        if application not in _OWN:
            _OWN[application] = "file://" + tempfile.mkdtemp(prefix="quirewright-")
        path = _OWN[application]
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/quirewright/{name}-{uuid.uuid4().hex[:12]}"
    if not _WRITTEN:
        atexit.register(_cleanup)
    _WRITTEN.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Remove the intermediate tables of a session once nothing reads them any more; a long session calls it between jobs."""
    for entry in [e for e in _WRITTEN if e[0] is spark]:
        remove(*entry)
        _WRITTEN.remove(entry)


def _cleanup() -> None:
    for spark, path in _WRITTEN:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may have gone
            return


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage, survives the loss of any executor, and keeps column pruning and filter push-down for
    whatever reads it, which ``checkpoint()`` does not.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` has at most ``rows`` rows; else leave the choice to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
