"""Deliveries that arrive as a stream of files: the same operators, one micro-batch at a time.

Nothing in the metadata pipeline needs event time or watermarks: a delivery is a set of files, and its state is the
maintained value counts. Each micro-batch is one numbered segment of deltas, written as a whole; a batch that is run
again after a failure writes the same segment or, if that is finished, nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quirewright.operators.value_profile import ValueCounts, value_deltas


def deliveries(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """A stream over the Parquet files of ``folder``, in batches; the schema is that of the files there now."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def maintain_counts(stream: DataFrame, columns: Sequence[str], load: str, store: ValueCounts, checkpoint: str) -> StreamingQuery:
    """Keep ``store`` up to date with every delivery of ``stream``; stops when all files that are there are read."""

    def add(batch: DataFrame, number: int) -> None:
        store.apply(value_deltas(batch, columns, load), segment=number + 1)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
