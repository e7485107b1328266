"""Frequency of every distinct term: a range-partitioned external sort and a run-length scan."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewright.functions.packed import folded
from quirewright.operators.packed import packed_arrays
from quirewright.session import shuffle_width, written


def _scan(batches: Iterator) -> Iterator:
    """Run lengths of a partition sorted by field, term and record: occurrences and distinct records per run."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def out(field, term, occ, rec):
        return pa.record_batch(
            [pa.array(field, pa.string()), pa.array(term, pa.string()), pa.array(occ, pa.int64()), pa.array(rec, pa.int64())],
            names=["field_name", "term", "occurrences", "records"],
        )

    held = None  # the run that the last batch ended in: field, term, occurrences, records, last record
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        field, term, ids = b.column(0), b.column(1), b.column(2).to_numpy(zero_copy_only=False)
        new_run, new_record = np.ones(n, bool), np.ones(n, bool)
        if n > 1:
            differ = pc.or_(pc.not_equal(field.slice(1), field.slice(0, n - 1)), pc.not_equal(term.slice(1), term.slice(0, n - 1)))
            new_run[1:] = differ.to_numpy(zero_copy_only=False)
            new_record[1:] = new_run[1:] | (ids[1:] != ids[:-1])
        starts = np.flatnonzero(new_run)
        occ = np.diff(np.append(starts, n))
        rec = np.add.reduceat(new_record.astype(np.int64), starts)
        fields, terms = field.take(pa.array(starts)).to_pylist(), term.take(pa.array(starts)).to_pylist()
        if held and held[:2] == (fields[0], terms[0]):
            occ[0] += held[2]
            rec[0] += held[3] - (held[4] == ids[0])
        elif held:
            yield out([held[0]], [held[1]], [held[2]], [held[3]])
        held = (fields[-1], terms[-1], int(occ[-1]), int(rec[-1]), ids[-1])
        if len(starts) > 1:
            yield out(fields[:-1], terms[:-1], occ[:-1], rec[:-1])
    if held:
        yield out([held[0]], [held[1]], [held[2]], [held[3]])


def term_counts(pairs: DataFrame, partitions: int | None = None) -> DataFrame:
    """(field_name, term, occurrences, records) from (field_name, term, record_id) pairs.

    The pairs are sorted by range over all three columns, so a term held by a third of all records spreads over many
    partitions, each pair of term and record lies in one of them, and the scans' counts just add up.
    """
    partitions = partitions or shuffle_width(pairs.sparkSession)
    keys = ["field_name", "term", "record_id"]
    ordered = pairs.select(*keys).repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    runs = ordered.mapInArrow(_scan, "field_name STRING, term STRING, occurrences BIGINT, records BIGINT")
    return runs.groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(df: DataFrame, fields: list[str], id_column: str, min_records: int = 3, max_share: float = 0.10) -> DataFrame:
    """Every distinct folded item of the packed ``fields``: occurrences, records, share of records and ``mark``.

    The mark is ``rare`` below ``min_records`` records, else ``common`` above ``max_share`` of the records that have an
    item in the field, else null. Missing items are no terms; empty tables give no rows.
    """
    arrays = packed_arrays(df, fields, [id_column]).where(F.size("field_items") > 0)
    arrays = written(
        arrays.select(F.col(id_column).cast("bigint").alias("record_id"), "field_name", F.transform("field_items", folded).alias("terms")), "terms"
    )
    holders = F.broadcast(arrays.groupBy("field_name").agg(F.count(F.lit(1)).alias("holders")))  # a row per field
    counts = term_counts(arrays.select("field_name", F.explode("terms").alias("term"), "record_id"))
    share = F.col("records") / F.col("holders")
    mark = F.when(F.col("records") < min_records, F.lit("rare")).when(share > max_share, F.lit("common"))
    return counts.join(holders, "field_name").select("field_name", "term", "occurrences", "records", share.alias("share"), mark.alias("mark"))
