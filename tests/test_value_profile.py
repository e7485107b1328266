from math import log2

import pytest

from quirewright.operators.value_profile import ValueCounts, compared, findings, profile, value_deltas

ROWS = [(1, "English"), (1, " english "), (1, None), (1, "N/A"), (1, "fr"), (2, "\x01de"), (2, "--"), (2, "de"), (3, "de"), (3, "de"), (3, "de")]


def frame(spark, rows):
    return spark.createDataFrame([(a, b, 0) for a, b in rows], "load_id INT, language STRING, n INT")


def table(store):
    return sorted(((r.load_id, r.value, r.n) for r in store.counts().collect()), key=str)


def test_increments_equal_one_delivery(spark, tmp_path):
    whole, parts = ValueCounts(spark, f"{tmp_path}/a"), ValueCounts(spark, f"{tmp_path}/b", merge_at=3)
    whole.apply(value_deltas(frame(spark, ROWS), ["language"], "load_id"))
    for row in ROWS:
        parts.apply(value_deltas(frame(spark, [row]), ["language"], "load_id"))
    assert table(whole) == table(parts)
    assert len(parts.segments()) < 4
    parts.apply(value_deltas(frame(spark, ROWS[:2] + ROWS[-1:]), ["language"], "load_id", sign=-1))
    assert (1, "english", 2) not in table(parts) and (3, "de", 2) in table(parts)


def test_profile(spark, tmp_path):
    store = ValueCounts(spark, f"{tmp_path}/c")
    store.apply(value_deltas(frame(spark, ROWS), ["language"], "load_id"))
    p = {r.load_id: r for r in profile(store.counts()).collect()}
    assert (p[1].n_rows, p[1].n_missing, p[1].n_distinct, p[1].top_value, p[1].top_count) == (5, 2, 2, "english", 2)
    assert p[1].entropy == pytest.approx(-(2 / 3 * log2(2 / 3) + 1 / 3 * log2(1 / 3)))
    assert (p[2].n_broken, p[2].broken_share, p[3].entropy) == (2, pytest.approx(2 / 3), 0.0)
    found = {(r.load_id, r.finding) for r in findings(store.counts(), ["language"]).collect()}
    assert found == {(2, "pattern"), (2, "missing"), (2, "shift"), (3, "distinct"), (3, "shift")}


def test_empty_and_missing(spark, tmp_path):
    store = ValueCounts(spark, f"{tmp_path}/d")
    assert store.counts().count() == 0 and findings(store.counts(), ["language"]).count() == 0
    store.apply(value_deltas(frame(spark, [(1, None), (1, ""), (None, "x")]), ["language"], "load_id"))
    rows = {r.load_id: r for r in compared(store.counts(), ["language"]).collect()}
    assert rows[1].distinct_ratio is None and rows[1].entropy is None and rows[None].n_rows == 1
