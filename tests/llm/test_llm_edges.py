"""Nulls in every column, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import os

import pytest

from quirewright.llm import catalog, copies, frequent, leakage, mixture, spans, terms

LONG = "Longword, " * 60_000
MASTER = (
    "row_id BIGINT, load_id INT, title STRING, date_text STRING, publication_title STRING, authors STRING, subject_terms STRING, class_terms STRING, "
    "publisher_city STRING, publisher_province STRING, key STRING, n INT, batch INT, item STRING, h BIGINT, prefix INT, total INT, term STRING, mark STRING, place_id INT, first INT"
)
CLASH = ("k", 1, 2, "i", 3, 4, 5, "t", "m", 6, 7)


def master_rows():
    full = (1, 1, "Title A", "2001", "Paper", "Ann; Bob", "x; y", "['K1', 'K2']", "Windlass", "NY")
    rows = [full + CLASH, full + CLASH]  # a repeated row
    for i in range(10):  # a null in each column in turn, and in all of them
        rows.append(tuple(None if c == i else (100 + i if c == 0 else v) for c, v in enumerate(full)) + CLASH)
    rows.append((200,) + (None,) * 20)
    rows.append((201, 2, LONG, LONG.upper(), "p", LONG.replace(",", ";"), LONG, "", LONG, "NY") + CLASH)
    rows.append((202, 2, "P!", LONG, LONG, "", " ", "N/A", "", "") + CLASH)
    return rows


def write(spark, folder, rows):
    spark.createDataFrame(rows, MASTER).write.parquet(f"{folder}/master.parquet")
    places = [(1, "Windlass", "NY", "New York", "US"), (2, "Windlass", None, None, None), (None, None, None, None, None)]
    spark.createDataFrame(places, "place_id BIGINT, city STRING, province STRING, province_name STRING, country STRING").write.parquet(f"{folder}/place_reference.parquet")


def run(spark, folder, name):
    return catalog.QUERIES[name](spark, str(folder)).collect()


def test_master_queries(spark, tmp_path):
    write(spark, tmp_path, master_rows())
    links = {tuple(r) for r in run(spark, tmp_path, "p1_found")}
    keep = {101, 105, 106, 107, 108, 109}  # a null outside the three fields changes nothing
    assert links == {(1, i) for i in keep} | {(201, 202)}  # a repeated row is a copy, but no row is a copy of itself
    assert max(r.copies for r in run(spark, tmp_path, "p1_collapsed")) == 3 + len(keep)
    counted = {(r.field_name, r.term): (r.occurrences, r.records) for r in run(spark, tmp_path, "p2_terms")}
    assert counted["subject_terms", "x"] == (11, 10) and counted["subject_terms", LONG.strip().lower()] == (1, 1)
    assert {r.item for r in run(spark, tmp_path, "p3_found") if r.field_name == "authors"} >= {"longword"}
    assert {r.item for r in run(spark, tmp_path, "p3_top") if r.field_name == "publication_title"} == {"paper", "p", LONG.strip().lower()}
    found = {r.row_id: r.place_id for r in run(spark, tmp_path, "p4_found")}
    assert found == {109: 0, 201: 0}  # ambiguous between two entries, and unlisted


def test_empty_master(spark, tmp_path):
    write(spark, tmp_path, [])
    for name in catalog.QUERIES:
        if name[:3] in ("p1_", "p2_", "p3_", "p4_"):
            assert run(spark, tmp_path, name) == []


def test_ties_are_broken_by_name(spark):
    rows = frequent.hashed(spark.createDataFrame([("f", x) for x in "edcba"], "field_name STRING, item STRING"))
    assert [r.item for r in frequent.top_items(rows, 3).orderBy("rank").collect()] == ["a", "b", "c"]


DOCS = "doc_id BIGINT, source STRING, text STRING, tokens INT, tx STRING, key STRING, pos INT"


def documents(spark):
    body = "the quick brown fox jumps over a very lazy dog near the old river bank today " * 3
    rows = [(1, "a", body), (1, "a", body), (2, None, body), (None, "a", "short"), (3, "a", None), (4, "b", ""), (5, "b", "x" * 300_000), (6, "b", "x" * 200)]
    return spark.createDataFrame([(*r, 1, "t", "k", 2) for r in rows], DOCS), body


@pytest.mark.skipif(not os.path.exists(mixture.TOKENIZER), reason="no tokenizer file")
def test_mixture(spark):
    docs, _ = documents(spark)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2), ("none", 0.0, 0), (None, 0.1, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    mix, report = mixture.half_mix(docs, targets)
    assert {r.source for r in mix.collect()} <= {"a", "b"} and report.count() == 4
    mix, report = mixture.half_mix(docs.limit(0), targets)
    assert mix.count() == 0 and all(r.actual_share is None for r in report.collect())


def test_texts(spark):
    docs, body = documents(spark)
    items = spark.createDataFrame([(1, body), (None, body), (2, None)], "item_id BIGINT, item_text STRING")
    leaks = [(r.item_id, r.doc_id) for r in leakage.leaked(docs, "doc_id", "text", items, "item_id", "item_text").collect()]
    assert sorted(leaks) == [(1, 1), (1, 2)]  # a row per item and document
    found = {r.doc_id for r in spans.shared_runs(docs, "doc_id", "text").collect()}
    assert found == {1, 2, 5, 6}
    assert spans.shared_runs(docs.where("doc_id = 1"), "doc_id", "text").count() == 0  # a repeated id is one document


def test_terms_of_nulls(spark):
    df = spark.createDataFrame([(None, None), (1, None)], "row_id BIGINT, f STRING")
    assert terms.marked_terms(df, ["f"], "row_id").count() == 0
    assert copies.keyed_rows(df.selectExpr("row_id", "f", "row_id AS load_id"), ["f"], "row_id", "load_id").count() == 0
