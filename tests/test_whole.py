"""Queries that do the whole job: cases that a smaller job would lose."""

import glob
import os
from collections import Counter
from math import log

import pytest

from quirewright.operators import summaries, topics
from quirewright.operators.value_profile import ValueCounts
from quirewright.plans import catalog, metadata
from quirewright.plans.metadata_sql import BASE
from quirewright.schema import RAW_COLUMNS
from quirewright.sources import partitions

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


def duck(sql):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con.execute(sql).fetchall()


def test_pivot_of_all_values(spark):
    df = spark.createDataFrame([("a", 1890, 3), ("b", 1890, 1), ("b", 2010, 4), ("c", None, 9)], "r STRING, c INT, documents INT")
    out = summaries.pivot_shares(df, "r", "c", None, "share")
    assert out.columns == ["r", "share_1890", "share_2010"]
    assert sorted(map(tuple, out.collect())) == [("a", 0.75, 0.0), ("b", 0.25, 1.0)]
    assert summaries.pivot_shares(df.where("r = 'c'"), "r", "c", None, "share").count() == 0


@tables
def test_object_types_of_all_decades(spark):
    counts = duck(BASE + "SELECT coalesce(object_type, '<missing>'), decade, count(*) FROM e WHERE decade IS NOT NULL GROUP BY ALL")
    total = {}
    for _, d, n in counts:
        total[d] = total.get(d, 0) + n
    assert min(total) < 1980
    want = {(o, f"share_{d}"): round(n / total[d], 9) for o, d, n in counts}
    rows = [r.asDict() for r in catalog.QUERIES["object_type_by_decade_share"](spark, FOLDER).collect()]
    got = {(r["object_type"], c): v for r in rows for c, v in r.items() if c != "object_type" and v}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in want)


@tables
def test_topics_of_all_decades(spark):
    decades = {f"share_{d}" for (d,) in duck(BASE + "SELECT DISTINCT decade FROM e WHERE decade IS NOT NULL")}
    assert set(catalog.QUERIES["topic_share_by_decade"](spark, FOLDER).columns) == {"topic_label"} | decades


@tables
def test_topics_of_all_records(spark, monkeypatch):
    [(size, n)] = duck(BASE + ", g AS (SELECT count(*) AS n FROM e WHERE length(metadata_text) > 5 GROUP BY decade, source_type) SELECT sum(least(n, 1200)), (SELECT count(*) FROM e) FROM g")
    assert metadata.topic_sample(metadata.topic_rows(spark, FOLDER)).count() == size
    asked = {}
    monkeypatch.setattr(topics, "fit_topics", lambda vectors, terms, k, rounds: asked.update(k=k, rounds=rounds))
    monkeypatch.setattr(metadata.SETTINGS, "per_stratum", 2)
    v, _ = metadata._fitted(metadata.topic_rows(spark, FOLDER))
    assert asked == {"k": 12, "rounds": 30}
    held = dict(topics._grams(metadata.english_records(spark, FOLDER), "metadata_text", True, v.stop_words).selectExpr("explode(array_distinct(_grams)) AS t").groupBy("t").count().collect())
    assert set(v.terms) <= {t for t, k in held.items() if k >= 10} and len(v.terms) == min(8000, sum(10 <= k <= 0.65 * n for k in held.values()))
    assert all(abs(i - log((1 + n) / (1 + held[t])) - 1) < 1e-12 for t, i in zip(v.terms, v.idf, strict=True))


def test_sparse_sums():
    rows, cols, vals = topics._flat([[0, 2], None, [], [1]], [[1.0, 2.0], None, [], [3.0]])
    assert topics._sums(rows, 4, cols, topics.np.eye(3), vals).tolist() == [[1, 0, 2], [0, 0, 0], [0, 0, 0], [0, 3, 0]]


@tables
def test_vectors_of_words_and_pairs(spark):
    rows = topics._grams(metadata.english_records(spark, FOLDER), "metadata_text", True, topics.STOP_WORDS).select("row_id", "_grams").collect()
    n, held = len(rows), Counter(t for r in rows for t in set(r._grams))
    want = {}
    for r in rows:
        w = {t: k * (log((1 + n) / (1 + held[t])) + 1) for t, k in Counter(r._grams).items() if 10 <= held[t] <= 0.65 * n}
        want |= {(r.row_id, t): x / sum(y * y for y in w.values()) ** 0.5 for t, x in w.items()}
    got = {(r.row_id, r.term): r.weight for r in catalog.QUERIES["tfidf_vectors"](spark, FOLDER).collect()}
    assert any(" " in t for _, t in got) and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_inspection_of_large_plain_files(spark, tmp_path):
    line = ",".join(['"two\nlines"'] + ["x"] * 30)
    texts = {"A b%20c": ",".join(RAW_COLUMNS) + "\n" + (line + "\n") * 50, "Open": "a,\"b\nc\"\r\n1,2\r3", "Void": "", "Only": "a,b"}
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "master.csv").write_bytes(text.encode())
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100)
    try:
        rows = {r.source_partition: r for r in partitions.inspected(spark, partitions.discover(spark, f"file://{tmp_path}", {"A b%20c": 100})).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert {n: r.master_rows for n, r in rows.items()} == {n: max(t.count("\n") - 1, 0) for n, t in texts.items()}
    assert {n: r.master_columns for n, r in rows.items()} == {"A b%20c": 31, "Open": 2, "Void": 0, "Only": 2}
    assert [n for n, r in rows.items() if r.schema_matches] == ["A b%20c"] and rows["A b%20c"].manifest_rows_match


def test_withdrawal_before_its_addition(spark, tmp_path):
    tables = []
    for merge_at in (2, 8):
        store = ValueCounts(spark, f"{tmp_path}/{merge_at}", merge_at=merge_at)
        for value, n in (("a", -2), ("b", 1), ("a", 3), ("b", -1)):
            store.apply(spark.createDataFrame([(1, "c", value, n)], "load_id INT, column_name STRING, value STRING, n BIGINT"))
        tables.append([tuple(r) for r in store.counts().collect()])
    assert tables == [[(1, "c", "a", 1)]] * 2


@tables
def test_reference_sizes(spark):
    run = lambda name: catalog.QUERIES[name](spark, FOLDER)
    assert run("group_terms").agg({"rank": "max"}).first()[0] == 120
    [(sizes,)] = duck(BASE + ", g AS (SELECT count(*) AS n FROM e WHERE length(metadata_text) > 5 GROUP BY decade, source_type) SELECT sum(least(n, 1200)) FROM g")
    assert run("stratum_sizes").agg({"documents": "sum"}).first()[0] == sizes
    [(n,)] = duck(BASE + "SELECT count(*) FROM e WHERE length(metadata_text) > 10 AND decade IS NOT NULL")
    assert run("capped_sample").count() == n  # no stratum reaches its cap here
