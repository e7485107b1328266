import os
import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quirewright.llm import copies, frequent, terms

COLUMNS = ["title", "date_text", "publication_title"]
SCHEMA = "row_id BIGINT, load_id INT, title STRING, date_text STRING, publication_title STRING, key STRING, n INT"


def canonical(row):
    values = []
    for v in row[2:5]:
        if v is None or v.strip(" \t\r\n\xa0") in {"", "N/A", "None", "null", "NULL", "nan", "NaN", "n/a", "NA", "none"}:
            return None
        values.append("".join(c for c in v.lower() if unicodedata.category(c)[0] in "LN"))
    return tuple(sorted(values)) if all(values) else None


def delivered(n=600, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = 0 if rng.random() < 0.33 else rng.randrange(150)
        fields = [f"Title {k}: É", f"200{k % 9}-01-02", f"Paper {k % 20}"]
        if rng.random() < 0.3:
            rng.shuffle(fields)
        fields = [rng.choice([f, f.upper(), f" {f}. ", f.replace(" ", "-")]) for f in fields]
        if rng.random() < 0.1:
            fields[rng.randrange(3)] = rng.choice([None, "", " N/A ", "--"])
        rows.append((i, rng.choice([1, 2, 3, None]), *fields, "x", 1))
    return rows


@pytest.mark.parametrize("buckets", [1, 5])
def test_copies_against_brute_force(spark, buckets):
    rows = delivered()
    groups = defaultdict(list)
    for r in rows:
        if canonical(r):
            groups[canonical(r)].append(r[0])
    df = spark.createDataFrame(rows, SCHEMA)
    links = copies.copy_links(df, COLUMNS, "row_id", "load_id").collect()
    assert sorted((r.row_id_a, r.row_id_b) for r in links) == sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    ledger = copies.CopyLedger(spark, copies.new_path(spark, "ledger"), buckets)
    keyed = copies.keyed_rows(df, COLUMNS, "row_id", "load_id")
    for low in range(0, 600, 200):  # any split into batches gives the same ledger
        ledger.add(keyed.where(f"row_id >= {low} AND row_id < {low + 200}"))
    assert {(r.first, r.n) for r in ledger.rows().collect()} == {(min(g), len(g)) for g in groups.values()}
    again = copies.CopyLedger(spark, ledger.path)  # another session takes it up
    assert again.state["buckets"] == buckets and again.rows().count() == len(groups)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("ledger_")]


def test_small_batch_on_a_large_ledger(spark, tmp_path):
    def files():
        return {f: os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")}

    key = F.unhex(F.md5(F.col("id").cast("string")))
    ledger = copies.CopyLedger(spark, f"file://{tmp_path}", 64)
    ledger.add(spark.range(200_000).select(key.alias("key"), F.col("id").alias("row_id")), "first")
    before = files()
    ledger.add(spark.range(3).select(key.alias("key"), (F.col("id") + 1_000_000).alias("row_id")), "second")
    new = {f: n for f, n in files().items() if f not in before}
    assert before.keys() <= files().keys() and 1 <= len(new) <= 3  # the buckets that the batch touches
    assert sum(new.values()) < sum(before.values()) / 100
    again = copies.CopyLedger(spark, f"file://{tmp_path}")
    again.add(spark.range(3).select(key.alias("key"), F.col("id").alias("row_id")), "second")  # in already
    got = {r.n: r["count"] for r in again.rows().groupBy("n").count().collect()}
    assert got == {1: 199_997, 2: 3} and again.rows().where("n = 2").agg(F.max("first")).first()[0] == 2


def test_segments_are_joined_with_the_base(spark):
    ledger = copies.CopyLedger(spark, copies.new_path(spark, "ledger"), 4)
    waiting = []
    for b in range(12):
        ledger.add(spark.range(b * 100, b * 100 + 150).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key"), "id").withColumnRenamed("id", "row_id"), str(b))
        waiting.append(len(ledger.state["segments"]))
        got = {r.n: r["count"] for r in ledger.rows().groupBy("n").count().collect()}
        assert sum(n * k for n, k in got.items()) == 150 * (b + 1) and got.get(2, 0) == 50 * b
    assert waiting[0] == 0 and max(waiting) > 1
    assert {r.n: r["count"] for r in ledger.rows().groupBy("n").count().collect()} == {1: 700, 2: 550}
    assert "Exchange" not in ledger.rows()._jdf.queryExecution().executedPlan().toString()  # matching buckets


def test_copies_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert copies.copy_links(empty, COLUMNS, "row_id", "load_id").count() == 0
    assert copies.collapsed(empty, COLUMNS, "row_id", "load_id").count() == 0
    nulls = spark.createDataFrame([(1, 1, None, None, None, None, None), (2, 1, "a", "b", "?", None, None)], SCHEMA)
    assert copies.copy_links(nulls, COLUMNS, "row_id", "load_id").count() == 0


def test_longest_text(spark):
    long = "word " * 200_000
    df = spark.createDataFrame([(1, 1, long, "b", "c", "", 0), (2, 1, "C", long.upper(), "b.", "", 0)], SCHEMA)
    assert [tuple(r) for r in copies.copy_links(df, COLUMNS, "row_id", "load_id").collect()] == [(1, 2)]


def test_terms_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "; ".join(rng.choice(["Hot", "hot ", f"t{rng.randrange(30)}"]) for _ in range(rng.randrange(6))) or None, i) for i in range(800)]
    rows.append((9999, "[]", 0))
    df = spark.createDataFrame(rows, "row_id INT, f STRING, term INT")
    got = {r.term: (r.occurrences, r.records, r.mark) for r in terms.marked_terms(df, ["f"], "row_id", 3, 0.1).collect()}
    lists = [[x.strip().lower() for x in r[1].split(";")] for r in rows[:-1] if r[1]]
    occurrences, records = Counter(t for x in lists for t in x), Counter(t for x in lists for t in set(x))
    mark = lambda n: "rare" if n < 3 else "common" if n / len(lists) > 0.1 else None
    assert got == {t: (occurrences[t], n, mark(n)) for t, n in records.items()}
    one = {r.term: r.occurrences for r in terms.term_counts(df.selectExpr("'f' AS field_name", "f AS term", "row_id AS record_id").where("f IS NOT NULL"), 1).collect()}
    assert one == Counter(r[1] for r in rows if r[1])
    assert terms.marked_terms(df.limit(0), ["f"], "row_id").count() == 0


def test_frequent_against_brute_force(spark):
    rng = random.Random(6)
    values = ["hot"] * 2000 + [f"v{int(rng.expovariate(0.01))}" for _ in range(4000)] + [None] * 10
    rng.shuffle(values)
    df = spark.createDataFrame([(rng.choice("ab"), v, 0) for v in values], "field_name STRING, item STRING, n INT")
    counts = {f: Counter(r.item for r in df.where(f"field_name = '{f}'").collect() if r.item) for f in "ab"}
    rows = frequent.hashed(df)
    top = {(r.field_name, r["rank"]): (r.item, r.n) for r in frequent.top_items(rows, 15).collect()}
    for f in "ab":
        want = sorted(counts[f].items(), key=lambda x: (-x[1], x[0]))[:15]
        assert [top[f, i] for i in range(1, 16)] == want
    above = {(r.field_name, r.item, r.n) for r in frequent.items_above(rows, 0.005).collect()}
    assert above == {(f, i, n) for f in "ab" for i, n in counts[f].items() if n >= 0.005 * sum(counts[f].values())}
    few = frequent.top_items(frequent.hashed(df.where("item = 'hot'")), 5).collect()
    assert {r.item for r in few} == {"hot"}
    empty = frequent.hashed(df.limit(0))
    assert frequent.top_items(empty, 5).count() == 0 and frequent.items_above(empty, 0.1).count() == 0
