"""Nulls in every column, empty and very long texts, repeated rows, empty tables and clashing names, for the core problems."""

from quirewright.plans import metadata, problems
from quirewright.schema import TEXT_COLUMNS

NAMES = [{"date": "date_text", "language": "language_name"}.get(c, c) for c in TEXT_COLUMNS]
CLASH = ("value", "n", "column_name", "reason", "item", "field_items", "_words", "decade", "metadata_text")
MASTER = "row_id BIGINT, source_partition STRING, load_id INT, " + ", ".join(f"{c} STRING" for c in [*NAMES, *CLASH])
LONG = "very long; " * 50_000


def row(i, load=1, **values):
    base = {"goid": "10000001", "date_text": "2001-01-02", "language_name": "English", "degree": "Ph.D.", "authors": "A; B", "company_name": "C", "pages": "1", "title": "T"}
    return (i, "XTrade", load, *((base | values).get(c) for c in NAMES), *("x" for _ in CLASH))


def write(spark, folder, rows, lines=()):
    spark.createDataFrame(rows, MASTER).write.parquet(f"{folder}/master.parquet")
    spark.createDataFrame(list(lines), "record_id BIGINT, source_partition STRING, raw_line STRING").write.parquet(f"{folder}/raw_master.parquet")
    spark.createDataFrame([], "dataset_name STRING, load_id INT, document_count BIGINT").write.parquet(f"{folder}/manifest.parquet")
    spark.createDataFrame([], "word STRING, positive INT, negative INT").write.parquet(f"{folder}/lexicon.parquet")
    spark.createDataFrame([], "reference_publication STRING, reference_role STRING, expected_in_scope BOOLEAN").write.parquet(f"{folder}/watch_list.parquet")


def test_problem_queries(spark, tmp_path):
    rows = [row(1), row(1), row(2, None), row(3, 2, **dict.fromkeys(NAMES)), row(4, 2, **dict.fromkeys(NAMES, "")), row(None)]
    rows += [row(5, 3, **dict.fromkeys(NAMES, LONG)), row(6, 3, goid="x", date_text="?", pages="?")]
    write(spark, tmp_path, rows, [(1, "p", None), (2, "p", ""), (3, None, LONG), (4, "p", ","), (4, "p", ",")])
    run = lambda name: problems.QUERIES[name](spark, str(tmp_path)).collect()
    items = run("p5_found")
    assert sum(r.row_id == 1 for r in items) == 4 and sum(r.row_id == 5 for r in items) == 4 * 50_000
    bad = sorted((r.origin, str(r.record_id), r.reason) for r in run("p7_found"))
    want = [("master", "3", "goid"), ("master", "4", "goid"), *(("master", i, x) for i in "56" for x in ("date", "goid", "pages"))]
    assert bad == sorted(want + [("raw_master", i, "column_count") for i in "12344"])
    profile = {(r.load_id, r.column_name): r for r in run("p6_profile")}
    assert profile[2, "degree"].missing_share == 1 and profile[2, "degree"].entropy is None and profile[3, "authors"].max_length == len(LONG.strip())
    assert profile[None, "degree"].n_rows == 1
    assert {(r.load_id, r.column_name) for r in run("p6_found") if r.finding == "missing"} >= {(2, "degree"), (3, "degree")}
    assert run("p7_loaded") == []


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [])
    for name, query in problems.QUERIES.items():
        assert query(spark, str(tmp_path)).collect() == [], name
    no_rows = ("clean_table", "final_counts", "duplicate_flags", "group_terms", "media_summary", "alias_audit", "canonical_names", "lexicon_scores", "stratum_sizes", "watched_publications")
    for name in no_rows:
        assert metadata.QUERIES[name](spark, str(tmp_path)).collect() == [], name
    assert {r.value for r in metadata.QUERIES["core_summary"](spark, str(tmp_path)).collect()} == {"0", None, "lexicon.parquet"}
    assert metadata.QUERIES["missing_profile"](spark, str(tmp_path)).count() == 31
