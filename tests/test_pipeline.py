import csv
import json
import random
import zipfile

import pytest

from quirewright.plans import pipeline
from quirewright.schema import CLEAN_COLUMNS, FEATURE_COLUMNS, RAW_COLUMNS, MissingColumns
from quirewright.sources import partitions, sinks


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    rng = random.Random(8)
    counts = {}
    for name in ("AlphaTrade", "BetaMagazines", "GammaNews"):
        folder = root / name
        folder.mkdir()
        rows = []
        for i in range(60):
            row = dict.fromkeys(RAW_COLUMNS, "")
            row |= {
                "GOID": str(10_000_000 + i % 55),
                "Title": rng.choice(["Grain prices rise, again", 'The "dock" strike', "Two\nline title", "Bank loans fall"]) + f" {i % 20}",
                "Date": rng.choice(["1999-01-02", "Mar 5, 2004", "2011", "bad"]),
                "Source Type": rng.choice(["Newspapers", "Magazines", ""]),
                "Authors": rng.choice(["['Ann Lee', \"O'Far\"]", "A; B", "", "['\\xe9mile']"]),
                "Publication ID": str(i % 5),
                "Publication Title": rng.choice(["The Grain Dock Sun", "Grain Dock Sun (Online)", "Dock Grain Sun", "Tin Post"]),
                "Publisher City": rng.choice(["New York", "London", ""]),
                "Publisher Name": "Pub",
                "Object Type": "News",
                "Language": "English" if i % 6 else "French",
                "Pages": rng.choice(["1", "x", "2.5"]),
                "Subject Terms": rng.choice(["Markets; Grain", "['Loans']", "N/A"]),
                "Class Terms": rng.choice(["K1 General", ""]),
            }
            rows.append(row)
        with (folder / "master.csv").open("w", newline="") as f:
            w = csv.DictWriter(f, RAW_COLUMNS, lineterminator="\n")
            w.writeheader()
            w.writerows(rows)
        counts[name] = (folder / "master.csv").read_bytes().count(b"\n") - 1
        for side in ("extended", "citation"):
            with zipfile.ZipFile(folder / f"{side}.csv.zip", "w") as z:
                z.writestr("notes.txt", "x")
                z.writestr(f"{side}.csv", "a,b\n" + "1,2\n" * (counts[name] if side == "extended" else 3))
    (root / ".hidden").mkdir()
    (root / "empty").mkdir()
    return root, counts


def test_discovery_and_inspection(spark, raw, tmp_path):
    root, counts = raw
    manifest = tmp_path / "manifest.csv"
    manifest.write_text("dataset_name,document_count\nset_a,%d\nBetaMagazines,1\n" % counts["AlphaTrade"])
    known = partitions.read_manifest(spark, str(tmp_path / "absent.csv"), str(manifest))
    parts = partitions.discover(spark, str(root), known, {"AlphaTrade": "set_a"})
    assert [(p.name, p.expected_rows) for p in parts] == [("AlphaTrade", counts["AlphaTrade"]), ("BetaMagazines", 1), ("GammaNews", None)]
    rows = {r.source_partition: r for r in partitions.inspected(spark, parts).collect()}
    a = rows["AlphaTrade"]
    assert (a.master_rows, a.master_columns, a.extended_columns, a.schema_matches) == (counts["AlphaTrade"], 31, 2, True)
    assert (a.manifest_rows_match, a.extended_rows_match, a.citation_rows_match) == (True, True, False)
    assert not rows["BetaMagazines"].manifest_rows_match and not rows["GammaNews"].manifest_rows_match
    assert {r.source_partition for r in partitions.mismatches(partitions.inspected(spark, parts)).collect()} == set(rows)
    plain = partitions.plain_facts(spark, [p.master_path for p in parts]).collect()
    assert sorted(r.physical_rows for r in plain) == sorted(counts.values())
    assert partitions.scan(spark, parts).count() == 180
    assert partitions.scan(spark, parts, ["goid", "date"]).columns == ["source_partition", "row_id", "goid", "date"]
    with pytest.raises(FileNotFoundError):
        partitions.discover(spark, str(tmp_path / "nowhere"))
    with pytest.raises(FileNotFoundError):
        partitions.discover(spark, str(tmp_path))


def test_missing_column(spark, tmp_path):
    (tmp_path / "P").mkdir()
    (tmp_path / "P" / "master.csv").write_text("GOID,Title\n1,x\n")
    with pytest.raises(MissingColumns, match="partition P"):
        partitions.scan(spark, partitions.discover(spark, str(tmp_path)))


def test_run_and_resume(spark, raw, tmp_path):
    root, _ = raw
    lexicon = spark.createDataFrame([("RISE", 1, 0), ("FALL", 0, 1)], "word STRING, positive INT, negative INT")
    out = f"file://{tmp_path}/out"
    small = pipeline.Settings(n_topics=2, features=50, min_df=2, rounds=4)
    watch = spark.createDataFrame([("Grain Dock Sun", "local", True), ("Never Seen", "local", True)], "reference_publication STRING, reference_role STRING, expected_in_scope BOOLEAN")
    made = pipeline.run(spark, str(root), lexicon, out, None, small, watch, "lexicon of the test")
    clean, features = spark.read.parquet(made["clean"]), spark.read.parquet(made["features"])
    assert clean.columns == CLEAN_COLUMNS and features.columns == FEATURE_COLUMNS
    assert clean.count() == features.count() == 150
    assert {r.publication_title_canonical for r in features.select("publication_title_canonical").distinct().collect()} < {"Grain Dock Sun", "Dock Grain Sun", "Tin Post"}
    assert dict(features.dtypes)["topic_id"] == "smallint" and dict(features.dtypes)["topic_weight"] == "float"
    checks = spark.read.csv(f"{made['csv']}/validation", header=True).collect()
    assert len(checks) == 5 and all(r.passed == "true" for r in checks)
    report = (tmp_path / "out" / "report.md").read_text()
    sections = ["Corpus", "Partitions", "Partitions that disagree with the manifest or a side file", "Duplicates", "Source types", "Languages", "Publications", "Topics", "Tone by decade", "Tables", "Limits"]
    assert [line[3:] for line in report.split("\n") if line.startswith("## ")] == sections and "150 records each" in report
    read = lambda name: spark.read.csv(f"{made['csv']}/{name}", header=True)
    core = {r.metric: r.value for r in read("core_summary").collect()}
    assert core["topic_sample_rows"] == "150" and core["lexicon_source"] == "lexicon of the test"
    assert [r.reference_publication for r in read("unobserved_publications").collect()] == ["Never Seen"] and read("watched_publications").count() >= 3
    assert read("data_dictionary").count() == 2 + len(CLEAN_COLUMNS) + len(FEATURE_COLUMNS)
    for name in ("author_coverage", "group_terms", "group_lexicon_totals", "pages_anova", "tone_anova", "usable_fields", "metadata_depth", "publication_examples", "top_authors", "language_counts", "canonical_rollup"):
        assert read(name).count() > 0, name
    cells = json.loads((tmp_path / "out" / "exploration.ipynb").read_text())["cells"]
    shown = [c["source"][0][6:-2] for c in cells if c["source"][0].startswith("show(")]
    assert len(shown) > 25 and all((tmp_path / "out" / "csv" / name).is_dir() for name in shown)
    before = sorted(map(str, features.collect()))
    again = pipeline.resume(spark, out)
    assert sorted(map(str, spark.read.parquet(again["features"]).collect())) == before
    with pytest.raises(FileNotFoundError):
        pipeline.resume(spark, f"file://{tmp_path}/nothing")
    assert all(r.copied for r in pipeline.deliver(spark, out, f"file://{tmp_path}/delivered").collect())
    assert spark.read.parquet(f"file://{tmp_path}/delivered/tables/metadata_features").count() == 150 and (tmp_path / "out" / "report.md").exists()


def test_raw_round_trip(spark, raw, tmp_path):
    root, _ = raw
    records = partitions.scan(spark, partitions.discover(spark, str(root)))
    partitions.write_raw(records, f"file://{tmp_path}/raw")
    again = partitions.scan(spark, partitions.discover(spark, f"file://{tmp_path}/raw"))
    assert sorted(map(str, again.drop("row_id").collect())) == sorted(map(str, records.drop("row_id").collect()))
    (tmp_path / "lexicon.csv").write_text("Word,Positive\nRISE,1\n")
    assert partitions.read_lexicon(spark, f"file://{tmp_path}/lexicon.csv").columns == ["Word", "Positive"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c, \"x\"", 5)], "value STRING, documents INT")
    sinks.write_counts(df, f"file://{tmp_path}/counts", "name", 2)
    assert [tuple(r) for r in spark.read.csv(f"file://{tmp_path}/counts", header=True, escape='"').collect()] == [('c, "x"', "5"), ("a", "2")]
    sinks.write_parquet(df, f"file://{tmp_path}/t", ["value", "documents"])
    sinks.rewrite(spark, f"file://{tmp_path}/t", lambda d: d.where("documents = 2"))
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 2
    assert any(r.path.endswith(".parquet") for r in sinks.artifacts(spark, f"file://{tmp_path}/t").collect())
