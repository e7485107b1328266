import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quirewright.operators import duplicates, profiling, resolve, sampling, sentiment, summaries
from quirewright.operators.running import running_sum
from quirewright.operators.skew import join_groups, with_group_columns
from quirewright.schema import LEXICON_CATEGORIES, MissingColumns, require

DUP = "row_id BIGINT, source_partition STRING, goid STRING, title STRING, date STRING, publication_title STRING, title_normalized STRING, publication_title_normalized STRING"


def test_required_columns():
    require(["a", "b", "c"], ["a", "c"], "the table")
    with pytest.raises(MissingColumns, match="partition x lacks the columns b"):
        require(["a"], ["a", "b"], "partition x")


def test_duplicates(spark):
    rows = [
        (1, "p1", "g1", "T", "2001", "P", "t", "p"),
        (2, "p0", "g1", "T", "2001", "P", "t", "p"),
        (3, "p1", None, "T!", "2001", "P", "t", "p"),
        (4, "p1", "", "u", None, "Q", "u", "q"),
        (5, "p1", "g5", "u", "", "R", "u", "r"),
    ]
    df = spark.createDataFrame(rows, DUP)
    summary = {r.duplicate_rule: (r.duplicate_extra_rows, r.duplicate_groups) for r in duplicates.duplicate_summary(df).collect()}
    assert summary == {
        "duplicate_goid": (2, 2),
        "duplicate_exact_title_date_publication": (1, 1),
        "duplicate_normalized_title_date_publication": (2, 1),
        "duplicate_title_date": (3, 2),
    }
    flags = {r.row_id: r for r in duplicates.duplicate_flags(df, ["source_partition", "row_id"]).collect()}
    assert [i for i in range(1, 6) if flags[i].duplicate_goid] == [1, 2, 3, 4]
    assert [i for i in range(1, 6) if flags[i].duplicate_title_date] == [1, 2, 3, 4, 5]
    assert [i for i in range(1, 6) if flags[i][duplicates.EXTRA]] == [1, 3]  # the first is row 2: its partition comes first
    assert sum(f[duplicates.EXTRA] for f in flags.values()) == summary[duplicates.CONSERVATIVE][0]
    assert duplicates.duplicate_flags(df.limit(0), ["source_partition", "row_id"]).count() == 0


def test_skewed_joins(spark):
    rng = random.Random(5)
    keys = ["hot"] * 30_000 + [f"k{rng.randrange(9000)}" for _ in range(60_000)]
    rows = spark.createDataFrame(list(enumerate(keys)), "i INT, k STRING").withColumn("k", F.unhex(F.md5("k")))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first")).where("n > 8")
    want = {r.i: r.first for r in rows.join(groups, "k").collect()}
    assert groups.where("n > 9").count() > 0 and any(groups.where(f"n > {90_000 // 10_000}").collect())
    got = join_groups(rows, groups, ["k"], "n", 90_000).collect()
    assert {r.i: r.first for r in got} == want and len(got) == len(want)
    left = with_group_columns(rows, groups, "k", "n", 90_000).collect()
    assert len(left) == 90_000 and {r.i: r.first for r in left if r.n is not None} == want


def test_sampling(spark):
    rows = [(i, "a" if i % 3 else None, i % 2) for i in range(200)] + [(1000, "rare", 0)]
    df = spark.createDataFrame(rows, "i INT, s STRING, t INT")
    sample = sampling.stratified(df, ["s", "t"], "i", 20)
    assert sorted(map(str, (r["count"] for r in sample.groupBy("s", "t").count().collect()))) == ["1", "20", "20", "20", "20"]
    again = sampling.stratified(df.repartition(7).orderBy(F.desc("i")), ["s", "t"], "i", 20)
    assert {r.i for r in sample.collect()} == {r.i for r in again.collect()}
    assert sampling.capped(df, ["s"], "i", 30).count() <= 30 and sampling.capped(df.limit(0), ["s"], "i", 5).count() == 0


def test_anova(spark):
    rng = random.Random(1)
    groups = {"a": [rng.gauss(0, 1) for _ in range(40)], "b": [rng.gauss(1, 1) for _ in range(30)], "small": [9.0] * 29}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [(None, 1.0), ("a", None)], "g STRING, v DOUBLE")
    rows = {r.source: r for r in summaries.anova(df, "g", "v").collect()}
    kept = [groups["a"], groups["b"]]
    mean = sum(map(sum, kept)) / 70
    ssb = sum(len(k) * (sum(k) / len(k) - mean) ** 2 for k in kept)
    ssw = sum((v - sum(k) / len(k)) ** 2 for k in kept for v in k)
    assert (rows["g"].df, rows["residual"].df) == (1, 68)
    assert rows["g"].sum_sq == pytest.approx(ssb) and rows["g"].f_stat == pytest.approx(ssb / (ssw / 68))
    one = {r.source: r for r in summaries.anova(df.where("g = 'a'"), "g", "v").collect()}
    assert one["g"].f_stat is None and one["g"].df == 0
    assert all(r.f_stat is None for r in summaries.anova(df.limit(0), "g", "v").collect())


def test_media_summary(spark):
    schema = (
        "publication_title_canonical STRING, publication_title_normalized STRING, publication_title_display STRING, publication_id STRING, "
        "publisher_name STRING, publisher_region STRING, source_type STRING, year BIGINT, primary_author STRING, subject_term_count INT"
    )
    rows = [("C", f"v{i % 9}", "D2" if i % 2 else "D1", f"{i % 7}", None, "US", "S", 1990 + i, f"a{i % 3}", i % 2) for i in range(10)] + [("E", "e", "E", None, None, "US", None, None, None, 0)]
    media = {r.publication_title_canonical: r for r in summaries.media_summary(spark.createDataFrame(rows, schema)).collect()}
    c = media["C"]
    assert (c.documents, c.first_year, c.last_year, c.display_publication_title, c.unique_authors, c.avg_subject_terms) == (10, 1990, 1999, "D1", 3, 0.5)
    assert c.normalized_variants == "; ".join(f"v{i}" for i in range(8)) and c.publication_ids == "0; 1; 2; 3; 4"
    assert (c.top_publisher, media["E"].publication_ids, media["E"].top_source_type, media["E"].unique_authors) == ("", "", "", 0)


def test_ranks_and_pivot(spark):
    df = spark.createDataFrame([("x", 1, 3), ("y", 1, 1), ("x", 2, 5), ("y", None, 2)], "r STRING, c INT, documents INT")
    wide = {r.r: r for r in summaries.pivot_shares(df, "r", "c", [1, 2], "share").collect()}
    assert (wide["x"].share_1, wide["y"].share_1, wide["y"].share_2) == (0.75, 0.25, 0.0)
    ranks = [(r.documents, r["rank"]) for r in summaries.ranked(df, "documents", "r", "rank").collect()]
    assert sorted(ranks) == [(1, 4), (2, 3), (3, 2), (5, 1)]
    assert [r.value for r in profiling.most_frequent(df.select(F.col("r").alias("value"), "documents"), 2).collect()] == ["x", "x"]


LEX = "Word STRING, Positive INT, NEGATIVE INT, uncertainty INT, litigious INT, constraining INT, strong_modal INT"


def test_lexicon(spark):
    lexicon = spark.createDataFrame([("Good", 2009, -2020, 0, 0, 0, 0), ("bad", 0, 1, 0, None, 0, 0), ("none", 0, 0, 0, 0, 0, 0)], LEX)
    members = sentiment.lexicon_members(lexicon)
    assert {tuple(r) for r in members.collect()} == {("GOOD", "positive"), ("GOOD", "negative"), ("BAD", "negative")}
    df = spark.createDataFrame([(1, "good good bad day"), (2, "12 %"), (3, None)], "i INT, t STRING")
    inline = {r.i: r.asDict() for r in sentiment.scores(df, "t", members).collect()}
    assert (inline[1]["lm_token_count"], inline[1]["lm_positive"], inline[1]["lm_negative"], inline[1]["lm_net_tone"]) == (4, 2, 3, -0.25)
    assert inline[2]["lm_net_tone"] == 0 and inline[3]["lm_token_count"] == 0 and inline[1]["lm_weak_modal"] == 0
    assert len([c for c in inline[1] if c.startswith("lm_")]) == 2 + 2 * len(LEXICON_CATEGORIES)


def test_lexicon_of_thousands_of_words(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh'", k=5)) for _ in range(6000)]
    table = {w.upper(): {c: rng.randrange(4) == 0 for c in LEXICON_CATEGORIES} for w in words}
    rows = [(w, *(int(table[w.upper()][c]) for c in LEXICON_CATEGORIES)) for w in words]
    lexicon = spark.createDataFrame(rows, "word STRING, " + ", ".join(f"{c} INT" for c in LEXICON_CATEGORIES))
    texts = [" ".join(rng.choices([*words, "zzz"], k=40)) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    for r in sentiment.scores(df, "t", sentiment.lexicon_members(lexicon)).collect():
        found = [x.upper().replace("-", "") for x in re.findall(r"[A-Za-z][A-Za-z'\-]*", texts[r.i])]
        assert r.lm_token_count == len(found)
        assert [r[f"lm_{c}"] for c in LEXICON_CATEGORIES] == [sum(table.get(w, {}).get(c, False) for w in found) for c in LEXICON_CATEGORIES]


# -- names ---------------------------------------------------------------------------------------------------------


def pair(spark, left, right, ids=False, publisher=False):
    df = spark.createDataFrame([(left, right, ids, publisher)], "left STRING, right STRING, shared_publication_id BOOLEAN, shared_top_publisher BOOLEAN")
    return resolve.compared_names(df).first()


@pytest.mark.parametrize(
    ("left", "right", "ids", "publisher", "outcome"),
    [
        ("Grain Sun", "grain  sun!", False, False, "auto-merge; exact normalized publication"),
        ("Grain Dock Sun", "Grain Mill Sun", True, True, "keep separate; conflicting anchor tokens"),
        ("Grain Sun", "Grain Herald", True, True, "keep separate; low-information anchor tokens"),
        ("Grain Dock Sun", "Dock Grain Sun", False, False, "auto-merge; same anchor tokens"),
        ("Grain Sun", "Grain Dock", False, False, "keep separate; low-information subset anchors"),
        ("Grain Dock Almanac", "Grain Dock Almanac Extra", True, False, "auto-merge; subset anchor tokens with shared publication id"),
        ("Grain Dock Almanac", "Grain Dock Almanac Extra", False, True, "review; metadata-backed near match"),
        ("Grain Dock Almanac Letter", "Grain Dock Almanac Letters X", False, False, "keep separate; conflicting anchor tokens"),
        ("Grain Dock Almanac Letter", "Grain Dock Almanac Letter X", False, False, "review; strong title overlap"),
        ("Grain Sun", "Mill Sun", False, False, "keep separate; low evidence"),
    ],
)
def test_ladder(spark, left, right, ids, publisher, outcome):
    assert pair(spark, left, right, ids, publisher).recommendation == outcome


def media_frame(spark, rows):
    return spark.createDataFrame(rows, "publication_title_canonical STRING, documents BIGINT, publication_ids STRING, top_publisher STRING")


def test_blocking_loses_no_pair(spark):
    rng = random.Random(3)
    words = ["grain", "dock", "mill", "news", "sun", "tin", "iron", "weekly"]
    names = sorted({" ".join(rng.sample(words, rng.randint(1, 4))).title() for _ in range(110)})
    rows = [(n, rng.randrange(5), rng.choice(["", "1", "1; 2", "3"]), rng.choice(["", "Pub A", "Pub B"])) for n in names]
    media = media_frame(spark, rows)
    audit = {(r.publication_left, r.publication_right): r.recommendation for r in resolve.alias_audit(media).collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    every = [
        (a[0], b[0], bool(set(a[2].split("; ")) & set(b[2].split("; "))), bool(a[3]) and a[3] == b[3])
        for i, a in enumerate(order)
        for b in order[i + 1 :]
        if abs(len(a[0]) - len(b[0])) <= 18
    ]
    brute = resolve.compared_names(spark.createDataFrame(every, "left STRING, right STRING, shared_publication_id BOOLEAN, shared_top_publisher BOOLEAN"))
    want = {(r.left, r.right): r.recommendation for r in brute.where("auto_merge OR needs_review").collect()}
    assert audit == want and len(want) > 15


def test_components_and_representatives(spark):
    rng = random.Random(2)
    n, edges = 120, [(i, i + 1) for i in range(40)] + [(rng.randrange(50, 120), rng.randrange(50, 120)) for _ in range(40)]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    nodes = spark.range(n).select(F.col("id").cast("int").alias("node"))
    got = {r.node: r.component for r in resolve.components(nodes, spark.createDataFrame(edges, "src INT, dst INT")).collect()}
    assert got == {i: find(i) for i in range(n)}
    media = media_frame(spark, [("bb", 5, "", ""), ("a", 5, "", ""), ("ccc", 9, "", ""), ("dd", 1, "", ""), ("c", 1, "", "")])
    audit = spark.createDataFrame([("bb", "a", True), ("a", "ccc", False), ("dd", "c", True)], "publication_left STRING, publication_right STRING, auto_merge BOOLEAN")
    mapping = {r.publication_title: r.canonical_title for r in resolve.canonical_map(media, audit).collect()}
    assert mapping == {"bb": "a", "a": "a", "ccc": "ccc", "dd": "c", "c": "c"}


def test_watch_list(spark):
    media = spark.createDataFrame(
        [("Grain Times", "The Grain Times", 9, 1990, 2000, "News"), ("Tin Post", "Tin Post", 3, 1980, 1981, "Mag")],
        "publication_title_canonical STRING, display_publication_title STRING, documents BIGINT, first_year BIGINT, last_year BIGINT, top_source_type STRING",
    )
    wanted = resolve.literal_watch_list(spark, [("The Grain Times, Inc.", "core", True), ("Inc.", "odd", True), ("Far Away", "peer", False)])
    rows = {r.publication_key: r for r in resolve.watched(media, wanted, 1).collect()}
    assert set(rows) == {"Grain Times", "Unknown", "Far Away"}
    assert rows["Grain Times"].corpus_rank == 1 and rows["Grain Times"].real_world_reference and not rows["Far Away"].observed_in_corpus
    assert [r.reference_publication for r in resolve.expected_but_unobserved(media, wanted).collect()] == ["Inc."]


def test_running_sum(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), rng.randrange(50), i, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g STRING, o INT, i INT, v INT")
    got = {r.i: r.total for r in running_sum(df, ["g"], ["o", "i"], "v", "total", 5).collect()}
    sums, want = {}, {}
    for g, _, i, v in sorted(rows):
        sums[g] = want[i] = sums.get(g, 0) + v
    assert got == want
    whole = {r.i: r.total for r in running_sum(df, [], ["o", "i"], "v", "total", 5).collect()}
    total = 0
    for _, o, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        total += v
        assert whole[i] == total
    assert running_sum(df.limit(0), ["g"], ["o", "i"], "v", "total").count() == 0
    assert math.isclose(max(whole.values()), sum(r[3] for r in rows))
