from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirewright.functions.packed import items
from quirewright.operators.packed import packed_rows

CASES = [
    ("['a, b', \"Owner's equity\", 'c']", ["a, b", "Owner's equity", "c"]),
    ("['O\\'Farrowby, Ilsabet','Perrin']", ["O'Farrowby, Ilsabet", "Perrin"]),
    ('"a";"b;c"; d', ["a", "b;c", "d"]),
    ('"a, x", "b"', ["a, x", "b"]),
    ("Leases, finance; x", ["Leases, finance", "x"]),
    ("[None, 'x', '']", ["x"]),
    ("[]", []),
    ("[None]", []),
    ('5" pipe; 6" pipe', ['5" pipe', '6" pipe']),
    ('"a ""b"" c"; d', ['a "b" c', "d"]),
    ('"unclosed; x', ['"unclosed', "x"]),
    ("O'Far, I;;B\r\nC | D;", ["O'Far, I", "B", "C", "D"]),
    ("['a\\xe9','b']", ["aé", "b"]),
    ("[sic] x; y [z]", ["[sic] x", "y [z]"]),
    ("[a, b]", ["[a, b]"]),
    ("['N/A','x']", ["x"]),
    ("'tis; x", ["'tis", "x"]),
    ('"x"; "y\\z"', ["x", "y\\z"]),
    ("['a''b', 'c']", ["a'b", "c"]),
    ('"";"x"', ["x"]),
    ('x; The "Big" Store; y', ["x", 'The "Big" Store', "y"]),
    ("['a\\\\', 'b']", ["a\\", "b"]),
    ("a; a; A", ["a", "a", "A"]),
    (" N/A ", []),
    ("", []),
    (None, []),
]


def test_forms(column):
    assert column(items, [c[0] for c in CASES]) == [c[1] for c in CASES]


WORDS = st.text("ab&/'()[]., é", min_size=1, max_size=8).map(lambda s: s.strip(" ")).filter(lambda s: s and s[0] not in "'[" and "," not in s)
PACKS = st.lists(st.tuples(st.lists(WORDS, min_size=1, max_size=5), st.sampled_from(["list1", "list2", ";", "|", "\n", "quoted,", "quoted;", "; ;"])), min_size=1, max_size=40)


def pack(values, form):
    if form == "list1":
        return repr(values)
    if form == "list2":
        return "[" + ", ".join('"' + v + '"' for v in values) + "]"
    if form == "quoted,":
        return ", ".join('"' + v + '"' for v in values)
    if form == "quoted;":
        return ";".join('"' + v + '"' for v in values)
    return form.join(values)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(PACKS)
def test_round_trip(column, packs):
    assert column(items, [pack(v, f) for v, f in packs]) == [v for v, f in packs]


def test_rows(spark):
    df = spark.createDataFrame([(1, "a; b", "x", 7), (2, None, "y; y", 8)], "row_id INT, f STRING, g STRING, item INT")
    rows = packed_rows(df, ["f", "g"], ["row_id"], 2).orderBy("row_id", "field_name", "item_pos").collect()
    assert [tuple(r) for r in rows] == [(1, "f", 1, "a"), (1, "f", 2, "b"), (2, "g", 1, "y"), (2, "g", 2, "y")]
    assert packed_rows(df.limit(0), ["f"], ["row_id"]).count() == 0


def test_very_long(spark):
    long = "; ".join(f'"item {i}"' for i in range(30_000))
    df = spark.createDataFrame([(1, long)], "row_id INT, f STRING")
    assert packed_rows(df, ["f"], ["row_id"]).agg(F.max("item_pos"), F.max_by("item", "item_pos")).first()[:] == (30_000, "item 29999")


def test_marks_in_the_text(spark):
    """Characters that the fold uses itself come out as they are."""
    text = 'a\ue000b; "x ""y\ue001"" ; \ue00f\ue00fb \ue005"; \ue010'
    rows = spark.createDataFrame([(text,)], "v STRING").select(items(F.col("v")).alias("x")).first().x
    assert rows == ["a\ue000b", 'x "y\ue001" ; \ue00f\ue00fb \ue005', "\ue010"]
