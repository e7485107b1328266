import random

from quirewright.llm.catalog import place_aliases
from quirewright.llm.places import ALIAS_SCHEMA, Places, Trie, allowed, candidates, clean, decided, mapped_places, unmatched_values

ENTRIES = [
    (1, "Saint Brannoc", "TX", "Texas"),
    (2, "Mount Ossery", "OH", "Ohio"),
    (3, "Mount Ossery", "GA", "Georgia"),
    (4, "Rivière-Blême", "QC", "Quebec"),
    (5, "Old Pellham", "OH", "Ohio"),
    (6, "Windlass", "NY", "New York"),
    (7, None, "NY", "New York"),
]
CASES = {
    ("St. Brannoc", "TX"): (1, "matched"),
    ("SAINT BRANOC", None): (1, "matched"),
    ("Mt Ossery", "Ga."): (3, "matched"),
    ("Mount Ossery", None): (0, "ambiguous"),
    ("Mount Ossery", "XX"): (0, "unlisted"),
    ("Windlass", "Bavaria"): (0, "unlisted"),
    ("Mount Ossery", "TX"): (0, "unlisted"),
    ("Mount Ossery, Ohio", None): (2, "matched"),
    ("Mount Ossery / Ohio", "GA"): (0, "unlisted"),
    ("riviere bleme", "Que."): (4, "matched"),
    ("OH", "Old Pelham"): (5, "matched"),
    ("City of Windlass (USA)", "NY 10001"): (6, "matched"),
    ("Windlass NY", None): (6, "matched"),
    ("Windlass, N.Y.", "N.Y."): (6, "matched"),
    ("W1nd1ass", "NY"): (6, "matched"),
    ("Winds", "NY"): (0, "unlisted"),
    ("--", "NY"): (0, "unlisted"),
    (None, None): (0, "unlisted"),
}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_brute_force():
    rng = random.Random(1)
    names = sorted({"".join(rng.choices("abc", k=rng.randint(1, 8))) for _ in range(120)})
    trie = Trie()
    for n in names:
        trie.add(n, n)
    for _ in range(150):
        typed = "".join(rng.choices("abcd", k=rng.randint(1, 9)))
        for errors in (0, 1, 2):
            assert trie.search(typed, errors) == {n: distance(n, typed) for n in names if distance(n, typed) <= errors}
    assert trie.search("", 2) == {} and [allowed(n) for n in (3, 4, 6, 7)] == [0, 1, 1, 2]


def test_resolution(spark):
    places = Places(ENTRIES, [tuple(r) for r in place_aliases(spark).collect()])
    assert {k: decided(places.meant(*k)) for k in CASES} == CASES
    assert decided(Places(ENTRIES, []).meant("St. Brannoc", "TX")) == (0, "unlisted")  # aliases come from the table alone


def test_rows(spark):
    reference = spark.createDataFrame(ENTRIES, "place_id INT, city STRING, province STRING, province_name STRING")
    rows = [(i, c, p, "x") for i, (c, p) in enumerate(CASES)] + [(100, "Windlass", "NY", "x"), (101, " n/a ", "NY", "x"), (102, "Windlass", "N/A", "x"), (103, "w" * 100_000, "NY", "x")]
    rows += [(1000 + i, "Windlas", "NY", "x") for i in range(300)]
    df = spark.createDataFrame(rows, "row_id INT, city STRING, province STRING, place_id STRING")
    aliases = place_aliases(spark)
    mapped = mapped_places(df, reference, aliases, "row_id", "city", "province")
    got = {r.row_id: (r.place_id, r.status) for r in mapped.collect()}
    want = {i: v for i, v in enumerate(CASES.values()) if list(CASES)[i][0] is not None}
    assert got == want | {102: (6, "matched"), 103: (0, "unlisted")} | {1000 + i: (6, "matched") for i in range(300)}
    assert unmatched_values(mapped).count() == sum(1 for v in got.values() if v[0] == 0)
    in_blocks = mapped_places(df, reference, aliases, "row_id", "city", "province", block=2)
    assert {r.row_id: (r.place_id, r.status) for r in in_blocks.collect()} == got
    assert mapped_places(df.limit(0), reference, aliases, "row_id", "city", "province").count() == 0
    assert mapped_places(df.limit(0), reference, aliases, "row_id", "city", "province", block=2).count() == 0
    assert {r.place_id for r in mapped_places(df, reference.limit(0), aliases, "row_id", "city", "province").collect()} == {0}


def test_candidates_against_brute_force(spark):
    rng = random.Random(4)
    names = sorted({"".join(rng.choices("abc", k=rng.randint(1, 8))) for _ in range(60)})
    entries = [(i, n, "X", "Ex") for i, n in enumerate(names)] + [(900, "Mount Abc", "X", "Ex"), (901, None, "X", "Ex")]
    typed = ["".join(rng.choices("abcd", k=rng.randint(1, 9))) for _ in range(80)] + ["Mt. Abc", "mt abcc", None, " N/A ", "--"]
    reference = spark.createDataFrame(entries, "place_id INT, city STRING, province STRING, province_name STRING")
    df = spark.createDataFrame([(t, 1) for t in typed + typed], "city STRING, place_id INT")
    aliases = spark.createDataFrame([("first_word", "mount", "mt")], ALIAS_SCHEMA)
    forms = {i: ["".join(clean(n))] for i, n, _, _ in entries if n} | {900: ["mountabc", "mtabc"]}
    want = set()
    for t in typed[:-3]:
        key = "".join(clean(t))
        for i, names in forms.items():
            least = min(distance(n, key) for n in names)
            if least <= allowed(len(key)):
                want.add((t, i, least))
    for block in (200_000, 7):
        rows = [tuple(r) for r in candidates(df, reference, aliases, "city", block).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
