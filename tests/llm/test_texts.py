import os
import random
import re
from collections import defaultdict

import pytest

from quirewright.llm import leakage, mixture, spans

WORDS = [f"w{i}" for i in range(300)] + ["é", "Straße", "NAÏVE", "x2"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def grams(text, n=13):
    w = [x.lower() for x in re.findall(r"[^\W_]+", text or "")]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, sentence(rng, rng.choice([5, 13, 14, 40, 90]))) for i in range(25)] + [(90, None), (91, ""), (92, items_text := sentence(rng, 60)), (93, items_text)]
    docs = []
    for d in range(300):
        text = sentence(rng, rng.randint(0, 120))
        if rng.random() < 0.6:
            w = rng.choice([t for _, t in items if t]).split()
            n = rng.randint(8, 30)
            at = rng.randrange(max(1, len(w) - n))
            passage = rng.choice([" ", ", ", "\n", "--"]).join(w[at : at + n])
            text = f"{text} {rng.choice([passage, passage.upper() if 'ß' not in passage else passage])} {sentence(rng, rng.randint(0, 20))}"
        docs.append((d, text, "clash"))
    docs += [(1000, None, ""), (1001, "", ""), (1002, "word " * 300_000 + items_text, ""), (1003, items_text, ""), (1003, items_text, "")]
    want = {(i, d) for d, t, _ in docs for i, x in items if grams(t) & grams(x)}
    docs_df = spark.createDataFrame(docs, "doc_id INT, text STRING, item_id STRING")
    items_df = spark.createDataFrame(items, "item_id INT, item_text STRING")
    run = lambda **how: leakage.leaked(docs_df, "doc_id", "text", items_df, "item_id", "item_text", **how)
    got = [tuple(r) for r in run().collect()]
    assert len(got) == len({r[:2] for r in got}) and {r[:2] for r in got} == want and len(got) > 50
    assert {r[2] for r in got if r[1] == 1002 and r[0] >= 92} == {60}
    texts, held = {d: t for d, t, _ in docs}, dict(items)
    for i, d, n, at in got:
        w = [x.lower() for x in re.findall(r"[^\W_]+", texts[d])]
        assert tuple(w[at : at + n]) in grams(held[i], n) and not (d < 1000 and grams(texts[d], n + 1) & grams(held[i], n + 1))
    monkeypatch.setattr(leakage, "HOT_PARTS", 10)
    assert sorted(tuple(r) for r in run(most=0).collect()) == sorted(got)  # both sides shuffled, common fingerprints split
    assert leakage.leaked(docs_df.limit(0), "doc_id", "text", items_df, "item_id", "item_text").count() == 0
    assert leakage.leaked(docs_df, "doc_id", "text", items_df.limit(0), "item_id", "item_text").count() == 0


def test_mixture_keeps_weights_and_caps(spark):
    rng = random.Random(3)
    rows = [(i, s, rng.randint(1, 40)) for i, s in enumerate(["big"] * 3000 + ["mid"] * 300 + ["tiny"] * 10 + [None] * 50)]
    sizes = spark.createDataFrame(rows, "doc_id BIGINT, source STRING, tokens BIGINT")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 4), ("tiny", 0.15, 3), ("gone", 0.05, 2)], "source STRING, target_share DOUBLE, max_repeats INT")
    budget = 20_000
    mix = mixture.mixed(sizes, targets, budget).collect()
    assert len({(r.doc_id, r.repeat) for r in mix}) == len(mix)
    assert sum(r.tokens for r in mix) == max(r.mix_end for r in mix) and budget - 40 < sum(r.tokens for r in mix) <= budget
    report = {r.source: r for r in mixture.mix_report(sizes, targets, mixture.mixed(sizes, targets, budget), budget).collect()}
    have = {s: sum(t for _, x, t in rows if x == s) for s in ("big", "mid", "tiny")}
    assert report["tiny"].mixed_tokens == 3 * have["tiny"] and report["tiny"].falls_short and report["gone"].falls_short
    assert not report["big"].falls_short and not report["mid"].falls_short
    ratio = report["big"].mixed_tokens / report["mid"].mixed_tokens
    assert abs(ratio - 0.5 / 0.3) < 0.02  # what the short ones leave goes to the others in proportion
    first = [r for r in mix if r.source == "mid" and r.repeat == 1]
    assert not first or min(r.finish for r in first) > max(r.finish for r in mix if r.source == "mid" and r.repeat == 0)
    assert {tuple(r) for r in mix} == {tuple(r) for r in mixture.mixed(sizes.repartition(3), targets, budget).collect()}
    assert mixture.mixed(sizes.limit(0), targets, budget).count() == 0
    often = spark.createDataFrame([("tiny", 1.0, 100_000), ("empty", 0.5, 3)], "source STRING, target_share DOUBLE, max_repeats INT")
    few = spark.createDataFrame([(1, "tiny", 7), (2, "tiny", 0), (3, "tiny", 2), (4, "empty", 0)], "doc_id BIGINT, source STRING, tokens BIGINT")
    assert sorted((r.doc_id, r.repeat) for r in mixture.mixed(few, often, 30).where("source = 'tiny' AND tokens > 0").collect()) in (
        sorted([(d, k) for d in (1, 3) for k in range(3)] + [(3, 3)]), sorted([(d, k) for d in (1, 3) for k in range(3)])
    )
    assert mixture.mixed(few, often, 30).where("source = 'empty'").count() == 3


@pytest.mark.skipif(not os.path.exists(mixture.TOKENIZER), reason="no tokenizer file")
def test_token_sizes(spark):
    docs = spark.createDataFrame([(1, "a", "Hello world"), (2, None, None), (3, "a", ""), (4, "b", "é " * 50_000), (5, "b", "x" * 100_000)], "doc_id INT, source STRING, text STRING")
    sizes = {r.doc_id: r.tokens for r in mixture.token_sizes(docs, "doc_id", "source", "text").collect()}
    assert sizes[1] == 2 and sizes[2] == sizes[3] == 0 and sizes[4] > 50_000 and sizes[5] > 1000


def brute_windows(docs, span):
    where = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - span + 1):
            where[t[i : i + span]].add(d)
    return {(d, i) for d, t in docs for i in range(len(t or "") - span + 1) if len(where[t[i : i + span]]) > 1}


def text_docs(rng, span):
    letters = "abcdé 😀"
    pool = ["".join(rng.choices(letters, k=rng.randint(span - 4, 3 * span))) for _ in range(12)]
    docs = []
    for d in range(120):
        t = "".join(rng.choices(letters, k=rng.randint(0, 3 * span)))
        for _ in range(rng.randrange(3)):
            p = rng.choice(pool)
            a = rng.randrange(span // 2)
            t += p[a : rng.randint(len(p) // 2, len(p))] + rng.choice(letters)
        docs.append((d, t))
    return docs + [(500, pool[0] * 2), (501, "a" * 5 * span), (502, "a" * 3 * span), (503, None), (504, ""), (505, pool[1]), (505, pool[1])]


@pytest.mark.parametrize(("span", "bits", "sketch", "grouped"), [(20, None, 1 << 26, 256), (20, 5, 1 << 26, 256), (33, 16, 0, 2), (20, None, 0, 256), (160, None, 1 << 26, 0)])
def test_spans_against_brute_force(spark, span, bits, sketch, grouped):
    rng = random.Random(span)
    docs = text_docs(rng, span)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id INT, text STRING, key STRING").repartition(5)
    runs = spans.shared_runs(df, "doc_id", "text", span, bits, sketch_bytes=sketch, grouped=grouped)
    got = {(r.doc_id, p) for r in runs.collect() for p in range(r.first, r.last + 1)}
    want = brute_windows(docs, span)
    assert got == want and len(want) > 100
    covered = defaultdict(set)
    for d, p in want:
        covered[d].update(range(p, p + span))
    parts = {r.doc_id: r.shared_chars for r in spans.shared_parts(df.dropDuplicates(["doc_id"]), "doc_id", "text", spans.shared_spans(runs, span)).collect()}
    assert parts == {d: len(covered[d]) for d, _ in docs}


def test_spans_of_long_texts(spark):
    rng = random.Random(7)
    base = "".join(rng.choices("abcdefgh ", k=30_000))
    docs = [(1, base), (2, "zz" + base[9_000:17_000] + "yy"), (3, base[:159]), (4, base[100:260])]
    df = spark.createDataFrame(docs, "doc_id INT, text STRING")
    got = {(r.doc_id, p) for r in spans.shared_runs(df, "doc_id", "text", chunk=1 << 12).collect() for p in range(r.first, r.last + 1)}
    assert got == brute_windows(docs, 160)
    assert spans.shared_runs(df.limit(0), "doc_id", "text").count() == 0


DOCUMENTS = "/root/testdata/sf0.1/documents.parquet"


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="the test tables are not here")
@pytest.mark.parametrize(("bits", "sketch"), [(None, 1 << 26), (40, 1 << 26)])
def test_spans_write_less_than_four_times_the_input(spark, bits, sketch):
    """With a sketch, and with one too wide to build: what is shuffled and written, against the input."""
    from quirewright.session import shared_dir

    def disk():
        of = spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0)
        folder = shared_dir(spark).removeprefix("file://")
        return of.totalShuffleWrite() + sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(folder) for f in fs)

    before = disk()
    found = spans.shared_runs(spark.read.parquet(DOCUMENTS), "doc_id", "text", bits=bits, sketch_bytes=sketch).select("doc_id").distinct().count()
    used = (disk() - before) / os.path.getsize(DOCUMENTS)
    print(f"{found} documents, disk {used:.2f} x input")
    assert found > 500 and used < 4
