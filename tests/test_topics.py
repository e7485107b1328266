import math
import random
from collections import Counter

import pytest

from quirewright.operators import topics


def texts(spark, n=240):
    rng = random.Random(9)
    pools = [["grain", "silo", "wheat", "barn"], ["ship", "dock", "crane", "cargo"], ["loan", "bank", "bond", "yield"]]
    rows = [(i, " ".join(rng.choices(pools[i % 3], k=12)) + " the of") for i in range(n)]
    return spark.createDataFrame(rows, "i INT, t STRING")


def test_factors_and_assignment(spark):
    df = texts(spark)
    v = topics.fit_vectorizer(df, "t", 200, 5, stop_words=["the", "of"])
    assert "the" not in v.terms and "grain" in v.terms
    model = topics.fit_topics(v.transform(df, "t"), v.terms, 3, 15)
    assert (model.h >= 0).all() and all(b <= a + 1e-6 for a, b in zip(model.errors, model.errors[1:], strict=False))
    extra = spark.createDataFrame([(-1, ""), (-2, None), (-3, "zzz qqq")], "i INT, t STRING")
    got = {r.i: r for r in topics.assign(df.union(extra), "t", v, model).collect()}
    by_pool = [{got[i].topic_id for i in range(p, 240, 3)} for p in range(3)]
    assert all(len(s) == 1 for s in by_pool) and len(set.union(*by_pool)) == 3
    assert [(got[-1].topic_id, got[-1].topic_label, got[-1].topic_weight)] == [(-1, "", 0.0)] and got[-2].topic_id == -1
    assert (got[-3].topic_id, got[-3].topic_weight) == (0, 0.0)
    assert topics.topic_terms(spark, model, 4).count() == 12
    again = topics.fit_topics(v.transform(df.repartition(3), "t"), v.terms, 3, 15)
    assert [set(t for t, _ in row) for row in again.top_terms(4)] == [set(t for t, _ in row) for row in model.top_terms(4)]


def test_weights_against_a_count(spark):
    rows = texts(spark).collect()
    v = topics.fit_vectorizer(texts(spark), "t", 200, 5, stop_words=["the", "of"])
    number = {t: k for k, t in enumerate(v.terms)}
    words = {r.i: [w for w in r.t.split() if w not in ("the", "of")] for r in rows}
    grams = {i: w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)] for i, w in words.items()}
    held = Counter(g for gs in grams.values() for g in set(gs))
    for r in v.transform(texts(spark), "t").collect():
        want = {number[g]: n * (math.log((1 + len(rows)) / (1 + held[g])) + 1) for g, n in Counter(grams[r.i]).items() if g in number}
        size = math.sqrt(sum(x * x for x in want.values()))
        assert r.idx == sorted(want) and all(abs(x - want[k] / size) < 1e-12 for k, x in zip(r.idx, r.val, strict=True))


def test_too_few_documents(spark):
    with pytest.raises(ValueError, match="must be held by 10"):
        topics.fit_vectorizer(texts(spark, 5), "t")


def test_lda(spark):
    rows = topics.lda_topics(texts(spark), "t", k=3, features=50, min_df=2, n=4).collect()
    assert sum(r.sample_documents for r in rows) == 240 and all(len(r.top_terms.split(", ")) == 4 for r in rows)
