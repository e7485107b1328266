"""Evaluation texts that leaked into a corpus: winnowed word k-grams, joined and extended.

A text's fingerprints are the smallest k-gram hashes of each window of w consecutive k-grams. Two texts that share
k + w - 1 consecutive words share a window and so a fingerprint; with k + w - 1 = ``min_words`` no shared passage of
that length is lost. Each fingerprint carries the hashes of the words beside it, as many as a passage of that length may
reach, so the join extends a hit where it finds it and drops shorter or accidental ones; the extended hits of one
passage overlap and are put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirewright.operators.skew import HOT_PARTS
from quirewright.session import broadcast_if_small, written

#: Words of a k-gram; the window is as wide as the guaranteed length allows.
K = 8
#: Fingerprints of held-out texts up to which they are broadcast, with the words beside them; more are shuffled.
BROADCAST_PRINTS = 500_000
#: Parts that a fingerprint is split into if it stands in very many documents.
SALTS = 64
_MEMO = 500_000
_WORD = re.compile(r"[^\W_]+")


def _combined(h, k: int):
    """Hashes of all runs of k words: a polynomial of the words' hashes, mixed."""
    import numpy as np

    n = len(h) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


class _Words:
    """Texts as one array of word hashes with the bounds of each text."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def read(self, texts: list[str | None]):
        import numpy as np
        import xxhash

        if len(self.memo) > _MEMO:
            self.memo.clear()
        memo, hashes, ends = self.memo, [], []
        for t in texts:
            for w in _WORD.findall(t) if t else ():
                v = memo.get(w)
                if v is None:
                    v = memo[w] = xxhash.xxh64_intdigest(w.lower().encode())
                hashes.append(v)
            ends.append(len(hashes))
        ends = np.array(ends, np.int64)
        return np.array(hashes, np.uint64), np.concatenate([np.zeros(1, np.int64), ends[:-1]]), ends


def _fingerprints(h, starts, ends, k: int, w: int):
    """(position, hash) of the winnowed k-grams; windows over the border of two texts only add some."""
    import numpy as np

    grams = _combined(h, k)
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64), grams
    owner = np.repeat(np.arange(len(ends)), ends - starts)
    inside = owner[:n] == owner[k - 1 : k - 1 + n]
    grams = np.where(inside, grams, np.uint64(2**64 - 1))
    padded = np.concatenate([grams, np.full(w - 1, 2**64 - 1, np.uint64)])
    least = padded[:n].copy()
    for j in range(1, w):
        np.minimum(least, padded[j : j + n], out=least)
    most = least.copy()  # the largest of the minima of the windows that hold a position: equal to it if it is selected
    for j in range(1, w):
        np.maximum(most[j:], least[:-j] if j else least, out=most[j:])
    at = np.flatnonzero((most == grams) & inside)
    return at, grams[at]


def _printer(k: int, w: int, side: int, outside: int):
    """(g, id, pos, beside) of every fingerprint: ``beside`` holds the words to its left, nearest first, then to its right.

    ``outside`` stands for the words beyond the ends of a text, another number for either side of the join.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        words = _Words()
        steps = np.concatenate([-np.arange(1, side + 1), k - 1 + np.arange(1, side + 1)])
        for b in batches:
            h, start, end = words.read(b.column(1).to_pylist())
            at, grams = _fingerprints(h, start, end, k, w)
            if not len(at):
                continue
            owner = np.repeat(np.arange(len(end)), end - start)[at]
            near = at[:, None] + steps
            inside = (near >= start[owner][:, None]) & (near < end[owner][:, None])
            beside = np.where(inside, (h[np.clip(near, 0, len(h) - 1)] >> np.uint64(33)).astype(np.int32), np.int32(outside))
            offsets = pa.array(np.arange(len(at) + 1) * len(steps), pa.int32())
            yield pa.record_batch(
                [
                    pa.array(grams.view(np.int64)),
                    b.column(0).take(pa.array(owner)),
                    pa.array((at - start[owner]).astype(np.int32)),
                    pa.ListArray.from_arrays(offsets, pa.array(beside.ravel())),
                ],
                names=["g", "id", "pos", "beside"],
            )

    return run


def fingerprints(df: DataFrame, id_column: str, text: str, min_words: int, outside: int) -> DataFrame:
    """(g, id, pos, beside) of the winnowed k-grams of all texts."""
    k = min(K, min_words)
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL")
    return rows.mapInArrow(_printer(k, min_words - k + 1, min_words - k, outside), "g BIGINT, id BIGINT, pos INT, beside ARRAY<INT>")


def _matched(docs: DataFrame, items: DataFrame, most: int) -> DataFrame:
    """Pairs of equal fingerprints, with the columns of both sides (``i_*`` of the items).

    Few items are broadcast, and the corpus is not shuffled. Else both are shuffled by fingerprint; one that stands in
    more than one part in HOT_PARTS of all documents' fingerprints is split into parts of documents.
    """
    named = items.select("g", *(F.col(c).alias(f"i_{c}") for c in ("id", "pos", "beside")))
    few = broadcast_if_small(named, most)
    if few is not named:
        return docs.join(few, "g")
    docs = written(docs.join(named.select("g").distinct(), "g", "left_semi"), "corpus_prints")
    counts = docs.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    total = docs.count()
    hot = F.broadcast(written(counts.where(F.col("n") > total // HOT_PARTS), "hot_prints").select("g", F.lit(True).alias("hot")))
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = F.when(F.col("hot"), F.pmod(F.xxhash64("id", "pos"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    left = docs.join(hot, "g", "left").withColumn("part", spread).drop("hot")
    right = named.join(hot, "g", "left").withColumn("part", F.explode(parts)).drop("hot")
    return left.join(right, ["g", "part"])


def _agreeing(a: Column, b: Column, first: int, side: int) -> Column:
    """How many of the words from place ``first`` on agree before one differs."""
    same = F.zip_with(F.slice(a, first, side), F.slice(b, first, side), lambda x, y: x == y)
    differs = F.array_position(same, False)
    return F.when(differs == 0, F.lit(side)).otherwise(differs - 1).cast("int")


def leaked(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, min_words: int = 13, most: int = BROADCAST_PRINTS) -> DataFrame:
    """(item_id, doc_id, shared_words, word_pos): each document that holds ``min_words`` consecutive words of an item.

    One row per pair, with the longest shared run and where it (the first of equals) begins in the document. Words are
    the longest runs of letters and digits, letter case ignored. Null and empty texts match nothing, rows without an id
    are left out, and rows that repeat an id count as one. The corpus is read once, however many items there are, and
    not shuffled as long as the items have at most ``most`` fingerprints.
    """
    k = min(K, min_words)
    side = min_words - k
    prints = written(fingerprints(items, item_id, item_text, min_words, -1), "item_prints")
    pairs = _matched(fingerprints(docs, doc_id, text, min_words, -2), prints, most)
    left = _agreeing(F.col("beside"), F.col("i_beside"), 1, side) if side else F.lit(0)
    right = _agreeing(F.col("beside"), F.col("i_beside"), side + 1, side) if side else F.lit(0)
    hits = pairs.withColumns({"left": left, "right": right}).where(F.col("left") + F.col("right") + k >= min_words)
    runs = hits.select(
        F.col("i_id").alias("item_id"), F.col("id").alias("doc_id"), (F.col("i_pos") - F.col("pos")).alias("shift"), (F.col("pos") - F.col("left")).alias("low"), (F.col("pos") + k + F.col("right")).alias("high")
    )
    by_run = Window.partitionBy("item_id", "doc_id", "shift").orderBy("low", "high")
    apart = F.coalesce(F.col("low") > F.max("high").over(by_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)).cast("int")
    numbered = runs.withColumn("apart", apart).withColumn("run", F.sum("apart").over(by_run))
    whole = numbered.groupBy("item_id", "doc_id", "shift", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    best = F.min(F.struct((F.col("low") - F.col("high")).alias("size"), F.col("low").alias("low")))
    return whole.groupBy("item_id", "doc_id").agg(best.alias("b")).select("item_id", "doc_id", (-F.col("b.size")).alias("shared_words"), F.col("b.low").alias("word_pos"))
