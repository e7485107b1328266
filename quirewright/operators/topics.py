"""Topic models: TF-IDF vectors, non-negative factors fitted on a bounded sample, assignment of every document, LDA.

The factor model is fitted by alternating updates: each partition solves its documents' weights and returns two small
matrices (topics by topics, topics by terms); the driver adds them and updates the term factors. Only these matrices,
never documents, leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirewright.functions.text import CORPUS_STOP_WORDS, ENGLISH_STOP_WORDS, model_terms
from quirewright.operators.skew import join_groups
from quirewright.session import written

STOP_WORDS = ENGLISH_STOP_WORDS + CORPUS_STOP_WORDS
_RIDGE = 1e-9
#: Tasks that the factors are fitted by; each holds a part of the sample.
FITTED_PARTS = 32


@dataclass
class Vectorizer:
    """Vocabulary and inverse document frequencies of a TF-IDF model."""

    counts: CountVectorizerModel
    idf: list[float]
    bigrams: bool
    stop_words: tuple[str, ...]

    @property
    def terms(self) -> list[str]:
        return self.counts.vocabulary

    def grams(self, df: DataFrame, text: str) -> DataFrame:
        return _grams(df, text, self.bigrams, self.stop_words)

    def transform(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` with the arrays ``idx`` and ``val``: term counts times idf, of length 1 in all (empty for no term)."""
        if not self.terms:
            return df.withColumns({"idx": F.array().cast("array<int>"), "val": F.array().cast("array<double>")})
        rows = self.counts.transform(self.grams(df, text)).drop("_grams")
        rows = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_counts", outputCol="_weighed").transform(rows)
        rows = Normalizer(p=2.0, inputCol="_weighed", outputCol="_unit").transform(rows).withColumn("_v", F.unwrap_udt("_unit"))
        return rows.select(*df.columns, F.col("_v.indices").alias("idx"), F.col("_v.values").alias("val"))


def _grams(df: DataFrame, text: str, bigrams: bool, stop_words: Sequence[str]) -> DataFrame:
    rows = df.withColumn("_all", model_terms(F.coalesce(F.col(text), F.lit(""))))
    rows = StopWordsRemover(inputCol="_all", outputCol="_words", stopWords=list(stop_words)).transform(rows).drop("_all")
    if not bigrams:
        return rows.withColumn("_grams", F.col("_words"))
    return NGram(n=2, inputCol="_words", outputCol="_two").transform(rows).withColumn("_grams", F.concat("_words", "_two")).drop("_two")


def fit_vectorizer(
    sample: DataFrame, text: str, features: int = 8000, min_df: int = 10, max_df: float = 0.65, bigrams: bool = True, stop_words: Sequence[str] = STOP_WORDS
) -> Vectorizer:
    """Vocabulary of the most frequent terms of the sample within the frequency bounds, and idf = ln((1+n)/(1+df)) + 1.

    Bigrams are formed after the stop words are gone. Raises if there are fewer documents than ``min_df``: no term could
    be held by so many.
    """
    grams = written(_grams(sample.select(text), text, bigrams, stop_words).select("_grams"), "grams")
    n = grams.count()
    if n < min_df:
        raise ValueError(f"{n} documents, but a term must be held by {min_df}")
    vector = CountVectorizer(inputCol="_grams", outputCol="_counts", vocabSize=features, minDF=float(min_df), maxDF=float(max(max_df * n, min_df)))
    model = vector.fit(grams)
    held = grams.select(F.explode(F.array_distinct("_grams")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = sample.sparkSession.createDataFrame([(t,) for t in model.vocabulary], "term STRING")
    df = dict(held.join(F.broadcast(known), "term").collect())  # at most ``features`` rows
    idf = [float(np.log((1 + n) / (1 + df.get(t, 0))) + 1) for t in model.vocabulary]
    return Vectorizer(model, idf, bigrams, tuple(stop_words))


def long_vectors(vectors: DataFrame, terms: list[str], keep: list[str]) -> DataFrame:
    """(keep, term, weight): the vectors with a row per term, for inspection."""
    names = vectors.sparkSession.createDataFrame(list(enumerate(terms)), "i INT, term STRING")
    pairs = vectors.select(*keep, F.explode(F.arrays_zip("idx", "val")).alias("p")).select(*keep, F.col("p.idx").alias("i"), F.col("p.val").alias("weight"))
    return pairs.join(F.broadcast(names), "i").drop("i")


def exact_vectors(df: DataFrame, text: str, keep: list[str], min_df: int = 10, max_df: float = 0.65, bigrams: bool = True, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(keep, term, weight) of every document, over all terms within the frequency bounds, however many they are.

    The bounds and weights are those of ``fit_vectorizer`` and ``transform``; document frequencies are joined, so no
    vocabulary reaches the driver. Fewer documents than ``min_df`` have no term.
    """
    sorted_ = _grams(df, text, bigrams, stop_words).select(*keep, F.monotonically_increasing_id().alias("_doc"), F.array_sort("_grams").alias("_s"))
    size = F.size("_s")
    numbers = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(numbers, lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1)))
    docs = written(sorted_.withColumn("_at", starts), "sorted")
    runs = F.transform("_at", lambda at, k: F.struct(F.get("_s", at).alias("term"), (F.coalesce(F.get("_at", k + 1), size) - at).alias("_tf")))
    pairs = docs.select(*keep, "_doc", F.inline(runs))
    n = docs.count()
    held = written(pairs.groupBy("term").agg(F.count(F.lit(1)).alias("_df")).where((F.col("_df") >= min_df) & (F.col("_df") <= max(max_df * n, min_df))), "held")
    total = held.agg(F.coalesce(F.sum("_df"), F.lit(0))).first()[0]
    known = join_groups(pairs, held, ["term"], "_df", total)
    raw = known.withColumn("_w", F.col("_tf") * (F.log((1.0 + n) / (1 + F.col("_df"))) + 1))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("_doc")))
    return raw.select(*keep, "term", (F.col("_w") / norm).alias("weight"))


def _flat(idx, val) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of every entry."""
    sizes = [0 if i is None else len(i) for i in idx]
    some = [(i, v) for i, v, n in zip(idx, val, sizes, strict=True) if n]
    cols = np.concatenate([np.asarray(i, np.int64) for i, _ in some]) if some else np.zeros(0, np.int64)
    vals = np.concatenate([np.asarray(v, float) for _, v in some]) if some else np.zeros(0)
    return np.repeat(np.arange(len(sizes)), sizes), cols, vals


def _sums(at: np.ndarray, size: int, of: np.ndarray, m: np.ndarray, vals: np.ndarray) -> np.ndarray:
    """Row ``at`` of the result gets, for every entry, its value times row ``of`` of ``m``."""
    return np.stack([np.bincount(at, vals * m[of, t], size) for t in range(m.shape[1])], axis=1)


def _weights(cross: np.ndarray, gram: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Non-negative least squares of every row x on the rows of h, from x h' and h h', by coordinate descent."""
    diag = np.maximum(np.diag(gram), _RIDGE)
    w = np.zeros_like(cross)
    for _ in range(sweeps):
        before = w.copy()
        for t in range(len(gram)):
            w[:, t] = np.maximum(w[:, t] + (cross[:, t] - w @ gram[:, t]) / diag[t], 0)
        if np.abs(w - before).max(initial=0) < 1e-8:
            break
    return w


@dataclass
class TopicModel:
    """Term factors of a fitted model, with the terms they stand for and the errors of the iterations."""

    h: np.ndarray
    terms: list[str]
    errors: list[float]

    def top_terms(self, n: int = 15) -> list[list[tuple[str, float]]]:
        """The ``n`` heaviest terms of each topic; ties by term."""
        return [sorted(zip(self.terms, row.tolist(), strict=True), key=lambda t: (-t[1], t[0]))[:n] for row in self.h]

    def labels(self) -> list[str]:
        return [", ".join(t for t, _ in row[:5]) for row in self.top_terms(5)]


def _block_sums(vectors: DataFrame, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """W'W, W'X and the squared error, added over all partitions."""
    k, width = h.shape
    shared = vectors.sparkSession.sparkContext.broadcast(h)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wtw, wtx, error = np.zeros((k, k)), np.zeros((k, width)), 0.0
        gram, by_term = shared.value @ shared.value.T, np.ascontiguousarray(shared.value.T)
        for b in batches:
            rows, cols, vals = _flat(b["idx"], b["val"])
            cross = _sums(rows, len(b), cols, by_term, vals)
            w = _weights(cross, gram)
            wtw, wtx = wtw + w.T @ w, wtx + _sums(cols, width, rows, w, vals).T
            error += float((vals * vals).sum() - 2 * (w * cross).sum() + ((w @ gram) * w).sum())
        yield pd.DataFrame({"a": [wtw.tobytes()], "b": [wtx.tobytes()], "e": [error]})

    parts = vectors.select("idx", "val").mapInPandas(run, "a BINARY, b BINARY, e DOUBLE").collect()  # one row per partition
    wtw = sum((np.frombuffer(p.a).reshape(k, k) for p in parts), np.zeros((k, k)))
    wtx = sum((np.frombuffer(p.b).reshape(k, width) for p in parts), np.zeros((k, width)))
    return wtw, wtx, sum(p.e for p in parts)


def _start(vectors: DataFrame, width: int, k: int, seed: int) -> np.ndarray:
    """Factors from the leading directions of the term covariance, found by power iteration; zeros get the mean."""
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((width, k)))[0]
    mean = 0.0
    for _ in range(4):
        shared = vectors.sparkSession.sparkContext.broadcast(q)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            y, total, n = np.zeros((width, k)), 0.0, 0
            for b in batches:
                rows, cols, vals = _flat(b["idx"], b["val"])
                y += _sums(cols, width, rows, _sums(rows, len(b), cols, shared.value, vals), vals)
                total, n = total + float(vals.sum()), n + len(b) * width
            yield pd.DataFrame({"y": [y.tobytes()], "t": [total], "n": [n]})

        parts = vectors.select("idx", "val").mapInPandas(run, "y BINARY, t DOUBLE, n BIGINT").collect()
        y = sum((np.frombuffer(p.y).reshape(width, k) for p in parts), np.zeros((width, k)))
        mean = sum(p.t for p in parts) / max(sum(p.n for p in parts), 1)
        q = np.linalg.qr(y)[0]
    h = np.zeros((k, width))
    for t in range(k):
        up, down = np.maximum(q[:, t], 0), np.maximum(-q[:, t], 0)
        h[t] = up if np.linalg.norm(up) >= np.linalg.norm(down) else down
    h[h < 1e-12] = max(mean, 1e-6)
    return h


def fit_topics(vectors: DataFrame, terms: list[str], k: int = 12, rounds: int = 30, tolerance: float = 1e-4, seed: int = 42) -> TopicModel:
    """Non-negative factors of the sample's vectors; the error never rises from round to round."""
    # of a bounded sample, so in few parts: each returns matrices of topics by terms
    vectors = written(vectors.select("idx", "val").coalesce(FITTED_PARTS), "vectors")
    width = len(terms)
    h, errors = _start(vectors, width, k, seed), []
    for _ in range(rounds):
        wtw, wtx, error = _block_sums(vectors, h)
        errors.append(error)
        if len(errors) > 1 and errors[-2] - error < tolerance * errors[0]:
            break
        for _ in range(10):
            for t in range(k):
                h[t] = np.maximum(h[t] + (wtx[t] - wtw[t] @ h) / max(wtw[t, t], _RIDGE), 0)
        h[h.sum(axis=1) == 0] = 1e-6
    return TopicModel(h, terms, errors)


def assign(df: DataFrame, text: str, vectorizer: Vectorizer, model: TopicModel, prefix: str = "") -> DataFrame:
    """``df`` with topic_id, topic_label and topic_weight (with ``prefix``) of every document.

    An empty or null text has topic -1, no label and weight 0; a text without any known term has topic 0, weight 0.
    Of equal weights the lowest topic counts.
    """
    shared = df.sparkSession.sparkContext.broadcast(model.h)

    @F.pandas_udf("topic SMALLINT, weight FLOAT")
    def best(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        h = shared.value
        gram, by_term = h @ h.T, np.ascontiguousarray(h.T)
        for idx, val in parts:
            rows, cols, vals = _flat(idx, val)
            w = _weights(_sums(rows, len(idx), cols, by_term, vals), gram)
            yield pd.DataFrame({"topic": w.argmax(axis=1).astype(np.int16), "weight": w.max(axis=1, initial=0).astype(np.float32)})

    rows = vectorizer.transform(df, text).withColumn("_best", best("idx", "val"))
    some = F.length(F.coalesce(F.col(text), F.lit(""))) > 0
    labels = F.array(*map(F.lit, model.labels()))
    return rows.withColumns(
        {
            f"{prefix}topic_id": F.when(some, F.col("_best.topic")).otherwise(F.lit(-1)).cast("smallint"),
            f"{prefix}topic_label": F.when(some, F.get(labels, F.col("_best.topic").cast("int"))).otherwise(F.lit("")),
            f"{prefix}topic_weight": F.when(some, F.col("_best.weight")).otherwise(F.lit(0.0)).cast("float"),
        }
    ).drop("_best", "idx", "val")


def topic_terms(df_session, model: TopicModel, n: int = 15) -> DataFrame:
    """(topic_id, rank, term, weight, topic_label)."""
    rows = [(t, r, term, float(w), label) for t, (row, label) in enumerate(zip(model.top_terms(n), model.labels(), strict=True)) for r, (term, w) in enumerate(row, 1)]
    return df_session.createDataFrame(rows, "topic_id INT, rank INT, term STRING, weight DOUBLE, topic_label STRING")


def lda_topics(sample: DataFrame, text: str, k: int = 10, features: int = 5000, min_df: int = 8, n: int = 10, seed: int = 42, corpus: DataFrame | None = None) -> DataFrame:
    """(topic_id, top_terms, sample_documents) of a variational LDA on word counts, 20 iterations over the sample.

    The vocabulary is that of ``corpus`` where it is given, else of the sample.
    """
    v = fit_vectorizer(sample if corpus is None else corpus, text, features, min_df, bigrams=False)
    counted = v.counts.transform(v.grams(sample, text)).select(F.col("_counts").alias("features"))
    model = LDA(k=k, maxIter=20, optimizer="online", subsamplingRate=1.0, seed=seed).fit(counted)
    spark = sample.sparkSession
    described = model.describeTopics(n).select("topic", "termIndices").collect()  # k rows
    names = [(r.topic, ", ".join(v.terms[i] for i in r.termIndices)) for r in described]
    weights = vector_to_array("topicDistribution")
    sizes = model.transform(counted).select((F.array_position(weights, F.array_max(weights)) - 1).cast("int").alias("topic_id"))
    sizes = sizes.groupBy("topic_id").agg(F.count(F.lit(1)).alias("sample_documents"))
    table = spark.createDataFrame(names, "topic_id INT, top_terms STRING")
    return table.join(sizes, "topic_id", "left").select("topic_id", "top_terms", F.coalesce("sample_documents", F.lit(0).cast("bigint")).alias("sample_documents"))
