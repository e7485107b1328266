"""Resolution of variant publication names: blocked pairs, a decision ladder, components, canonical names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirewright.functions.text import clean, joined_set, key, name_anchors, publication_key
from quirewright.operators.duplicates import keep_first
from quirewright.operators.summaries import ranked
from quirewright.session import broadcast_if_small, written

#: The outcomes of the ladder, its thresholds, and how far lengths of compared names may differ.
EXACT = "auto-merge; exact normalized publication"
CONFLICT = "keep separate; conflicting anchor tokens"
LOW_SAME = "keep separate; low-information anchor tokens"
SAME = "auto-merge; same anchor tokens"
LOW_SUBSET = "keep separate; low-information subset anchors"
SUBSET_WITH_ID = "auto-merge; subset anchor tokens with shared publication id"
NEAR_WITH_METADATA = "review; metadata-backed near match"
STRONG_OVERLAP = "review; strong title overlap"
LOW = "keep separate; low evidence"
SAME_CHARACTERS, SUBSET_CHARACTERS = 0.6, 0.72
NEAR_OVERLAP, NEAR_CHARACTERS = 0.6, 0.82
STRONG_WORDS, STRONG_CHARACTERS = 0.75, 0.9
LENGTH_BAND = 18


@F.pandas_udf(T.DoubleType())
def character_similarity(left: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Matching-blocks ratio of two keys, in this order; there is no built-in expression for it."""
    from difflib import SequenceMatcher

    for a, b in left:
        yield pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def _word_features(pairs: DataFrame) -> DataFrame:
    """What two names have in common by their words; ``pairs`` has left, right and the two flags of shared metadata.

    Keys and anchors (lk, rk, la, ra) that the pairs have already are not made again.
    """
    made = {"lk": key(F.col("left")), "rk": key(F.col("right")), "la": name_anchors(F.col("left")), "ra": name_anchors(F.col("right"))}
    rows = pairs.withColumns({c: x for c, x in made.items() if c not in pairs.columns})
    la, ra = F.col("la"), F.col("ra")
    shared, left_only, right_only = F.array_intersect(la, ra), F.array_except(la, ra), F.array_except(ra, la)
    union = F.size(F.array_union(la, ra))
    exact = F.col("lk") == F.col("rk")
    return rows.withColumns(
        {
            "token_overlap": F.when(union == 0, F.lit(1.0)).otherwise(F.size(shared) / F.nullif(union, F.lit(0))),
            "shared_anchor_tokens": joined_set(shared),
            "left_only_anchor_tokens": joined_set(left_only),
            "right_only_anchor_tokens": joined_set(right_only),
            "anchor_conflict": (F.size(shared) > 0) & (F.size(left_only) > 0) & (F.size(right_only) > 0),
            "exact": exact,
            "same_anchor_tokens": _subset(la, ra) & _subset(ra, la),
            "subset_anchor_tokens": (F.size(la) > 0) & (F.size(ra) > 0) & (_subset(la, ra) | _subset(ra, la)),
            "metadata_support": F.col("shared_publication_id") | F.col("shared_top_publisher"),
            "low_information_anchor_match": (F.size(shared) <= 1) & ~exact,
        }
    ).drop("la", "ra")


def _ladder(rows: DataFrame) -> DataFrame:
    """The outcome of every pair: the first rule that fits decides, those by words before those by characters."""
    c, low, support = F.col("char_similarity"), F.col("low_information_anchor_match"), F.col("metadata_support")
    same, subset, overlap = F.col("same_anchor_tokens"), F.col("subset_anchor_tokens"), F.col("token_overlap")
    rules = (
        (F.col("exact"), EXACT),
        (F.col("anchor_conflict"), CONFLICT),
        (same & low, LOW_SAME),
        (same & ((c >= SAME_CHARACTERS) | support), SAME),
        (subset & low, LOW_SUBSET),
        (subset & F.col("shared_publication_id") & (c >= SUBSET_CHARACTERS), SUBSET_WITH_ID),
        (support & (overlap >= NEAR_OVERLAP) & (c >= NEAR_CHARACTERS), NEAR_WITH_METADATA),
        ((overlap >= STRONG_WORDS) & (c >= STRONG_CHARACTERS), STRONG_OVERLAP),
    )
    outcome = F.coalesce(*(F.when(rule, F.lit(name)) for rule, name in rules), F.lit(LOW))
    rows = rows.withColumn("recommendation", outcome)
    rows = rows.withColumns({"auto_merge": F.col("recommendation").startswith("auto-merge"), "needs_review": F.col("recommendation").startswith("review")})
    return rows.drop("lk", "rk", "exact")


def compared_names(pairs: DataFrame, similarity: Column | None = None) -> DataFrame:
    """The features of every pair and the outcome of the ladder.

    ``pairs`` has left, right, shared_publication_id and shared_top_publisher.
    """
    rows = _word_features(pairs)
    return _ladder(rows.withColumn("char_similarity", character_similarity(F.col("lk"), F.col("rk")) if similarity is None else similarity))


def _hopeful(rows: DataFrame) -> DataFrame:
    """The pairs that the ladder accepts or puts to review if their characters are alike enough; the others need no comparison."""
    words = F.col("same_anchor_tokens") | (F.col("subset_anchor_tokens") & F.col("shared_publication_id"))
    words = words | (F.col("metadata_support") & (F.col("token_overlap") >= NEAR_OVERLAP)) | (F.col("token_overlap") >= STRONG_WORDS)
    return rows.where(F.col("exact") | (~F.col("anchor_conflict") & ~F.col("low_information_anchor_match") & words))


def candidate_pairs(media: DataFrame) -> DataFrame:
    """(left, right, shared_publication_id, shared_top_publisher, lk, rk, la, ra): pairs of names that the ladder can accept, larger publication on the left (ties by name).

    An accepted pair has equal keys, or shares two anchor words at least and has no conflict, so the anchors of one name
    are a subset of the other's. Each name of two anchors or more is therefore joined by its two rarest together, to the
    names that hold both; nothing is lost, and a word that many names hold pairs none of them. Names that differ by more
    than the length band are not compared.
    """
    names = media.select(
        F.col("publication_title_canonical").alias("name"), "documents", "publication_ids", clean(F.col("top_publisher")).alias("publisher")
    ).where("name IS NOT NULL")
    named = written(names.withColumns({"anchors": F.array_sort(name_anchors(F.col("name"))), "key": key(F.col("name"))}), "names")
    words = named.where(F.size("anchors") > 1).select("name", F.explode("anchors").alias("word"))
    frequency = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # two structs a name suffice; the smallest two come from sorting at most as many as a name has words
    rarest = words.join(frequency, "word").groupBy("name").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "word"))), 1, 2).alias("r"))
    small = named.join(rarest.select("name", F.array_sort(F.transform("r", lambda x: x["word"])).alias("two")), "name")
    small = written(small, "rarest")
    wanted = small.select("two").distinct()
    several = F.transform("anchors", lambda w, i: F.transform(F.slice("anchors", i + 2, F.size("anchors")), lambda v: F.array(w, v)))
    large = named.where(F.size("anchors") > 1).withColumn("two", F.explode(F.flatten(several))).join(wanted, "two", "left_semi")
    near = F.abs(F.length("a.name") - F.length("b.name")) <= LENGTH_BAND
    other = F.col("a.name") != F.col("b.name")
    columns = ["name", "documents", "publication_ids", "publisher", "key", "anchors"]
    both = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "ab" for c in columns]
    by_words = small.alias("a").join(large.alias("b"), (F.col("a.two") == F.col("b.two")) & other & near & _subset(F.col("a.anchors"), F.col("b.anchors"))).select(*both)
    by_key = named.alias("a").join(named.alias("b"), (F.col("a.key") == F.col("b.key")) & other & near).select(*both)
    joined = by_words.union(by_key)
    ids = F.arrays_overlap(F.split(F.coalesce("a_publication_ids", F.lit("")), "; "), F.split(F.coalesce("b_publication_ids", F.lit("")), "; "))
    first = (F.col("a_documents") > F.col("b_documents")) | ((F.col("a_documents") == F.col("b_documents")) & (F.col("a_name") < F.col("b_name")))
    of = lambda c, left: F.when(first == left, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    pairs = joined.select(
        of("name", True).alias("left"),
        of("name", False).alias("right"),
        ids.alias("shared_publication_id"),
        ((F.col("a_publisher") == F.col("b_publisher")) & (F.col("a_publisher") != "")).alias("shared_top_publisher"),
        of("key", True).alias("lk"),
        of("key", False).alias("rk"),
        of("anchors", True).alias("la"),
        of("anchors", False).alias("ra"),
    )
    return written(pairs.distinct(), "pairs")


def alias_audit(media: DataFrame) -> DataFrame:
    """Every pair of names to merge or to review, with its evidence; two empty id lists count as shared.

    Characters are compared last, and only for the pairs that can still be accepted.
    """
    rows = _hopeful(_word_features(candidate_pairs(media)))
    found = _ladder(rows.withColumn("char_similarity", character_similarity(F.col("lk"), F.col("rk")))).where("auto_merge OR needs_review")
    return found.select(
        F.col("left").alias("publication_left"),
        F.col("right").alias("publication_right"),
        "char_similarity",
        "token_overlap",
        "shared_anchor_tokens",
        "left_only_anchor_tokens",
        "right_only_anchor_tokens",
        "anchor_conflict",
        "shared_publication_id",
        "shared_top_publisher",
        "auto_merge",
        "recommendation",
    )


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node of each connected component; ``nodes`` (node), ``edges`` (src, dst).

    Labels of small numbers of nodes travel along edges and then jump to the label of their label, so a chain of n
    nodes takes about log n rounds. Only nodes that have an edge take part; the others are components of their own.
    Each round is written, which cuts the lineage. Raises if ``rounds`` are not enough.
    """
    both = written(edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).where("src <> dst").distinct(), "edges")
    linked = both.select(F.col("src").alias("node")).distinct()
    alone = nodes.join(linked, "node", "left_anti").select("node", F.col("node").alias("component"))
    labels = written(nodes.join(linked, "node", "left_semi").select("node", F.col("node").alias("label")), "labels")
    if labels.isEmpty():
        return alone
    for _ in range(rounds):
        near = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("label").alias("near"))
        low = labels.join(near, labels.node == near.src, "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = low.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = written(low.join(jump, low.label == jump.via, "left").select("node", "old", F.least("label", "far").alias("label")), "labels")
        if new.where("label <> old").isEmpty():
            return new.select("node", F.col("label").alias("component")).union(alone)
        labels = new.select("node", "label")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def canonical_map(media: DataFrame, audit: DataFrame) -> DataFrame:
    """(publication_title, canonical_title): the representative of each group of merged names.

    It has the most documents, then is the shortest, then the first by name; the order of the merges does not matter.
    """
    names = media.where("publication_title_canonical IS NOT NULL").select(F.col("publication_title_canonical").alias("node"), "documents")
    names = written(names, "names")
    edges = audit.where("auto_merge").select(F.col("publication_left").alias("src"), F.col("publication_right").alias("dst"))
    groups = components(names.select("node"), edges).join(names, "node")
    best = groups.groupBy("component").agg(F.min(F.struct((-F.col("documents")).alias("d"), F.length("node").alias("l"), F.col("node").alias("n"))).alias("best"))
    return groups.join(best, "component").select(F.col("node").alias("publication_title"), F.col("best.n").alias("canonical_title"))


def canonicalised(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """``df`` with publication_title_canonical from the map, else as it was, else the normalised name."""
    small = broadcast_if_small(mapping.select(F.col("publication_title").alias("_name"), F.col("canonical_title").alias("_canonical")))
    joined = df.join(small, df.publication_title_normalized == F.col("_name"), "left")
    known = [F.col("publication_title_canonical")] if "publication_title_canonical" in df.columns else []
    return joined.withColumn("publication_title_canonical", F.coalesce("_canonical", *known, "publication_title_normalized")).drop("_name", "_canonical")


def watched(media: DataFrame, watch_list: DataFrame, top: int = 35) -> DataFrame:
    """The most frequent publications and the watched ones in one table, one row per name key.

    A watched publication joins what is observed under its key; observed rows come first, larger ones before smaller.
    """
    observed = ranked(media, "documents", "publication_title_canonical", "corpus_rank")
    observed = observed.withColumn("publication_key", publication_key(F.col("publication_title_canonical")))
    wanted = watch_list.withColumn("publication_key", publication_key(F.col("reference_publication")))
    shown = ["documents", "corpus_rank", "first_year", "last_year", "top_source_type"]
    matched = wanted.join(observed, "publication_key", "left").select(
        "publication_key",
        F.coalesce("display_publication_title", "reference_publication").alias("publication"),
        *shown,
        F.lit(True).alias("real_world_reference"),
        "reference_role",
        F.lit("reference outlet").alias("why_included"),
    )
    roles = keep_first(wanted, ["publication_key"], [F.desc("reference_publication")]).select("publication_key", F.col("reference_role").alias("role"))
    best = observed.where(F.col("corpus_rank") <= top).join(roles, "publication_key", "left").select(
        "publication_key",
        F.coalesce(F.nullif("display_publication_title", F.lit("")), "publication_title_canonical").alias("publication"),
        *shown,
        F.col("role").isNotNull().alias("real_world_reference"),
        F.coalesce("role", F.lit("high-frequency title in corpus")).alias("reference_role"),
        F.lit("top corpus frequency").alias("why_included"),
    )
    both = best.unionByName(matched).withColumn("observed_in_corpus", F.col("documents").isNotNull())
    order = [F.desc("observed_in_corpus"), F.desc_nulls_last("documents"), F.desc("real_world_reference"), F.desc("why_included"), F.asc("corpus_rank"), F.asc("publication"), F.asc("reference_role")]
    return keep_first(both, ["publication_key"], order)


def expected_but_unobserved(media: DataFrame, watch_list: DataFrame) -> DataFrame:
    """Watched publications in scope of which no record is observed."""
    observed = media.select(publication_key(F.col("publication_title_canonical")).alias("publication_key")).distinct()
    wanted = watch_list.where("expected_in_scope").withColumn("publication_key", publication_key(F.col("reference_publication")))
    return wanted.join(observed, "publication_key", "left_anti").select("reference_publication", "reference_role", "expected_in_scope")


def literal_watch_list(spark: SparkSession, rows: list[tuple[str, str, bool]]) -> DataFrame:
    return spark.createDataFrame(rows, "reference_publication STRING, reference_role STRING, expected_in_scope BOOLEAN")
