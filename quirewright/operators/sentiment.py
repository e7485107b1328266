"""Word-category scores, and term counts by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirewright.functions.text import cloud_tokens, ratio, tokens
from quirewright.schema import LEXICON_CATEGORIES


def lexicon_members(lexicon: DataFrame) -> DataFrame:
    """(word, category) of a word table with a number per category: a member where it is not 0, negative ones included.

    Header names are taken without regard to case; a category without a column has no members.
    """
    names = {c.strip().lower(): c for c in lexicon.columns}
    have = [c for c in LEXICON_CATEGORIES if c in names]
    each = F.array(*(F.struct(F.lit(c).alias("category"), F.col(f"`{names[c]}`").try_cast("double").alias("value")) for c in have))
    if not have:
        return lexicon.select(F.upper(names["word"]).alias("word"), F.lit("").alias("category")).limit(0)
    rows = lexicon.select(F.upper(F.col(f"`{names['word']}`")).alias("word"), F.inline(each))
    return rows.where("word IS NOT NULL AND value <> 0").select("word", "category").distinct()


def category_lookup(members: DataFrame) -> DataFrame:
    """(word, categories): the inverted lexicon."""
    return members.groupBy("word").agg(F.array_sort(F.collect_set("category")).alias("categories"))


#: Words that a lexicon may have; it is a list made by hand, held in every task.
LEXICON_WORDS = 1_000_000


def _in_list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)


def scores(df: DataFrame, text: str, members: DataFrame) -> DataFrame:
    """``df`` with lm_token_count, a count and a rate per category, and lm_net_tone.

    The lexicon becomes hashed sets in the plan: a text's words are first cut down to those of the lexicon, of which
    each category is counted where the text lies. Repeated words count each time; a text without words scores 0.
    """
    rows = members.limit(len(LEXICON_CATEGORIES) * LEXICON_WORDS + 1).collect()
    words: dict[str, list[str]] = {c: [] for c in LEXICON_CATEGORIES}
    for word, category in sorted(rows):
        words[category].append(word)
    known = sorted({w for w, _ in rows})
    if len(known) > LEXICON_WORDS:
        raise ValueError(f"the lexicon has more than {LEXICON_WORDS} words")
    out = df.withColumn("_words", tokens(F.col(text)))
    out = out.withColumns({"lm_token_count": F.size("_words").cast("bigint"), "_hits": F.expr(f"filter(_words, w -> w IN ({_in_list(known)}))") if known else F.lit(None)})
    counts = {c: F.expr(f"size(filter(_hits, w -> w IN ({_in_list(words[c])})))") if words[c] else F.lit(0) for c in LEXICON_CATEGORIES}
    return _rates(out.withColumns({f"lm_{c}": n.cast("bigint") for c, n in counts.items()}).drop("_words", "_hits"))


def _rates(df: DataFrame) -> DataFrame:
    n = F.col("lm_token_count")
    rates = {f"lm_{c}_rate": ratio(F.col(f"lm_{c}"), n) for c in LEXICON_CATEGORIES}
    return df.withColumns(rates | {"lm_net_tone": ratio(F.col("lm_positive") - F.col("lm_negative"), n)})


def _sum_ratio(c: str) -> Column:
    return ratio(F.sum(c), F.sum("lm_token_count"))


def tone_by_decade_and_source(scored: DataFrame) -> DataFrame:
    """Mean net tone and ratios of sums (named mean rates) by decade and source type, null groups kept."""
    return scored.groupBy("decade", "source_type").agg(
        F.count(F.lit(1)).alias("documents"),
        F.avg("lm_net_tone").alias("mean_net_tone"),
        *(_sum_ratio(f"lm_{c}").alias(f"mean_{c}_rate") for c in ("positive", "negative", "uncertainty")),
    )


def tone_by_decade(scored: DataFrame) -> DataFrame:
    return scored.groupBy("decade").agg(
        F.count(F.lit(1)).alias("documents"),
        F.avg("lm_net_tone").alias("mean_net_tone"),
        *(F.sum(f"lm_{c}").alias(f"{c}_words") for c in ("positive", "negative", "uncertainty")),
        F.sum("lm_token_count").alias("tokens"),
    )


def _facets(df: DataFrame, facets: list[str], *keep: Column) -> DataFrame:
    each = F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("group_value")) for f in facets))
    return df.select(*keep, F.inline(each))


def group_sizes(df: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, group_value, documents); a null source type counts as ``<missing>``, other null groups are left out."""
    rows = _facets(df, facets).withColumn("group_value", F.when(F.col("facet") == "source_type", F.coalesce("group_value", F.lit("<missing>"))).otherwise(F.col("group_value")))
    return rows.where("group_value IS NOT NULL").groupBy("facet", "group_value").agg(F.count(F.lit(1)).alias("documents"))


def group_terms(df: DataFrame, text: str, facets: list[str], k: int = 120) -> DataFrame:
    """(facet, group_value, term, documents, rank): the ``k`` most frequent terms of every group, ties by term."""
    words = df.select(*facets, F.explode(cloud_tokens(F.col(text))).alias("term"))
    # counted once by all facets together, so that the words themselves are not repeated for each
    together = words.groupBy(*facets, "term").agg(F.count(F.lit(1)).alias("n"))
    rows = _facets(together, facets, F.col("term"), F.col("n")).where("group_value IS NOT NULL")
    counts = rows.groupBy("facet", "group_value", "term").agg(F.sum("n").alias("documents"))
    rank = F.row_number().over(Window.partitionBy("facet", "group_value").orderBy(F.desc("documents"), "term"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def group_lexicon_totals(df: DataFrame, text: str, facets: list[str], members: DataFrame) -> DataFrame:
    """(facet, group_value, documents, lm_token_count, a sum per category); null groups are left out."""
    narrow = df.select(*facets, F.col(text).alias("_text"))
    scored = scores(narrow, "_text", members)
    rows = _facets(scored, facets, F.col("lm_token_count"), *(F.col(f"lm_{c}") for c in LEXICON_CATEGORIES)).where("group_value IS NOT NULL")
    sums = [F.sum(f"lm_{c}").alias(f"lm_{c}") for c in LEXICON_CATEGORIES]
    return rows.groupBy("facet", "group_value").agg(F.count(F.lit(1)).alias("documents"), F.sum("lm_token_count").alias("lm_token_count"), *sums)
