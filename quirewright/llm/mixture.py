"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by hash, its repeats one after the other. A document's virtual finish time is the
sum of its source's tokens up to it divided by the source's weight; the mix is the documents in the order of these
times, as far as the budget goes. A source that runs out leaves its share to the others in proportion.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirewright.operators.running import running_sum
from quirewright.session import broadcast_if_small, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public byte-level vocabulary splits a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def _counter(path: str):
    def run(batches: Iterator) -> Iterator:
        import base64

        import pyarrow as pa
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            sizes = [len(coder.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    return run


def token_sizes(docs: DataFrame, doc_id: str, source: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens), written once: the texts are tokenized a single time. Null and empty texts have 0 tokens."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text))
    return written(rows.mapInArrow(_counter(tokenizer), "doc_id BIGINT, source STRING, tokens BIGINT"), "tokens")


def mixed(sizes: DataFrame, targets: DataFrame, budget: float, seed: int = 7) -> DataFrame:
    """(source, doc_id, repeat, tokens, finish, mix_end): the mix in order of ``finish``, at most ``budget`` tokens.

    ``targets`` has source, target_share and max_repeats, a row per source; sources with a share or repeats below
    one part are left out, as are documents without a source or of an unnamed one. ``repeat`` counts from 0 and
    ``mix_end`` is the sum of tokens so far; the first document beyond the budget ends the mix.
    """
    wanted = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").select("source", "target_share", "max_repeats")
    # whole passes over a source that alone are more than the budget; later ones lie beyond it whatever the others give
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    passes = F.ceil(F.lit(float(budget)) / F.nullif("source_tokens", F.lit(0))) + 1
    wanted = wanted.join(have, "source").select("source", "target_share", F.least("max_repeats", F.coalesce(passes, "max_repeats")).cast("int").alias("repeats"))
    uses = sizes.join(broadcast_if_small(written(wanted, "wanted")), "source").select(
        "source", "doc_id", "tokens", "target_share", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)).alias("repeat")
    )
    shuffled = uses.withColumn("turn", F.xxhash64("doc_id", "repeat", F.lit(seed)))
    queued = running_sum(shuffled, ["source"], ["repeat", "turn", "doc_id"], "tokens", "source_tokens")
    timed = queued.select("source", "doc_id", "repeat", "tokens", (F.col("source_tokens") / F.col("target_share")).alias("finish"))
    ordered = running_sum(timed, [], ["finish", "source", "repeat", "doc_id"], "tokens", "mix_end")
    return ordered.where(F.col("mix_end") <= budget)


def mix_report(sizes: DataFrame, targets: DataFrame, mix: DataFrame, budget: float) -> DataFrame:
    """One row per target source: what it could give, what the mix took and the share reached.

    available_tokens counts every allowed repeat; falls_short says that all of it was not enough for the target share
    of the budget. actual_share is of the tokens the mix really has.
    """
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count(F.lit(1)).alias("source_documents"))
    took = mix.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("mixed_documents"))
    zero = F.lit(0).cast("bigint")
    out = (
        targets.join(have, "source", "left")
        .join(took, "source", "left")
        .select(
            "source",
            "target_share",
            "max_repeats",
            F.coalesce("source_documents", zero).alias("source_documents"),
            (F.coalesce("source_tokens", zero) * F.col("max_repeats")).alias("available_tokens"),
            (F.col("target_share") * budget).alias("target_tokens"),
            F.coalesce("mixed_documents", zero).alias("mixed_documents"),
            F.coalesce("mixed_tokens", zero).alias("mixed_tokens"),
        )
    )
    exhausted = F.col("mixed_tokens") >= F.col("available_tokens")
    whole = F.sum("mixed_tokens").over(Window.partitionBy())  # over a row per source
    return out.select(
        *out.columns,
        (F.col("mixed_tokens") / F.nullif(whole, zero)).alias("actual_share"),
        (exhausted & (F.col("available_tokens") < F.col("target_tokens"))).alias("falls_short"),
    )


def half_mix(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mix of half the tokens of all documents, and its report."""
    sizes = token_sizes(docs, "doc_id", "source", "text", tokenizer)
    budget = (sizes.agg(F.sum("tokens")).first()[0] or 0) / 2
    mix = mixed(sizes, targets, budget)
    return mix, mix_report(sizes, targets, mix, budget)
