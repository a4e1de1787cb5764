"""Mixing sources to target shares of tokens.

Documents get hash-random keys and are ranged by them within their source. Token counts are summed per
range, ranges are accumulated in order, and only within a range are documents sorted, so prefix sums
need no source in one task. Each source is cut where its budget ends, after whole epochs of repeats.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

TOKENIZER = os.environ.get("SLUICE_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents a range holds on average.
RANGE_DOCUMENTS = 50_000
#: Most sources whose targets are broadcast.
BROADCAST_SOURCES = 1_000_000


@lru_cache(maxsize=1)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of each text, 0 for null and empty."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(tokenizer)
        for b in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in b], dtype="int64")

    return count(text)


def source_report(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of ``targets``: documents, tokens, budget and how much of it repeats can give at most.

    ``sizes`` is (source, n_tokens). Budgets are shares of all tokens in ``sizes``, sources without a
    target and null sources included. (source, target_share, max_repeats, docs, tokens, total_tokens,
    budget, used_budget). A source without documents has 0 tokens. Null ``max_repeats``
    counts as 1, a null or negative share as 0. Repeated targets of one source are one: the largest.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    want = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.greatest(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    out = want.join(per, "source", "left").select(
        "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "max_repeats", zero("docs"), zero("tokens"), F.lit(total).cast("bigint").alias("total_tokens"))
    most = F.col("tokens") * F.col("max_repeats")
    wanted = F.col("target_share") * F.col("total_tokens")
    return out.withColumn("budget", F.round(wanted).cast("bigint")).withColumn(
        "used_budget", F.least(F.col("budget"), most))


def _ranges(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """Keyed documents with the number of their range: equal parts of the key space, as many as a source's documents ask for."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("docs") / RANGE_DOCUMENTS))
    return keyed.join(plan, "source").withColumn("part", F.floor(F.col("key") * parts / float(1 << 32)).cast("int"))


def mix(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(selection, report). Selection: (doc id, source, n_tokens, uses); report: ``source_report`` plus actual tokens and share.

    A source's budget is its share of all tokens of ``docs``. It is filled with whole epochs and then
    with the documents, in order of their random keys, that end within the rest; a source that
    cannot reach its budget is used ``max_repeats`` times. Documents without tokens are used with the
    epochs of those around them; empty tables give no selection. ``targets`` is broadcast up to BROADCAST_SOURCES
    sources. Keys come from seed, id and text alone, so the mix is the same however the table lies.

    ``reachable`` in the report is what the cut found: false where every document is used ``max_repeats`` times
    and all of them together stay below the target.
    """
    sized = cut(docs.select(
        F.col(doc_id).alias("id"), F.col(source).alias("source"), token_count(F.col(text), tokenizer).alias("n_tokens"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), 32).alias("key")))
    report = cut(source_report(sized.select("source", "n_tokens"), targets))
    plan = report.where(F.col("tokens") > 0).select(
        "source", "docs", "tokens", "used_budget", "max_repeats",
        F.floor(F.col("used_budget") / F.col("tokens")).cast("int").alias("epochs"))
    plan = plan.withColumn("rest", F.col("used_budget") - F.col("epochs") * F.col("tokens"))
    # Beyond that, the join is by shuffle, and adaptive execution splits a source that holds much.
    ranged = _ranges(sized, F.broadcast(plan) if report.count() <= BROADCAST_SOURCES else plan)
    # One row a range: few, and summed in order source by source.
    sums = ranged.groupBy("source", "part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = sums.selectExpr("source", "part", "coalesce(sum(part_tokens) over (partition by source order by part rows between unbounded preceding and 1 preceding), 0) as before", "part_tokens")
    placed = ranged.join(before, ["source", "part"])
    # A range that lies wholly inside or outside the rest needs no order; only those that are cut do.
    whole = placed.where((F.col("before") + F.col("part_tokens") <= F.col("rest")) | (F.col("before") >= F.col("rest")))
    whole = whole.withColumn("extra", (F.col("before") + F.col("part_tokens") <= F.col("rest")).cast("int"))
    edge = placed.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("part_tokens") > F.col("rest")))
    edge = edge.withColumn("upto", F.col("before") + F.expr("sum(n_tokens) over (partition by source, part order by key, id rows between unbounded preceding and current row)"))
    edge = edge.withColumn("extra", (F.col("upto") <= F.col("rest")).cast("int"))
    cols = [F.col("id").alias(doc_id), F.col("source").alias(source), "n_tokens", F.least(F.col("epochs") + F.col("extra"), F.col("max_repeats")).cast("int").alias("uses")]
    chosen = cut(whole.select(*cols).unionByName(edge.select(*cols)).where(F.col("uses") > 0))
    used = chosen.groupBy(F.col(source).alias("source")).agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("actual"), F.max("uses").alias("most_uses"), F.min("uses").alias("least_uses"), F.count("*").alias("used_docs"))
    out = report.join(used, "source", "left").withColumn("actual_tokens", F.coalesce("actual", F.lit(0)).cast("bigint")).withColumn("most_uses", F.coalesce("most_uses", F.lit(0)))
    spent = (F.col("used_docs") == F.col("docs")) & (F.col("least_uses") >= F.col("max_repeats")) | (F.col("max_repeats") <= 0) | (F.col("docs") == 0)
    short = F.coalesce(spent, F.lit(False)) & (F.col("actual_tokens") < F.col("target_share") * F.col("total_tokens"))
    out = out.withColumn("reachable", ~short).drop("least_uses", "used_docs")
    mixed = used.agg(F.sum("actual")).first()[0] or 0
    out = out.drop("actual").withColumn("mix_tokens", F.lit(mixed).cast("bigint")).withColumn("actual_share", F.when(F.col("mix_tokens") > 0, F.col("actual_tokens") / F.col("mix_tokens")))
    return chosen, out.withColumn("share_of_total", F.when(F.col("total_tokens") > 0, F.col("actual_tokens") / F.col("total_tokens")))
