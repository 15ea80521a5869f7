"""Token counts by an exact length histogram (operator 8).

Documents are encoded in Arrow batches and only their lengths leave the batch.
The lengths are aggregated to a histogram, one row per length that occurs, and
suffix sums over it answer every context limit L exactly: documents and tokens
of length L or more, and the total if every document is cut to L tokens,

    sum(min(length, L)) = total - tokens_from(L) + L * docs_from(L).

Quantiles are read off the shares.  Suffix sums are taken over blocks of
lengths first and then inside a block, so no task needs the whole histogram.

Defined results: null and empty texts have length 0; repeated rows count each;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import saved, whole_text

BLOCK = 256


@lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_lengths(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """One row per document: n_tokens."""
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoding(ranks_path, pattern)
        for batch in batches:
            yield pd.Series([len(e.encode_ordinary(t)) for t in batch], dtype="int64")

    return docs.select(F.pandas_udf(lengths, "long")(whole_text(text_col)).alias("n_tokens"))


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Per length: n_docs, docs_from, tokens_from, truncated_tokens,
    total_tokens and share (of documents up to this length)."""
    counts = saved(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
                   .withColumn("_block", F.floor(F.col("n_tokens") / BLOCK)))
    blocks = counts.groupBy("_block").agg(
        F.sum("n_docs").alias("_d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("_t"))
    every = Window.partitionBy(F.lit(0))
    later = every.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("_block").alias("_b"), *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in ("_d", "_t")],
        F.sum("_d").over(every).alias("_docs"), F.sum("_t").over(every).alias("total_tokens"))
    inside = Window.partitionBy("_block").orderBy(F.col("n_tokens").desc())
    out = counts.join(blocks, F.col("_block") == F.col("_b"))
    out = (out.withColumn("docs_from", F.col("_d_later") + F.sum("n_docs").over(inside))
           .withColumn("tokens_from", F.col("_t_later") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside)))
    return out.select("n_tokens", "n_docs", "docs_from", "tokens_from", truncated(F.col("n_tokens")).alias("truncated_tokens"),
                      "total_tokens",
                      ((F.col("_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("_docs")).alias("share"))


def truncated(limit: Column) -> Column:
    """Tokens left if documents are cut to ``limit``, on the row of the least
    length that is not below the limit."""
    return F.col("total_tokens") - F.col("tokens_from") + limit * F.col("docs_from")


def at_limit(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: documents cut, and tokens left, at any context limit."""
    return histogram.agg(
        F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs"))), F.lit(0)).alias("docs_cut"),
        F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens_left"))
