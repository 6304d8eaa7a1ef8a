"""Token counts from an exact length histogram.

Documents are aggregated by encoded length; suffix sums over the histogram then
answer totals, quantiles and truncated totals for every context limit without
touching the documents again.  The histogram has a row for each distinct
length, so that it stays small however many documents there are, and the suffix
sums are still taken in blocks of lengths, not in one task.

Defined cases: null and empty texts have length 0; an empty table has an empty
histogram, zero totals and null quantiles; repeated rows each count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Lengths in a block of the suffix sums.
BLOCK = 1024


def length_histogram(counts: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """``n_tokens``, ``n_docs``: one row for each distinct length."""
    return counts.groupBy(F.col(length_col).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_table(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length L that occurs, what holds for the context limit L.

    ``docs_at_least``/``tokens_at_least``: documents of L tokens or more and
    their tokens; ``truncated_total``: tokens left if every document is cut to
    L; ``n_truncated``: documents that lose tokens by that.
    """
    h = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("n_total"), F.floor(F.col("n_tokens") / block).alias("block"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("n_total").alias("b_tokens"))
    # one row for each block of lengths: longest document / BLOCK rows
    behind = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(behind), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("b_tokens").over(behind), F.lit(0)).alias("later_tokens"),
        F.coalesce(F.sum("b_tokens").over(ahead), F.lit(0)).alias("earlier_tokens"),
    )
    down = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    up = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    docs, tokens = F.sum("n_docs").over(down) + F.col("later_docs"), F.sum("n_total").over(down) + F.col("later_tokens")
    shorter = F.coalesce(F.sum("n_total").over(up), F.lit(0)) + F.col("earlier_tokens")
    return h.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        docs.alias("docs_at_least"),
        tokens.alias("tokens_at_least"),
        (shorter + F.col("n_tokens") * docs).alias("truncated_total"),
        (docs - F.col("n_docs")).alias("n_truncated"),
    )


def report(counts: DataFrame, limits: list[int], probabilities: list[float], length_col: str = "n_tokens") -> DataFrame:
    """Everything the histogram answers, in rows of three kinds.

    ``kind`` is ``length`` for each length that occurs, ``limit`` for each of
    ``limits`` and ``quantile`` for each of ``probabilities``; ``at`` is the
    length, limit or probability and ``n_tokens`` the length that it stands
    for.  The histogram is written once, so that documents are encoded once.
    """
    table = suffix_table(cut(length_histogram(counts, length_col), "histogram"))
    every = table.withColumnsRenamed({"n_docs": "d", "docs_at_least": "da", "tokens_at_least": "ta", "truncated_total": "tt", "n_truncated": "nt"})
    facts = lambda kind, at: [F.lit(kind).alias("kind"), at.cast("double").alias("at"), "n_tokens", F.col("d").alias("n_docs"), F.col("da").alias("docs_at_least"), F.col("ta").alias("tokens_at_least"), F.col("tt").alias("truncated_total"), F.col("nt").alias("n_truncated")]
    lengths = every.select(*facts("length", F.col("n_tokens")))
    asked = truncated_totals(table, limits)
    exact = asked.join(table.select(F.col("n_tokens").alias("context_limit"), "n_docs"), "context_limit", "left")
    n_docs = F.coalesce("n_docs", F.lit(0)).cast("long")
    # documents of exactly the limit's length add to those beyond it
    at_limit = exact.select(F.lit("limit").alias("kind"), F.col("context_limit").cast("double").alias("at"), F.col("context_limit").alias("n_tokens"), n_docs.alias("n_docs"), (F.col("n_truncated") + n_docs).alias("docs_at_least"), (F.col("tokens_beyond") + n_docs * F.col("context_limit")).alias("tokens_at_least"), "truncated_total", "n_truncated")
    found = quantiles(table, probabilities).join(every, "n_tokens").select(*facts("quantile", F.col("probability")))
    return lengths.unionByName(at_limit).unionByName(found)


def truncated_totals(table: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit``, ``truncated_total``, ``n_truncated``, ``tokens_beyond`` (tokens of documents beyond it) for any limits, from the suffix table.

    With L the shortest length above the limit c, documents of L or more give
    c each and the rest all they have.
    """
    total = table.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("total"))
    wanted = table.sparkSession.createDataFrame([(int(c),) for c in limits], "context_limit long")
    longer = table.join(F.broadcast(wanted), F.col("n_tokens") > F.col("context_limit")).groupBy("context_limit").agg(F.max("docs_at_least").alias("n"), F.max("tokens_at_least").alias("lost"))
    out = wanted.join(longer, "context_limit", "left").join(F.broadcast(total))
    n, lost = F.coalesce("n", F.lit(0)), F.coalesce("lost", F.lit(0))
    return out.select("context_limit", (F.col("total") - lost + n * F.col("context_limit")).alias("truncated_total"), n.alias("n_truncated"), lost.alias("tokens_beyond"))


def quantiles(table: DataFrame, probabilities: list[float]) -> DataFrame:
    """``probability``, ``n_tokens``: the smallest length that at least that share of documents does not exceed."""
    total = table.agg(F.max("docs_at_least").alias("total"))
    wanted = table.sparkSession.createDataFrame([(float(p),) for p in probabilities], "probability double")
    reached = table.join(F.broadcast(total)).select("n_tokens", (F.col("total") - F.col("n_truncated")).alias("upto"), "total")
    found = reached.join(F.broadcast(wanted), F.col("upto") >= F.col("probability") * F.col("total")).groupBy("probability").agg(F.min("n_tokens").alias("n_tokens"))
    return wanted.join(found, "probability", "left").select("probability", "n_tokens")
