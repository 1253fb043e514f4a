"""Rank fusion: weighted reciprocal ranks over four branches, and the two-branch form by best score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_CONSTANT = 60
#: Branches in order of priority with their weights.
BRANCHES = {"vector_original": 1.0, "lexical_original": 1.0, "vector_rewritten": 0.75, "lexical_rewritten": 0.75}


def ranked(branch: DataFrame, keys: list[str] | None = None, key: str = "chunk_id") -> DataFrame:
    """Adds rank (1 is best) by similarity and id, for each of ``keys``."""
    window = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("similarity"), key)
    return branch.withColumn("rank", F.row_number().over(window))


def _priority(source: Column) -> Column:
    return reduce(lambda out, x: out.when(source == x[1], x[0]), enumerate(BRANCHES), F.when(F.lit(False), 0))


def fuse(branches: DataFrame, limit: int, by: list[str] | None = None) -> DataFrame:
    """Fused rows of ranked branch rows (source, chunk_id, similarity, rank); with ``by``, for each of those keys.

    Terms are added in the branches' order, so equal sums are equal numbers. Order: score, branches, original branches,
    best similarity, best source, id. Partial aggregation keeps one row of four numbers for each chunk and task.
    """
    by = by or []
    each = [F.max(F.when(F.col("source") == s, F.col("rank"))).alias(f"r_{s}") for s in BRANCHES]
    best = F.max(F.struct(F.col("similarity"), (-_priority(F.col("source"))).alias("order"), F.col("source"))).alias("best")
    merged = branches.groupBy(*by, "chunk_id").agg(*each, best)
    terms = [F.coalesce(F.lit(w) / (RANK_CONSTANT + F.col(f"r_{s}")), F.lit(0.0)) for s, w in BRANCHES.items()]
    names = F.array_compact(F.array(*(F.when(F.col(f"r_{s}").isNotNull(), s) for s in BRANCHES)))
    merged = merged.select(*by, "chunk_id", reduce(lambda a, b: a + b, terms).alias("score"), names.alias("matched"), F.col("best.similarity").alias("best_similarity"), F.col("best.source").alias("best_source"))
    order = [F.desc("score"), F.desc(F.size("matched")), F.desc(F.size(F.filter("matched", lambda x: x.endswith("_original")))), F.desc("best_similarity"), _priority(F.col("best_source")), F.col("chunk_id")]
    if by:
        return merged.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("position") <= limit)
    top = merged.orderBy(*order).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def fuse_two(original: DataFrame, rewritten: DataFrame, limit: int) -> DataFrame:
    """chunk_id, similarity (the better one), matched (original, rewritten or both) and position.

    Order: similarity, then both, original, rewritten, then first seen (original rows by rank, then rewritten rows).
    """
    rows = original.select("chunk_id", "similarity", F.lit("original").alias("source"), F.col("rank").alias("seen"))
    rows = rows.unionByName(rewritten.select("chunk_id", "similarity", F.lit("rewritten").alias("source"), (F.col("rank") + 1_000_000).alias("seen")))
    merged = rows.groupBy("chunk_id").agg(F.max("similarity").alias("similarity"), F.count_distinct("source").alias("n"), F.min("source").alias("one"), F.min("seen").alias("seen"))
    merged = merged.withColumn("matched", F.when(F.col("n") == 2, "both").otherwise(F.col("one")))
    order = [F.desc("similarity"), F.when(F.col("matched") == "both", 0).when(F.col("matched") == "original", 1).otherwise(2), F.col("seen")]
    top = merged.orderBy(*order).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order))).select("chunk_id", "similarity", "matched", "position")


def branch_counts(branches: DataFrame) -> DataFrame:
    """One row: rows of each branch and the number of fused chunks."""
    counts = [F.count(F.when(F.col("source") == s, 1)).alias(f"n_{s}") for s in BRANCHES]
    return branches.agg(*counts, F.count_distinct("chunk_id").alias("n_fused"))
