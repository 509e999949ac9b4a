"""Weighted reciprocal-rank fusion of two rankings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
#: Stands for no rank in the order.
NO_RANK = 1_000_000_000


#: What a pair of weights must hold, and what is said of one that does not.
_RULES = (
    (lambda a, b: math.isfinite(a) and math.isfinite(b), "is not made of finite numbers"),
    (lambda a, b: min(a, b) >= 0, "has a weight below zero"),
    (lambda a, b: a + b > 0, "gives weight to no ranking"),
)


def shares(pairs: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """Each (lexical, semantic) pair as shares of one."""
    for pair in pairs:
        said = next((said for holds, said in _RULES if not holds(*pair)), None)
        if said:
            raise ValueError(f"the pair of weights {pair} {said}")
    return [(a / (a + b), b / (a + b)) for a, b in pairs]


def merge(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """(query_id, chunk_id, lexical_rank, semantic_rank) of all that either ranking has."""
    left = lexical.select("query_id", "chunk_id", F.col("rank").alias("lexical_rank"))
    right = semantic.select("query_id", "chunk_id", F.col("rank").alias("semantic_rank"))
    return left.join(right, ["query_id", "chunk_id"], "full_outer")


def rank_fused(merged: DataFrame, limit: int, rrf_k: int = RRF_K, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Scores and cuts merged rankings that carry lexical_weight and semantic_weight."""
    if rrf_k < 1:
        raise ValueError("rrf_k must be positive")
    part = lambda w, r: F.coalesce(F.col(w) / (F.lit(float(rrf_k)) + F.col(r)), F.lit(0.0))
    scored = merged.withColumn("score", part("lexical_weight", "lexical_rank") + part("semantic_weight", "semantic_rank"))
    order = [F.desc("score"), F.coalesce("lexical_rank", F.lit(NO_RANK)), F.coalesce("semantic_rank", F.lit(NO_RANK)), F.col("chunk_id")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= limit)


def fuse(lexical: DataFrame, semantic: DataFrame, limit: int = 10, rrf_k: int = RRF_K, lexical_weight: float = 1.0, semantic_weight: float = 1.0) -> DataFrame:
    ((a, b),) = shares([(lexical_weight, semantic_weight)])
    return rank_fused(merge(lexical, semantic).withColumns({"lexical_weight": F.lit(a), "semantic_weight": F.lit(b)}), limit, rrf_k)


def pool_size(limit: int, asked: int | None = None) -> int:
    """How many results of each ranking take part."""
    return min(max(asked or max(20, 5 * limit), limit), 100)
