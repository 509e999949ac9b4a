"""Hybrid search: the lexical and the dense ranking of every query, fused."""

from __future__ import annotations

from pyspark.sql import DataFrame

from warraq.operators import dense, fusion, lexical, postings, scan


def search_batch(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, probes: DataFrame, limit: int = 10, pool: int | None = None, lexical_weight: float = 1.0, semantic_weight: float = 1.0, index: postings.Index | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, score, both ranks). ``queries`` is analyzed, ``probes`` holds the
    queries' vectors; filters on work and status are the caller's, on both chunks and vectors. ``index``: the stored
    index of the chunks, which leaves out rejected ones itself; without one, texts are read once."""
    limit, _ = lexical.limits(limit)
    size = fusion.pool_size(limit, pool)
    words = scan.search_batch(chunks, queries, size) if index is None else postings.search_batch(index, chunks, queries, size)
    rankings = words, dense.top_k(vectors, probes, size)
    return fusion.fuse(*rankings, limit=limit, lexical_weight=lexical_weight, semantic_weight=semantic_weight)
