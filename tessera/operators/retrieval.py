"""Lexical and dense ranking, and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine

K1, B, RANK_CONSTANT = 1.5, 0.75, 60.0
#: How much a word of each field of a symbol counts (fixed values).
FIELD_WEIGHTS = {"name": 8, "qualified": 4, "kind": 2, "path": 2, "signature": 2, "summary": 1, "code": 1}
#: Weight of the lexical and of the dense share of a fused score.
LEXICAL_SHARE, DENSE_SHARE = 0.68, 0.32


def searched(ranked: DataFrame, symbols: DataFrame, query: str, limit: int) -> DataFrame:
    """Fielded search: of (id, score) four times the limit, boosts by name, the limit, and the rows' columns.

    Ranks first and joins the rest of the few rows after.
    """
    ranked = top(ranked.withColumn("score", F.round("score", 9)), 4 * limit)
    near = F.broadcast(ranked).join(symbols, "id")  # 4 * limit rows
    return top(near.withColumn("score", F.round(F.col("score") + boosted(F.col("name"), F.col("qualified"), query), 9)), limit)


def boosted(name: Column, qualified: Column, query: str) -> Column:
    """What names add to a score: 8 if equal, else 3 if contained; 1.5 if in the qualified name."""
    q = query.lower()
    near = F.when(F.lower(name) == q, 8.0).when(F.contains(F.lower(name), F.lit(q)), 3.0).otherwise(0.0)
    return near + F.when(F.contains(F.lower(qualified), F.lit(q)), 1.5).otherwise(0.0)


def top(ranked: DataFrame, k: int, score: str = "score", tie: str = "id") -> DataFrame:
    return ranked.orderBy(F.desc(score), tie).limit(k)


def dense_top(vectors: DataFrame, query: Column, k: int, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """(id, similarity) of the k nearest by cosine, ties to the smaller id."""
    scored = vectors.select(F.col(id_col).alias("id"), F.round(cosine(F.col(vector_col), query), 9).alias("similarity"))
    return top(scored, k, "similarity")


def fused(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """(id, score): lexical score over its maximum and dense similarity from [-1, 1] to [0, 1], weighted.

    A hit that the dense list lacks counts as similarity 0, and so above negative ones.
    """
    highest = F.max("score").over(Window.partitionBy())
    lexical = lexical.select("id", F.when(highest > 0, F.col("score") / highest).otherwise(0.0).alias("lexical"))
    both = lexical.join(dense, "id", "full_outer")
    score = LEXICAL_SHARE * F.coalesce("lexical", F.lit(0.0)) + DENSE_SHARE * (F.coalesce("similarity", F.lit(0.0)) + 1) / 2
    return both.select("id", score.alias("score"))


def reciprocal_ranks(*lists: DataFrame) -> DataFrame:
    """(id, score) of ranked lists (id, rank): the sum of 1 / (60 + rank)."""
    parts = None
    for ranked in lists:
        part = ranked.select("id", (1 / (RANK_CONSTANT + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("id").agg(F.sum("part").alias("score"))
