"""Unified retrieval: five branches, a fair pool, one scorer, the final list with room for pictures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.text import ascii_tokens
from tidemark.operators.retrieval import fair_pool, quota
from tidemark.operators.search import rerank
from tidemark.sources.tables import written

# The branches in the order of their turns, what each may give, and the sizes of pool and result.
LIMITS = {"dense": 20, "sparse": 20, "graph": 20, "multimodal": 20, "visual": 8}
POOL, RESULT, VISUAL = 48, 8, 2

Scorer = Callable[[Column, Column], Column]


def token_share(question: Column, text: Column) -> Column:
    """The share of a question's distinct tokens that a text has, six places; null without tokens. Stands in for a model: any column of the two texts will do."""
    asked = F.array_distinct(ascii_tokens(F.coalesce(question, F.lit(""))))
    return F.round(F.try_divide(F.size(F.array_intersect(asked, ascii_tokens(F.coalesce(text, F.lit(""))))), F.size(asked)), 6)


def search(spark: SparkSession, queries: DataFrame, texts: DataFrame, branches: dict[str, DataFrame], scorer: Scorer = token_share, visual: Column | None = None, pool: int = POOL, limit: int = RESULT, least_visual: int = VISUAL) -> DataFrame:
    """query_id, rank, doc_id, score, branches (which gave it), special of queries (query_id, question) over texts (doc_id, text).

    branches: name -> (query_id, doc_id, rank), by the names of LIMITS; those that are
    missing give nothing. The pool takes their ranks in turns, a document once; the scorer
    orders it (ties keep the pool's order, null scores last); of the first
    ``limit`` at least ``least_visual`` are ``visual`` if the pool has them. A document without a text is scored as an empty one.
    """
    known = [(n, branches[n].where(F.col("rank") <= most).select("query_id", "doc_id", "rank")) for n, most in LIMITS.items() if n in branches]
    if not known:
        raise ValueError("no branch of " + ", ".join(LIMITS))
    given = [(n, written(spark, b, f"branch-{n}")) for n, b in known]
    pooled = written(spark, fair_pool([b for _, b in given], pool).select("query_id", "doc_id", "rank"), "pool")
    lineage = None
    for n, b in given:
        own = b.select("query_id", "doc_id", F.lit(n).alias("branch"))
        lineage = own if lineage is None else lineage.unionByName(own)
    lineage = lineage.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_set("branch")).alias("branches"))
    both = pooled.join(queries.select("query_id", "question"), "query_id").join(texts.select("doc_id", "text"), "doc_id", "left")
    ordered = rerank(both.select("query_id", "doc_id", "rank", scorer(F.col("question"), F.col("text")).alias("_s")), F.col("_s"), pool)
    ordered = written(spark, ordered.select("query_id", "doc_id", "rank", F.col("score"), F.coalesce(F.lit(False) if visual is None else visual, F.lit(False)).alias("special")), "reranked")
    final = quota(ordered.select("query_id", "doc_id", "rank", "special"), F.col("special"), limit, least_visual)
    return final.join(ordered.select("query_id", "doc_id", "score"), ["query_id", "doc_id"]).join(lineage, ["query_id", "doc_id"]).select("query_id", "rank", "doc_id", "score", "branches", "special")
