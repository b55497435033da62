"""Ranking metrics, distributions, comparisons of runs and of result sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ranking_metrics(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per query hit@k, recall@k and reciprocal rank; a repeated result counts at its first place, and places close up."""
    once = ranked.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    once = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    good = gold.select("query_id", "doc_id").distinct().withColumn("good", F.lit(1))
    n = good.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    found = once.join(good, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first"), *[F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"n_{k}") for k in ks])
    every = n.join(found, "query_id", "left")
    return every.select(
        "query_id", F.coalesce(F.round(1.0 / F.col("first"), 6), F.lit(0.0)).alias("mrr"),
        *[(F.coalesce(f"n_{k}", F.lit(0)) > 0).cast("int").alias(f"hit_{k}") for k in ks],
        *[F.round(F.coalesce(f"n_{k}", F.lit(0)) / F.col("n_gold"), 6).alias(f"recall_{k}") for k in ks],
    )


def distribution(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """min, median, p75, p90, p95, max by linear interpolation, 3 decimals."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.0, 0.5, 0.75, 0.9, 0.95, 1.0)]))
    return df.groupBy(*by).agg(F.count(value).alias("n"), q.alias("q")).select(*by, "n", *[F.round(F.col("q")[i], 3).alias(n) for i, n in enumerate(("least", "median", "p75", "p90", "p95", "most"))])


def nearest_rank(df: DataFrame, value: str, by: list[str], qs: dict[str, float]) -> DataFrame:
    """The value at place round((n - 1) q), half to even. Places come from a window, not from a collected list."""
    w = Window.partitionBy(*by)
    placed = df.where(F.col(value).isNotNull()).select(*by, value, (F.row_number().over(w.orderBy(value)) - 1).alias("at"), F.count("*").over(w).alias("n"))
    return placed.groupBy(*by).agg(*[F.max(F.when(F.col("at") == F.bround((F.col("n") - 1) * F.lit(q)), F.col(value))).alias(name) for name, q in qs.items()])


def paired(a: DataFrame, b: DataFrame, key: str, metric: str) -> DataFrame:
    """How many keys improve, stay and regress from a to b, and the mean change."""
    both = a.select(key, F.col(metric).alias("x")).join(b.select(key, F.col(metric).alias("y")), key)
    d = F.col("y") - F.col("x")
    return both.agg(F.count_if(d > 0).alias("improved"), F.count_if(d == 0).alias("unchanged"), F.count_if(d < 0).alias("regressed"), F.round(F.avg(d), 6).alias("mean_delta"))


def same_bag(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of a not in b and of b not in a, repeats counted, columns by position."""
    b = b.toDF(*a.columns)
    only = lambda x, y, name: x.exceptAll(y).agg(F.count("*").alias(name))
    return only(a, b, "only_a").join(F.broadcast(only(b, a, "only_b")))  # one row each


def audit(expected: DataFrame, actual: DataFrame, key: str, same: Column) -> DataFrame:
    """Counts of keys by state: missing, stale, changed, matching. Both sides have ``key``; ``same`` compares the joined rows."""
    both = expected.withColumn("_e", F.lit(True)).join(actual.withColumn("_a", F.lit(True)), key, "full_outer")
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "stale").when(same, "matching").otherwise("changed")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))
