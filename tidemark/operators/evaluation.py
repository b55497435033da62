"""Evaluation: metrics of evidence, comparisons of rankings, audits, splits and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.operators.components import components


def evidence_metrics(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per query of gold: evidence_mrr over places without repeats, evidence_hit_k and evidence_recall_k over places as they are.

    ranked: query_id, rank, evidence_id (null: a candidate of another kind); gold: query_id, evidence_id.
    """
    good = gold.select("query_id", "evidence_id").distinct()
    n = good.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = ranked.join(good, ["query_id", "evidence_id"])
    # the place of a hit without repeats: how many distinct results stand up to it
    once = ranked.groupBy("query_id", "evidence_id").agg(F.min("rank").alias("first"))
    place = once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).join(good, ["query_id", "evidence_id"]).groupBy("query_id").agg(F.min("place").alias("place"))
    at_k = hits.groupBy("query_id").agg(*[F.count_distinct(F.when(F.col("rank") <= k, F.col("evidence_id"))).alias(f"c{k}") for k in ks])
    told = n.join(place, "query_id", "left").join(at_k, "query_id", "left")
    count = lambda k: F.coalesce(F.col(f"c{k}"), F.lit(0))
    return told.select("query_id", F.round(F.coalesce(1.0 / F.col("place"), F.lit(0.0)), 6).alias("evidence_mrr"), *[(count(k) > 0).cast("int").alias(f"evidence_hit_{k}") for k in ks], *[F.round(count(k) / F.col("n"), 6).alias(f"evidence_recall_{k}") for k in ks])


def agreement(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """One row: queries, the share with one order in both, the mean overlap of the first k. a, b: query_id, rank, doc_id."""
    top = lambda df, name: df.where(F.col("rank") <= k).select("query_id", "doc_id", F.col("rank").alias(name))
    both = top(a, "ra").join(top(b, "rb"), ["query_id", "doc_id"], "full_outer")
    per = both.groupBy("query_id").agg((F.count_if(F.col("ra").eqNullSafe(F.col("rb"))) == F.count("*")).alias("same"), (F.count_if(F.col("ra").isNotNull() & F.col("rb").isNotNull()) / F.greatest(F.count("ra"), F.count("rb"))).alias("overlap"))
    return per.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("same").cast("int")), 6).alias("same_order"), F.round(F.avg("overlap"), 6).alias("overlap"))


def diagnostic(a: DataFrame, b: DataFrame, gold: DataFrame) -> DataFrame:
    """Per query: results of both branches, of one alone, and gold that only one finds."""
    side = lambda df, name: df.select("query_id", "doc_id").distinct().withColumn(name, F.lit(True))
    both = side(a, "a").join(side(b, "b"), ["query_id", "doc_id"], "full_outer").join(side(gold, "g"), ["query_id", "doc_id"], "left")
    only = lambda x, y: F.col(x).isNotNull() & F.col(y).isNull()
    return both.groupBy("query_id").agg(F.count_if(F.col("a") & F.col("b")).alias("shared"), F.count_if(only("a", "b")).alias("only_a"), F.count_if(only("b", "a")).alias("only_b"), F.count_if(only("a", "b") & F.col("g")).alias("gold_only_a"), F.count_if(only("b", "a") & F.col("g")).alias("gold_only_b"))


def contribution(base: DataFrame, more: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """One row: queries improved, unchanged and regressed by ``more`` in gold found up to k, and gold recovered."""
    good = gold.select("query_id", "doc_id").distinct()
    found = lambda df, name: df.where(F.col("rank") <= k).join(good, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count_distinct("doc_id").alias(name))
    both = good.select("query_id").distinct().join(found(base, "x"), "query_id", "left").join(found(more, "y"), "query_id", "left")
    d = F.coalesce("y", F.lit(0)) - F.coalesce("x", F.lit(0))
    return both.agg(F.count_if(d > 0).alias("improved"), F.count_if(d == 0).alias("unchanged"), F.count_if(d < 0).alias("regressed"), F.coalesce(F.sum(F.greatest(d, F.lit(0))), F.lit(0)).alias("recovered"))


def bad_cases(first: DataFrame, final: DataFrame, gold: DataFrame) -> DataFrame:
    """Queries whose gold is not first at the end, with what can be seen of why, in a fixed order of categories."""
    good = gold.select("query_id", "doc_id").distinct()
    best = lambda df, name: df.join(good, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias(name))
    both = good.select("query_id").distinct().join(best(first, "before"), "query_id", "left").join(best(final, "after"), "query_id", "left")
    told = F.array_compact(F.array(F.when(F.col("before").isNull(), "absent_from_first"), F.when(F.col("before").isNotNull() & F.col("after").isNull(), "lost_by_rerank"), F.when(F.col("after") > F.col("before"), "moved_down"), F.when(F.col("after") > 1, "not_first")))
    return both.select("query_id", "before", "after", told.alias("categories")).where(F.size("categories") > 0)


def coverage_class(found: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """query_id and class: complete, partial or none of its gold is found."""
    good = gold.select("query_id", *keys).distinct()
    per = good.join(found.select("query_id", *keys).distinct().withColumn("_f", F.lit(1)), ["query_id", *keys], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("_f").alias("f"))
    return per.select("query_id", F.when(F.col("f") == 0, "none").when(F.col("f") < F.col("n"), "partial").otherwise("complete").alias("class"))


def sample(df: DataFrame, by: str, key: str, n: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + n`` of each subject in the order of a hash of the key: the same on every run."""
    order = Window.partitionBy(by).orderBy(F.sha2(F.col(key).cast("string"), 256), key)
    return df.withColumn("_n", F.row_number().over(order)).where((F.col("_n") > offset) & (F.col("_n") <= offset + n)).drop("_n")


def leakage_groups(spark: SparkSession, items: DataFrame, signatures: DataFrame) -> DataFrame:
    """item and group (the smallest item): items that share a signature (item, signature), directly or by others.

    Items are tied to the smallest one of a signature, so a signature of many items gives as many links.
    """
    least = signatures.groupBy("signature").agg(F.min("item").alias("b"))
    links = signatures.join(least.hint("merge"), "signature").select(F.col("item").alias("a"), "b").where("a <> b").distinct()
    return items.select("item").distinct().join(components(spark, links).withColumnRenamed("node", "item").hint("merge"), "item", "left").select("item", F.coalesce("root", "item").alias("group"))


def split_groups(sizes: list[tuple[int, int]], test: int) -> set[int] | None:
    """Whole groups (id, size) with exactly ``test`` items together, the first found with larger groups first; None if there is none.

    Sums are built up size by size over (group, sum reached), so the work is
    groups times ``test``. The groups of an evaluation set are few.
    """
    ordered = sorted(sizes, key=lambda g: (-g[1], g[0]))
    reach: dict[int, tuple[int, int] | None] = {0: None}
    for at, (_, size) in enumerate(ordered):
        for total in sorted(reach, reverse=True):
            if total + size <= test and total + size not in reach:
                reach[total + size] = (at, total)
    if test not in reach:
        return None
    chosen, total = set(), test
    while reach[total] is not None:
        at, total = reach[total]
        chosen.add(ordered[at][0])
    return chosen


def duplicates(df: DataFrame, key: str, value: Column) -> DataFrame:
    """Values that several rows share: value, n, least (key)."""
    return df.select(key, value.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"), F.min(key).alias("least")).where("n > 1")


def crossing(df: DataFrame, split: str, shape: Column) -> DataFrame:
    """Shapes that stand in more than one split."""
    return df.groupBy(shape.alias("shape")).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("n")).where("splits > 1")


def summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """rows, known, total, mean, p50 and p95 (interpolated) of a value that may be unknown."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.count(value).alias("known"), F.sum(value).alias("total"), F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, 0.5), 3).alias("p50"), F.round(F.percentile(value, 0.95), 3).alias("p95"))


def metric_means(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Means of those metrics that every row has; null for the others."""
    return rows.agg(*[F.round(F.when(F.count(m) == F.count("*"), F.avg(m)), 6).alias(m) for m in metrics])


def rollup(df: DataFrame, subject: str, ok: Column, pages: str, seconds: str) -> DataFrame:
    """Per subject and in all (subject null): runs, successes, failures, pages a second, median seconds of successes."""
    told = df.withColumn("_ok", ok)
    good = lambda c: F.when(F.col("_ok"), F.col(c))
    return told.rollup(subject).agg(F.count("*").alias("runs"), F.count_if(F.col("_ok")).alias("succeeded"), F.count_if(~F.col("_ok")).alias("failed"), F.round(F.try_divide(F.sum(good(pages)), F.sum(good(seconds))), 6).alias("pages_per_second"), F.round(F.percentile(good(seconds), 0.5), 3).alias("median_seconds"))


def extrapolated(measured: DataFrame, whole: int, sample_column: str, totals: list[str]) -> DataFrame:
    """Totals of a measured sample, scaled up to ``whole`` units; null where any is unknown."""
    scale = F.lit(whole) / F.sum(sample_column)
    return measured.agg(*[F.round(F.when(F.count(t) == F.count("*"), F.sum(t) * scale), 4).alias(t) for t in totals])


def spread(value: str, name: str) -> list[Column]:
    """Least, median, three interpolated quantiles and most of a value."""
    q = lambda p: F.round(F.percentile(value, p), 3)
    return [F.min(value).alias(f"{name}_min"), q(0.5).alias(f"{name}_median"), q(0.75).alias(f"{name}_p75"), q(0.9).alias(f"{name}_p90"), q(0.95).alias(f"{name}_p95"), F.max(value).alias(f"{name}_max")]


def facts_met(answer: Column, facts: Column) -> Column:
    """Whether an answer has every expected fact, cases and runs of space aside."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.forall(facts, lambda f: F.contains(flat(answer), flat(f)))


def lineage_problems(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence (evidence_id, chunk_id, pages, blocks) against its chunk (chunk_id, first, last, own_blocks): unknown_chunk, page_outside, foreign_block."""
    both = evidence.join(chunks, "chunk_id", "left")
    why = F.when(F.col("own_blocks").isNull(), "unknown_chunk").when(F.exists("pages", lambda p: (p < F.col("first")) | (p > F.col("last"))), "page_outside").when(F.size(F.array_except("blocks", "own_blocks")) > 0, "foreign_block")
    return both.select("evidence_id", why.alias("problem")).where("problem IS NOT NULL")
