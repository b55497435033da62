"""Evidence: hits grouped by what they show, context of blocks, attribution, coverage and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.text import contains_term


def group_hits(hits: DataFrame, k: int) -> DataFrame:
    """Hits (query_id, evidence_id, point_id, score) to the k best evidences of each query.

    The best hit speaks for its evidence (highest score, then smallest point); hits of null
    evidence take no part. The aggregate runs before the shuffle, so a hot evidence is no hot task.
    """
    best = hits.where("evidence_id IS NOT NULL").groupBy("query_id", "evidence_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("point_id").alias("p"))).alias("b"), F.count("*").alias("hits"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("b.s", "evidence_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long"), "evidence_id", (-F.col("b.s")).alias("score"), F.col("b.p").alias("point_id"), "hits")


def context(blocks: DataFrame, key: str, at: str, text: str, most: int = 200) -> DataFrame:
    """Text before (its end) and after (its start) each block, ``most`` characters at most; null at the ends."""
    w = Window.partitionBy(key).orderBy(at)
    before, after = F.lag(text).over(w), F.lead(text).over(w)
    return blocks.withColumn("before", before.substr(F.greatest(F.char_length(before) - most + 1, F.lit(1)), F.lit(most))).withColumn("after", after.substr(1, most))


def title_path(blocks: DataFrame, depth: int = 4) -> DataFrame:
    """Blocks (document_id, at, type, text) with the last ``depth`` titles so far, the own one included.

    Only the latest titles are carried along: each block knows how many titles came before it.
    """
    w = Window.partitionBy("document_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    seen = blocks.withColumn("_n", F.count(F.when(F.col("type") == "title", 1)).over(w))
    titles = seen.where("type = 'title'").select("document_id", F.col("_n").alias("_t"), F.col("text").alias("_title"))
    up_to = Window.partitionBy("document_id").orderBy("_t").rowsBetween(-(depth - 1), 0)
    paths = titles.select("document_id", F.col("_t").alias("_n"), F.concat_ws(" > ", F.collect_list("_title").over(up_to)).alias("path"))
    return seen.join(paths, ["document_id", "_n"], "left").drop("_n")


def neighbour_turns(edges: DataFrame, most: int) -> DataFrame:
    """Edges (node, neighbour, edge): the first of every neighbour, then the second ones, ``most`` for a node."""
    nth = F.row_number().over(Window.partitionBy("node", "neighbour").orderBy("edge"))
    turn = F.row_number().over(Window.partitionBy("node").orderBy("nth", "neighbour"))
    return edges.withColumn("nth", nth).withColumn("turn", turn).where(F.col("turn") <= most)


def attribute(points: DataFrame, owners: DataFrame, key: str, claimed: str, owner: str) -> DataFrame:
    """Points with a state: unknown (no owner), ambiguous (several), null (claims none), correct or conflict."""
    one = owners.groupBy(key).agg(F.min(owner).alias("_least"), F.max(owner).alias("_most"))
    state = F.when(F.col("_least").isNull(), "unknown").when(F.col("_least") != F.col("_most"), "ambiguous").when(F.col(claimed).isNull(), "null").when(F.col(claimed) == F.col("_least"), "correct").otherwise("conflict")
    return points.join(one, key, "left").withColumn("state", state).drop("_least", "_most")


def coverage(expected: DataFrame, found: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Per bucket of ``by``: expected keys, those found and those missing."""
    marked = expected.join(found.select(key).distinct().withColumn("_found", F.lit(1)), key, "left")
    return marked.groupBy(*by).agg(F.count("*").alias("expected"), F.count("_found").alias("found"), (F.count("*") - F.count("_found")).alias("missing"))


def recovery(hits: DataFrame, gold: DataFrame, branches: list[str]) -> DataFrame:
    """Gold (query_id, doc_id) by the branches of hits (query_id, doc_id, branch) that find it:
    a branch alone, ``multiple`` or ``none``."""
    seen = hits.where(F.col("branch").isin(branches)).groupBy("query_id", "doc_id").agg(F.min("branch").alias("_a"), F.max("branch").alias("_b"))
    joined = gold.distinct().join(seen, ["query_id", "doc_id"], "left")
    return joined.withColumn("found_by", F.when(F.col("_a").isNull(), "none").when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise("multiple")).drop("_a", "_b")


def cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Price of a call by rates for a thousand tokens, eight places; null if anything is unknown."""
    exact = lambda c, kind: c.cast(kind)
    total = exact(tokens_in, "decimal(12,0)") * exact(rate_in, "decimal(10,6)") + exact(tokens_out, "decimal(12,0)") * exact(rate_out, "decimal(10,6)")
    return F.round(total / F.lit(1000).cast("decimal(4,0)"), 8)


def classify(df: DataFrame, text: str, rules: dict[str, str]) -> DataFrame:
    """Subject of each row by the rules (subject: term): of none ``unclassified``, of several ``ambiguous``."""
    hit = F.array_compact(F.array(*[F.when(contains_term(F.col(text), term), F.lit(subject)) for subject, term in rules.items()]))
    return df.withColumn("_hit", hit).withColumn("subject", F.when(F.size("_hit") == 0, "unclassified").when(F.size("_hit") == 1, F.element_at("_hit", 1)).otherwise("ambiguous")).drop("_hit")


def merge_candidates(first: DataFrame, more: DataFrame, most: int) -> DataFrame:
    """Candidates (query_id, doc_id, rank): the first ones, then those not among them, numbered C1 to Cn."""
    both = first.select("query_id", "doc_id", "rank", F.lit(0).alias("_later")).unionByName(more.select("query_id", "doc_id", "rank", F.lit(1).alias("_later")))
    once = both.groupBy("query_id", "doc_id").agg(F.min(F.struct("_later", "rank")).alias("_at"))
    placed = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_at", "doc_id"))).where(F.col("rank") <= most)
    return placed.select("query_id", "doc_id", F.col("rank").cast("long"), F.concat(F.lit("C"), "rank").alias("marker"))


def options(df: DataFrame, kind: str, most: int = 20) -> DataFrame:
    """The most frequent kinds with their counts, ties by name; null kinds take no part."""
    return df.where(F.col(kind).isNotNull()).groupBy(kind).count().orderBy(F.desc("count"), kind).limit(most)


def split_history(turns: DataFrame, key: str, at: str, text: str, most: int = 8, chars: int = 4000) -> DataFrame:
    """Turns with part: ``recent`` for the last ``most`` of a conversation that fit into ``chars`` together, else ``older``."""
    back = Window.partitionBy(key).orderBy(F.desc(at))
    used = F.coalesce(F.sum(F.char_length(text)).over(back.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return turns.withColumn("part", F.when((F.row_number().over(back) <= most) & (used <= chars), "recent").otherwise("older"))
