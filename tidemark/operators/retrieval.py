"""Retrieval branches and their fusion: each is a table (query_id, rank, score, doc_id) for many queries at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions.text import ascii_tokens
from tidemark.sources.tables import written

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", tokens: Column | None = None) -> DataFrame:
    """(key, term, tf); a null text has none."""
    words = ascii_tokens(F.col(text)) if tokens is None else tokens
    return docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, digits: int = 4) -> DataFrame:
    """query_id, rank, doc_id, score, matched (terms, sorted). Document frequencies are those of ``docs``, the scope.

    queries: query_id and text. Terms of a query count once. Ties: smaller doc_id.
    """
    index = written(docs.sparkSession, postings(docs), "postings")
    terms = postings(queries, "query_id").select("query_id", "term")
    lengths = index.groupBy("doc_id").agg(F.sum("tf").alias("len"))
    scope = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    wanted = index.join(terms.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    hits = wanted.join(df, "term").join(lengths, "doc_id").join(F.broadcast(scope))  # scope is one row
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = hits.select("doc_id", "term", part.alias("part")).join(terms, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), digits).alias("score"), F.array_join(F.array_sort(F.collect_set("term")), " ").alias("matched"))
    return top(scored, "query_id", [F.desc("score"), F.asc("doc_id")], k)


def top(df: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """Rows ranked within ``by``, the first k of each; Spark cuts each task's rows to k before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def exact_knn(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10, digits: int = 5, block: int = 2048) -> DataFrame:
    """query_id, rank, doc_id, score: cosine of every query (query_id, v) with every row (doc_id, v) but itself.

    Queries and rows are dealt to blocks of about ``block``; each block of
    queries goes to each block of rows, so one join has all the work, whatever their
    numbers, and a task holds two blocks. Each task keeps its k best of a query.
    Zero vectors and null ones take no part.
    """

    def blocks(df: DataFrame, key: str, name: str) -> DataFrame:
        """A row for each block: ids and vectors as arrays."""
        held = written(spark, df.where(F.col("v").isNotNull() & (F.size("v") > 0)).select(F.col(key).cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")), f"{name}-rows")
        n = max(1, -(-held.count() // block))
        dealt = held.withColumn(f"{name}_block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
        return dealt.groupBy(f"{name}_block").agg(F.collect_list(F.struct("id", "v")).alias(name)).withColumn(f"n_{name}", F.lit(n))

    rows, asked = written(spark, blocks(vectors, "doc_id", "p"), "row-blocks"), blocks(queries, "query_id", "q")
    n_rows = rows.select("n_p").limit(1)  # one row
    pairs = asked.crossJoin(F.broadcast(n_rows)).select("q", F.explode(F.sequence(F.lit(0), F.col("n_p") - 1)).alias("p_block")).join(rows, "p_block").select("q", "p")

    def run(batches):
        best, held = [], 0
        for batch in batches:
            for q, p in zip(batch.column(0), batch.column(1)):
                qi, di = (x.values.field("id").to_numpy() for x in (q, p))
                qv, v = (x.values.field("v").flatten().to_numpy().reshape(len(i), -1) for x, i in ((q, qi), (p, di)))
                norm, qn = np.linalg.norm(v, axis=1), np.linalg.norm(qv, axis=1)
                di, v, qi, qv = di[norm > 0], v[norm > 0] / norm[norm > 0, None], qi[qn > 0], qv[qn > 0] / qn[qn > 0, None]
                if not len(di) or not len(qi):
                    continue
                s = np.round(qv @ v.T, digits) + 0.0
                s[qi[:, None] == di[None, :]] = -np.inf
                row, col = np.nonzero(s >= np.sort(s, axis=1)[:, [max(-k, -s.shape[1])]])
                keep = np.isfinite(s[row, col])
                best.append(_best([(qi[row][keep], di[col][keep], s[row, col][keep])], k))
                held += len(best[-1][0])
                if held > 1 << 20:  # what stands so far goes on to the ranking
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best(best, k)], names=["query_id", "doc_id", "score"])
                    best, held = [], 0
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best(best, k)], names=["query_id", "doc_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, doc_id long, score double")
    return top(found, "query_id", [F.desc("score"), F.asc("doc_id")], k)


def _best(parts: list[tuple], k: int) -> tuple:
    """Of hits (query, doc, score) the k best of each query, ties to the smaller doc."""
    q, d, s = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((d, -s, q))
    q, d, s = q[order], d[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], d[keep], s[keep]


def rrf(branches: list[DataFrame], k: int = 10, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, rank): a full outer union, then sums; ties: best rank, doc_id."""
    every = None
    for i, b in enumerate(branches):
        part = b.select("query_id", "doc_id", F.col("rank").alias("r"), F.lit(i).alias("branch"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (c + F.col("r"))), 9).alias("score"), F.min("r").alias("best_rank"), F.count("*").alias("n_branches"))
    return top(fused, "query_id", [F.desc("score"), F.asc("best_rank"), F.asc("doc_id")], k)


def fair_pool(branches: list[DataFrame], limit: int = 48) -> DataFrame:
    """Round robin: first ranks of all branches in order, then second ones; a document once; at most ``limit`` a query."""
    every = None
    for i, b in enumerate(branches):
        part = b.select("query_id", "doc_id", F.col("rank").alias("r"), F.lit(i).alias("branch"))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy("query_id", "doc_id").agg(F.min(F.struct("r", "branch")).alias("at"))
    flat = first.select("query_id", "doc_id", F.col("at.r").alias("r"), F.col("at.branch").alias("branch"))
    return top(flat, "query_id", [F.asc("r"), F.asc("branch")], limit)


def quota(ranked: DataFrame, special: Column, limit: int = 8, least: int = 2) -> DataFrame:
    """The first ``limit`` of each query; if fewer than ``least`` are special, the best other special ones take the tail."""
    marked = ranked.withColumn("special", special)
    nth = F.row_number().over(Window.partitionBy("query_id", "special").orderBy("rank"))
    in_head = F.sum(F.when(F.col("special") & (F.col("rank") <= limit), 1).otherwise(0)).over(Window.partitionBy("query_id"))
    every = marked.withColumn("nth", nth).withColumn("have", in_head)
    missing = F.greatest(F.lit(least) - F.col("have"), F.lit(0))
    spare = F.col("special") & (F.col("nth") > F.col("have")) & (F.col("nth") <= F.col("have") + missing)
    n_spare = F.sum(F.when(F.col("spare"), 1).otherwise(0)).over(Window.partitionBy("query_id"))
    kept = every.withColumn("spare", spare).withColumn("n_spare", n_spare).where(F.col("spare") | (F.col("rank") <= limit - F.col("n_spare")))
    return kept.select("query_id", "doc_id", "special", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("rank"))


def first_seen(df: DataFrame, by: list[str], key: str, position: str) -> DataFrame:
    """Keeps the first of each key within ``by``."""
    w = Window.partitionBy(*by, key).orderBy(position)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def distinct_context(hits: DataFrame) -> DataFrame:
    """Of hits (query_id, rank, doc_id, blocks, text) those that say something new: a document once, and none whose text is that of an earlier kept one with a block in common.

    Without blocks two hits have none in common; null texts are equal. A query's hits are few: they are a top-k.
    """
    once = first_seen(hits, ["query_id"], "doc_id", "rank")
    same = once.groupBy("query_id", "text").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "blocks"))).alias("xs"))
    none = F.slice("xs", 1, 0)
    kept = F.aggregate("xs", none, lambda took, x: F.when(F.exists(took, lambda k: F.coalesce(F.arrays_overlap(k["blocks"], x["blocks"]), F.lit(False))), took).otherwise(F.concat(took, F.array(x))))
    return same.select("query_id", "text", F.explode(kept).alias("x")).select("query_id", "x.rank", "x.doc_id", "x.blocks", "text")


def pack_context(hits: DataFrame, budget: int) -> DataFrame:
    """In order of rank, takes what still fits into ``budget`` characters; what does not fit is skipped. Adds marker C1, C2, ...

    hits: query_id, rank, doc_id, size. A query's hits are few: they are a top-k.
    """
    ordered = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "size"))).alias("xs"))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.expr("array()").cast("array<struct<rank:int,doc_id:bigint,size:bigint>>").alias("took"))

    def fold(s: Column, x: Column) -> Column:
        fits = s["used"] + x["size"] <= budget
        item = F.struct(x["rank"].cast("int").alias("rank"), x["doc_id"].cast("bigint").alias("doc_id"), x["size"].cast("bigint").alias("size"))
        return F.when(fits, F.struct((s["used"] + x["size"]).cast("long").alias("used"), F.concat(s["took"], F.array(item)).alias("took"))).otherwise(s)

    return ordered.select("query_id", F.posexplode(F.aggregate("xs", empty, fold)["took"]).alias("pos", "x")).select("query_id", F.concat(F.lit("C"), F.col("pos") + 1).alias("marker"), "x.doc_id", "x.size")
