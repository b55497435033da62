"""Scoped search, payload joins, fusion with full tie keys, reranking, branch policy, requirements of a question."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.retrieval import B, K1
from tidemark.sources.tables import small_batches, written


class BranchError(RuntimeError):
    """No branch gave a result, or one failed where all must answer."""


def visible(points: DataFrame, kb=None, document=None, modality: str | None = None) -> DataFrame:
    """Points of a knowledge base (and document, and modality) that are searchable and not quarantined."""
    found = points.where(F.col("searchable") & ~F.coalesce(F.col("quarantined"), F.lit(False)))
    for column, value in (("kb", kb), ("document_id", document), ("modality", modality)):
        found = found if value is None else found.where(F.col(column) == value)
    return found


def scoped_bm25(docs: DataFrame, queries: DataFrame, tokens: Callable[[Column], Column], k: int = 10, digits: int = 4) -> DataFrame:
    """query_id, rank, doc_id, score, matched: BM25 within the knowledge base (kb) of each query.

    docs: kb, doc_id, text; queries: query_id, kb, text. Document frequency,
    number and mean length are those of the knowledge base. Terms of a query
    count once; a query without terms finds nothing; ties: smaller doc_id.
    The index is written once; hot terms are summed before they are shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)  # tokens of whole texts in Python
    index = written(spark, docs.select("kb", "doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("kb", "doc_id", "term").agg(F.count("*").alias("tf")), "scoped-postings")
    terms = queries.select("query_id", "kb", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    lengths = index.groupBy("kb", "doc_id").agg(F.sum("tf").alias("len"))
    scope = lengths.groupBy("kb").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    wanted = index.join(terms.select("kb", "term").distinct(), ["kb", "term"], "left_semi")
    df = wanted.groupBy("kb", "term").agg(F.count("*").alias("df"))
    hits = wanted.join(df, ["kb", "term"]).join(lengths, ["kb", "doc_id"]).join(scope, "kb")
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = hits.select("kb", "doc_id", "term", part.alias("part")).join(terms, ["kb", "term"]).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), digits).alias("score"), F.array_join(F.array_sort(F.collect_set("term")), " ").alias("matched"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def attach(hits: DataFrame, payload: DataFrame, key: str) -> DataFrame:
    """Hits with their payload; a hit without one is an error when its row is read, never dropped."""
    there = payload.withColumn("_there", F.lit(True))
    told = hits.join(there, key, "left")
    return told.where(F.coalesce(F.col("_there"), F.raise_error(F.concat(F.lit("no payload for "), F.col(key).cast("string"))).cast("boolean"))).drop("_there")


def revalidated(hits: DataFrame, source: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Hits with state against the authoritative rows: valid, mismatch (any of ``same`` differs) or gone."""
    own = source.select(key, F.struct(*same).alias("_own"))
    state = F.when(F.col("_own").isNull(), "gone").when(F.struct(*same) == F.col("_own"), "valid").otherwise("mismatch")
    return hits.join(own, key, "left").withColumn("state", state).drop("_own")


def hybrid(vector: DataFrame, graph: DataFrame, k: int = 10, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two branches (query_id, kb, document_id, chunk_id, rank, first, last, blocks) by a full outer join.

    Score to 12 places; ties by kb, document, pages, chunk, blocks. Pages are
    the widest of both, blocks the ordered union. A chunk twice in a branch
    counts at its first place, and places close up.
    """
    keys = ["query_id", "kb", "document_id", "chunk_id"]

    def side(df: DataFrame, name: str) -> DataFrame:
        once = df.groupBy(*keys).agg(F.min_by(F.struct("rank", "first", "last", "blocks"), "rank").alias("r"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("r.rank", "kb", "document_id", "chunk_id"))
        return once.select(*keys, place.alias(f"{name}_rank"), F.col("r.first").alias(f"{name}_first"), F.col("r.last").alias(f"{name}_last"), F.col("r.blocks").alias(f"{name}_blocks"))

    both = side(vector, "v").join(side(graph, "g"), keys, "full_outer")
    share = lambda n: F.coalesce(1.0 / (c + F.col(f"{n}_rank")), F.lit(0.0))
    empty = F.array().cast("array<int>")
    blocks = F.array_distinct(F.concat(F.coalesce("v_blocks", empty), F.coalesce("g_blocks", empty)))
    told = both.select(*keys, F.round(share("v") + share("g"), 12).alias("score"), F.least("v_first", "g_first").alias("first"), F.greatest("v_last", "g_last").alias("last"), blocks.alias("blocks"), "v_rank", "g_rank", F.when(F.col("g_rank").isNull(), "vector").when(F.col("v_rank").isNull(), "graph").otherwise("both").alias("source"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "kb", "document_id", "first", "last", "chunk_id", "blocks")
    return told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def source_distribution(fused: DataFrame, sources: tuple[str, ...] = ("vector", "graph", "both")) -> DataFrame:
    """One row: how many results each provenance gave, zero if none."""
    return fused.agg(*[F.count_if(F.col("source") == s).alias(s) for s in sources])


def rerank(candidates: DataFrame, score: Column, limit: int = 10) -> DataFrame:
    """Candidates (query_id, doc_id, rank) in the order of a scorer's column; ties keep the rank they had. Null scores come last."""
    told = candidates.withColumn("score", score)
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "rank")
    return told.withColumn("before", F.col("rank")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def distinct_assets(ranked: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best of each query with one hit for each asset (columns ``by``)."""
    once = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", *by).orderBy("rank"))).where("_n = 1").drop("_n")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k)


def gather(branches: dict[str, Callable[[], DataFrame]], mode: str = "strict") -> tuple[DataFrame, list[str]]:
    """All branches' rows (query_id, doc_id, rank, branch) and the names that failed.

    strict: a failure is an error; degraded: the others go on; that all fail is
    always an error. A branch is read once here, so that it fails here.
    """
    every, failed = None, []
    for name, build in branches.items():
        try:
            found = build().select("query_id", "doc_id", "rank")
            rows = written(found.sparkSession, found, f"branch-{name}").withColumn("branch", F.lit(name))
        except Exception as e:
            if mode == "strict":
                raise BranchError(f"{name}: {e}") from e
            failed.append(name)
            continue
        every = rows if every is None else every.unionByName(rows)
    if every is None:
        raise BranchError("all branches failed")
    return every, failed


def cited(candidates: DataFrame, answers: DataFrame, used: DataFrame) -> DataFrame:
    """Candidates (query_id, marker) that the answer (query_id, answer) cites as [marker] or a tool consumed (query_id, marker)."""
    named = answers.select("query_id", F.explode(F.regexp_extract_all("answer", F.lit(r"\[(C[1-9][0-9]*)\]"), F.lit(1))).alias("marker"))
    return candidates.join(named.unionByName(used.select("query_id", "marker")).distinct(), ["query_id", "marker"], "left_semi")


def build_index(chunks: DataFrame, encode: Callable[[list[str]], list[list[float]]], batch: int = 256) -> DataFrame:
    """chunk_id and vector of every chunk with text; ``encode`` gets ``batch`` texts at a time, in the workers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield pd.DataFrame({"chunk_id": part["chunk_id"], "vector": encode(part["text"].tolist())})

    return chunks.where(F.trim("text") != "").select("chunk_id", "text").mapInPandas(run, "chunk_id long, vector array<double>")


def sufficiency(needs: DataFrame, candidates: DataFrame) -> DataFrame:
    """needs (query_id, object, year, metric) with ``bound``: one candidate (query_id, text) of the query has all three.

    What a need leaves null asks for nothing. Candidates of a query are few, a top-k.
    """
    texts = candidates.groupBy("query_id").agg(F.collect_list(F.lower("text")).alias("_texts"))
    has = lambda t, c: F.col(c).isNull() | F.contains(t, F.lower(F.col(c).cast("string")))
    told = needs.join(texts, "query_id", "left")
    return told.withColumn("bound", F.coalesce(F.exists("_texts", lambda t: has(t, "object") & has(t, "year") & has(t, "metric")), F.lit(False))).drop("_texts")


def supplementary(told: DataFrame, most: int = 160) -> DataFrame:
    """query_id and the query that asks for what is not bound: its distinct parts in order, ``most`` characters."""
    parts = told.where("NOT bound").select("query_id", F.array_compact(F.array("object", F.col("year").cast("string"), "metric")).alias("p"))
    flat = parts.groupBy("query_id").agg(F.array_distinct(F.flatten(F.array_sort(F.collect_list("p")))).alias("p"))
    return flat.select("query_id", F.substring(F.array_join("p", " "), 1, most).alias("query"))


def new_memories(extracted: DataFrame, existing: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """Extracted notes (user, at, note) that say something new: none of one key with an existing one (user, note) or an earlier new one, none that holds or is held by an existing one. A user's notes are few."""
    known = existing.select("user", key(F.col("note")).alias("k")).where("k <> ''").groupBy("user").agg(F.collect_set("k").alias("_known"))
    fresh = extracted.withColumn("_k", key(F.col("note"))).where("_k <> ''").join(known, "user", "left")
    restates = F.coalesce(F.exists("_known", lambda x: F.contains(x, F.col("_k")) | F.contains(F.col("_k"), x)), F.lit(False))
    once = F.row_number().over(Window.partitionBy("user", "_k").orderBy("at"))
    return fresh.where(~restates).withColumn("_n", once).where("_n = 1").drop("_k", "_known", "_n")


def rendered(kind: Column, text: Column, caption: Column) -> Column:
    """A block as chunk text: a title with its mark, a formula between dollars, a caption above a table."""
    body = F.coalesce(text, F.lit(""))
    return F.when(kind == "title", F.concat(F.lit("## "), body)).when(kind == "formula", F.concat(F.lit("$$"), body, F.lit("$$"))).when(kind.isin("table", "image"), F.concat_ws("\n", F.nullif(caption, F.lit("")), F.nullif(body, F.lit("")))).otherwise(body)
