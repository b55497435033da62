"""Splits of evaluation items: whole leakage groups under a quota for each subject, and documents apart within each subject."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.ordering import numbered


class SplitError(ValueError):
    """No split meets the quotas."""


def choose(kinds: list[tuple[tuple[int, ...], int]], quotas: tuple[int, ...]) -> list[int] | None:
    """How many groups of each kind (items by subject, number of such groups) give exactly the quotas; None if none do.

    Depth first over kinds, many groups before few; a state (kind, what is left)
    that failed is not tried again, one that the remaining kinds can't fill is left at once. Groups
    of one item come last and fill what is left.
    """
    order = sorted(range(len(kinds)), key=lambda k: (sum(kinds[k][0]) == 1, [-x for x in kinds[k][0]]))
    rest = [tuple(sum(kinds[k][0][s] * kinds[k][1] for k in order[at:]) for s in range(len(quotas))) for at in range(len(order) + 1)]
    failed, taken = set(), [0] * len(kinds)
    # an explicit stack of (depth, left, next number to try)
    stack = [(0, quotas, None)]
    while stack:
        at, left, n = stack.pop()
        if n is None:
            if (at, left) in failed or any(x > r for x, r in zip(left, rest[at])):
                continue
            if at == len(order):
                return taken
            vector, most = kinds[order[at]]
            n = min([most, *(x // v for x, v in zip(left, vector) if v)])
        if n < 0:
            failed.add((at, left))
            continue
        stack.append((at, left, n - 1))
        taken[order[at]] = n
        stack.append((at + 1, tuple(x - n * v for x, v in zip(left, kinds[order[at]][0])), None))
    return None


def quota_split(spark: SparkSession, items: DataFrame, quotas: dict[str, int], most_kinds: int = 10_000) -> DataFrame:
    """item, subject, group, split of items (item, subject, group): ``dev`` has exactly ``quotas[subject]`` items of each subject and no group is in both.

    Groups with the same items by subject are one kind, so the driver sees a row for
    each kind (``most_kinds`` at most) and how many there are; the first groups of a kind by id
    are taken. A subject without a quota has none in dev.
    """
    subjects = sorted(quotas)
    per = items.groupBy("group").agg(*[F.count_if(F.col("subject") == s).alias(f"n{k}") for k, s in enumerate(subjects)], F.count_if(~F.coalesce(F.col("subject").isin(subjects), F.lit(False))).alias("other"))
    vector = F.array(*[F.col(f"n{k}") for k in range(len(subjects))])
    per = per.select("group", vector.alias("vector"), F.concat_ws(",", vector.cast("array<string>"), F.col("other").cast("string")).alias("kind"), "other")
    able = per.where("other = 0")
    kinds = able.groupBy("vector", "kind").agg(F.count("*").alias("n")).limit(most_kinds + 1).collect()
    if len(kinds) > most_kinds:
        raise SplitError(f"over {most_kinds} kinds of groups")
    found = choose([(tuple(k["vector"]), k["n"]) for k in kinds], tuple(quotas[s] for s in subjects))
    if found is None:
        raise SplitError("no whole groups give these quotas")
    take = spark.createDataFrame([(k["kind"], n) for k, n in zip(kinds, found)] or [("", 0)], "kind string, take long")
    dev = numbered(spark, able.select("group", "kind"), "kind", "group").join(take, "kind").where("place <= take").select("group", F.lit("dev").alias("split"))
    return items.join(dev, "group", "left").select("item", "subject", "group", F.coalesce("split", F.lit("test")).alias("split"))


def _reachable(dev: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each subject, last first -> also the sums up to ``dev`` that those after each can give, as bits."""
    subject, sums = None, 1
    for batch in batches:
        out = []
        for own, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if own != subject:
                subject, sums = own, 1
            out.append(sums)
            sums |= (sums << n) & ((1 << dev + 1) - 1)
        yield batch.append_column("after", pa.array(out, pa.int64()))


def _taken(dev: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order -> whether each is in dev (null: the subject has no such choice): taken if those after it can give the rest."""
    subject, left = None, None
    for batch in batches:
        out = []
        for own, n, after in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
            if own != subject:
                possible = after | (after << n)
                subject, left = own, dev if possible >> dev & 1 else None
            out.append(None if left is None else left >= n and bool(after >> (left - n) & 1))
            if out[-1]:
                left -= n
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=["subject", "document", "dev"])


def document_split(spark: SparkSession, items: DataFrame, dev: int) -> DataFrame:
    """item, subject, document, split, apart of items (item, subject, document): ``dev`` items of each subject (at most 62), no document on both sides where this is possible.

    Of all choices of whole documents the one with the earliest documents is taken; where none
    has exactly ``dev`` items, the first items by document and id are, and ``apart`` is false. Two
    sorted passes over documents with a few numbers of state each. Null subjects and documents are values like others.
    """
    if not 0 < dev <= 62:
        raise ValueError("dev is from 1 to 62")
    key = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit(":"), F.col(c).cast("string")))
    named = items.withColumn("_s", key("subject")).withColumn("_none", F.col("document").isNull())
    docs = named.groupBy("_s", "document").agg(F.count("*").alias("n"))
    docs = docs.withColumn("n", F.least("n", F.lit(63)))  # too large for any choice
    last_first = docs.repartition("_s").sortWithinPartitions("_s", F.desc_nulls_last("document"))
    kind = dict(docs.dtypes)["document"]
    sums = last_first.mapInArrow(partial(_reachable, dev), f"_s string, document {kind}, n long, after long")
    picked = sums.repartition("_s").sortWithinPartitions("_s", F.asc_nulls_first("document")).mapInArrow(partial(_taken, dev), f"subject string, document {kind}, dev boolean")
    picked = picked.select(F.col("subject").alias("_s"), F.col("document").alias("_d"), "dev")
    both = named.join(picked, (named._s == picked._s) & named.document.eqNullSafe(F.col("_d")), "left").drop(picked._s)
    first = numbered(spark, both.select("item", "subject", "document", "_s", "dev"), "_s", "document", "item")
    chosen = F.coalesce("dev", F.col("place") <= dev)
    return first.select("item", "subject", "document", F.when(chosen, "dev").otherwise("test").alias("split"), F.col("dev").isNotNull().alias("apart"))
