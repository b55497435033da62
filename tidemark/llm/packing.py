"""Best-fit packing of documents into fixed-size sequences by linear grouping.

The plan is made from the histogram of piece lengths, which has at most
``capacity`` entries however many documents there are:

1. large lengths are dealt into groups of equal cardinality and each is
   rounded up to its group's largest,
2. the few rounded sizes are packed by a configuration programme (column
   generation: a small linear programme over patterns, priced by a knapsack),
3. actual lengths take the places of the rounded ones,
4. small lengths, and what rounding down the programme left, go best-fit into
   the room that remains.

Sequences that look alike are handled as one run with a multiplicity, so the
plan is a bounded list of runs: of the pieces of one length, those of rank
r0 .. r0 + count - 1 go to sequences base .. base + count - 1 at one offset.
A piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import shared_dir, small_batches
from tidemark.llm.tokenize import encoder, release

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])


def configurations(sizes: list[int], demands: list[int], capacity: int, rounds: int = 400) -> list[tuple[int, tuple[int, ...]]]:
    """(times, copies of each size): column generation, the optimum rounded down.

    Patterns start as one size each; a revised simplex over at most
    ``len(sizes)`` patterns; the pricing problem is an unbounded knapsack.
    """
    k = len(sizes)
    if not k:
        return []
    w, d = np.array(sizes), np.array(demands, float)
    basis = np.diag((capacity // w).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ d
    for _ in range(rounds):
        duals = np.maximum(inverse.sum(axis=0), 0)
        best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(w.min()), capacity + 1):
            fits = w <= c
            gain = np.where(fits, best[np.maximum(c - w, 0)] + duals, -1)
            j = int(gain.argmax())
            best[c], took[c] = (gain[j], j) if gain[j] > best[c - 1] else (best[c - 1], -1)
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                column[took[c]] += 1
                c -= w[took[c]]
        step = inverse @ column
        up = step > 1e-9
        if not up.any():
            break
        ratios = np.where(up, x / np.where(up, step, 1), np.inf)
        out = int(ratios.argmin())
        x = x - step * ratios[out]
        x[out] = ratios[out]
        basis[:, out] = column
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
    times = np.floor(np.maximum(x, 0) + 1e-6).astype(int)
    return [(int(t), tuple(int(v) for v in basis[:, j])) for j, t in enumerate(times) if t > 0]


class _Run:
    """``count`` sequences that look alike: items are (length, first rank, offset)."""

    __slots__ = ("count", "used", "items")

    def __init__(self, count: int, used: int = 0, items: tuple = ()):
        self.count, self.used, self.items = count, used, items

    def split(self, n: int) -> _Run:
        """Takes the first n sequences off."""
        first = _Run(n, self.used, self.items)
        self.count -= n
        self.items = tuple((length, r0 + n, at) for length, r0, at in self.items)
        return first

    def put(self, length: int, r0: int) -> None:
        self.items += ((length, r0, self.used),)
        self.used += length


def plan(histogram: dict[int, int], capacity: int, groups: int = 96, small: float = 0.45) -> list[_Run]:
    """Runs that hold every piece of the histogram once, none over capacity."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    rank: dict[int, int] = defaultdict(int)
    done: list[_Run] = []

    def take(length: int, n: int) -> int:
        r0 = rank[length]
        rank[length] += n
        left[length] -= n
        return r0

    if full := left.get(capacity, 0):
        done.append(run := _Run(full))
        run.put(capacity, take(capacity, full))
    large = [(n, left[n]) for n in sorted(left, reverse=True) if left[n] and n >= max(small * capacity, 1)]
    total = sum(c for _, c in large)
    each, grouped = -(-total // groups) if total else 1, []  # grouped: lists of [length, count], longest first
    room = 0
    for n, c in large:
        while c:
            if not room:
                grouped.append([])
                room = each
            m = min(c, room)
            grouped[-1].append([n, m])
            c, room = c - m, room - m
    sizes = [g[0][0] for g in grouped]
    merged: dict[int, list] = defaultdict(list)
    for size, g in zip(sizes, grouped):
        merged[size] += g
    sizes = sorted(merged, reverse=True)
    demands = [sum(c for _, c in merged[s]) for s in sizes]
    open_runs: list[_Run] = []
    for times, copies in configurations(sizes, demands, capacity):
        runs = [_Run(times)]
        for size, m in zip(sizes, copies):
            for _ in range(m):
                nxt = []
                for run in runs:
                    source = merged[size]
                    while run is not None and source:
                        n = min(run.count, source[0][1])
                        part, run = (run.split(n), run) if n < run.count else (run, None)
                        part.put(source[0][0], take(source[0][0], n))
                        source[0][1] -= n
                        if not source[0][1]:
                            source.pop(0)
                        nxt.append(part)
                    if run is not None:
                        nxt.append(run)
                runs = nxt
        open_runs += runs
    by_used: dict[int, list[_Run]] = defaultdict(list)
    for run in open_runs:
        by_used[run.used].append(run)
    for length in sorted((n for n in left if left[n] > 0), reverse=True):
        used = capacity - length  # the fullest sequence with room
        while left[length] > 0:
            while used >= 0 and not by_used.get(used):
                used -= 1
            if used > 0:
                run = by_used[used].pop()
                n = min(run.count, left[length])
                part = run.split(n) if n < run.count else run
                if part is not run:
                    by_used[used].append(run)
                part.put(length, take(length, n))
                by_used[part.used].append(part)
                used = capacity - length
            else:
                per = capacity // length
                whole, rest = divmod(left[length], per)
                for count, m in ((whole, per), (1, rest)):
                    if count and m:
                        run = _Run(count)
                        for _ in range(m):
                            run.put(length, take(length, count))
                        by_used[run.used].append(run)
    return done + [run for used in by_used for run in by_used[used] if run.used]


def best_plan(histogram: dict[int, int], capacity: int) -> list[_Run]:
    """The plan of fewest sequences over a few numbers of groups and cuts between large and small."""
    tried = [plan(histogram, capacity, g, s) for g, s in ((96, 0.45), (48, 0.5))]
    return min(tried, key=lambda runs: sum(r.count for r in runs))


def cut_pieces(spark: SparkSession, docs: DataFrame, vocabulary: str, spaced: bool, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of documents, written to the shared folder: doc_id, piece, start, length, ids_crc32,
    part (the task that cut it), nth (how many of its length came before in that part) and maybe ids.

    A null text is an empty one and gives the end id alone; a document over
    ``capacity`` ids is cut from its end, so that only its first piece may be
    shorter; equal rows all stay.
    """
    small_batches(spark)
    schema = pa.schema([*_PIECES, pa.field("ids", pa.list_(pa.int32()))]) if with_ids else _PIECES

    def cut(batches):
        from pyspark import TaskContext

        part, seen, enc = TaskContext.get().partitionId(), defaultdict(int), encoder(vocabulary, spaced)
        end = np.array([end_id], enc.dtype)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_each(batch.column(1))):
                ids = np.append(ids, end).astype("<u4")
                at, piece = 0, 0
                while at < len(ids):
                    n = (len(ids) - at) % capacity or capacity
                    own = ids[at : at + n]
                    row = (doc_id, piece, at, n, zlib.crc32(own.tobytes()), part, seen[n])
                    rows.append((*row, own.astype(np.int32)) if with_ids else row)
                    seen[n] += 1
                    at, piece = at + n, piece + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        release()

    found = docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids)
    path = shared_dir(spark, "pieces")
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def pack(spark: SparkSession, pieces: DataFrame, capacity: int) -> DataFrame:
    """Gives each piece its sequence_id and offset. An empty table stays empty.

    Pieces of one length are alike to the plan: which of them goes where
    follows from part and nth, so ties are settled by the order of the input,
    and repeated rows are pieces of their own. Columns besides stay as they are.
    """
    counts = pieces.groupBy("part", "length").count()
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    found, base = defaultdict(list), 0
    for run in best_plan(histogram, capacity):
        for length, r0, at in run.items:
            found[length].append((r0, base, at))
        base += run.count
    places = {n: tuple(np.array(c, np.int64) for c in zip(*sorted(rows))) for n, rows in found.items()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(firsts, ["part", "length"], "left").withColumn("rank", F.col("nth") + F.col("first")).drop("part", "nth", "first")

    def place(batches):
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths):
                own = lengths == n
                r0, to, at = places[int(n)]
                k = np.searchsorted(r0, ranks[own], side="right") - 1
                sequence[own], offset[own] = to[k] + ranks[own] - r0[k], at[k]
            keep = [i for i, name in enumerate(batch.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)], names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.drop("rank").schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(spark: SparkSession, docs: DataFrame, vocabulary: str, spaced: bool = True, end_id: int = 0, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Packs whole documents; see cut_pieces and pack."""
    return pack(spark, cut_pieces(spark, docs, vocabulary, spaced, end_id, capacity, with_ids), capacity)
