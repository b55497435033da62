"""Approximate nearest neighbours by balanced posting lists.

Inner products become distances: every vector gets one more coordinate, which
brings all candidates to the largest norm. Centroids come from balanced
k-means on a bounded sample; vectors near a boundary stand in several lists;
an in-memory graph over the centroids is searched to find the lists of a
vector, and the ratio of distances decides how many of them are used. Neighbouring
lists are packed into cells of bounded size, a long list into several, so no
list is ever in one task; a query goes once to a cell, with the lists it probes
there and the score that k others there reach in a sample. Equal vectors are
indexed once.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import small_batches, written


def balanced_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k centroids by splitting in two, halves equal in size, then Lloyd rounds with a penalty on full lists."""
    rng = np.random.default_rng(seed)
    parts = [(-len(x), 0, np.arange(len(x)))]
    made = 1
    while len(parts) < k and -parts[0][0] >= 2:
        own = heapq.heappop(parts)[2]
        sub = x[own]
        way = sub[rng.integers(len(sub))] - sub.mean(0)
        for _ in range(4):  # towards the main direction
            way = (sub - sub.mean(0)).T @ ((sub - sub.mean(0)) @ way)
            way /= np.linalg.norm(way) + 1e-12
        order = np.argsort(sub @ way, kind="stable")
        for half in (own[order[: len(own) // 2]], own[order[len(own) // 2 :]]):
            heapq.heappush(parts, (-len(half), made, half))
            made += 1
    c = np.stack([x[p].mean(0) for _, _, p in parts])
    penalty = np.zeros(len(c), c.dtype)
    for _ in range(rounds):
        nearest = np.empty(len(x), int)
        scale = 0.0
        for at in range(0, len(x), 512):
            d = x[at : at + 512] @ (-2 * c.T)
            d += (c**2).sum(1) + penalty
            nearest[at : at + 512] = d.argmin(1)
            scale += float(d[:, :: max(1, len(c) // 512)].std())
        n = np.bincount(nearest, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, nearest, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(x.dtype)
        penalty += (0.02 * scale / max(-(-len(x) // 512), 1) * (n / max(n.mean(), 1e-9) - 1)).astype(c.dtype)
    return c.astype(np.float32)


def centroid_graph(c: np.ndarray, degree: int = 16) -> np.ndarray:
    """Out-edges of each centroid: near ones that no nearer edge already leads to, then the nearest others."""
    n = len(c)
    degree = min(degree, n - 1)
    edges = np.zeros((n, max(degree, 1)), np.int64)
    norms = (c**2).sum(1)
    for at in range(0, n, 512):
        d = norms - 2 * c[at : at + 512] @ c.T + norms[at : at + 512, None]
        most = min(4 * degree + 1, n)
        wide = np.argpartition(d, most - 1, axis=1)[:, :most]
        wide = np.take_along_axis(wide, np.lexsort((wide, np.take_along_axis(d, wide, 1))), 1)[:, 1:]
        for i, near in enumerate(wide):
            own, kept = at + i, []
            between = norms[near][:, None] + norms[near] - 2 * c[near] @ c[near].T
            nearer = between <= d[i, near][:, None]  # row j, column m: m is as near j as the node itself is
            for j in range(len(near)):
                if len(kept) == degree:
                    break
                if not nearer[j, kept].any():
                    kept.append(j)
            taken = set(kept)
            kept += [j for j in range(len(near)) if j not in taken][: degree - len(kept)]
            if kept:
                edges[own] = near[(kept * degree)[:degree]]
    return edges


def graph_search(x: np.ndarray, c: np.ndarray, edges: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` centroids found nearest each row of x, nearest first, and their squared distances: best-first over the graph, for all rows at once."""
    b, n = len(x), len(c)
    beam = min(beam, n)
    norms = (c**2).sum(1)
    starts = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))
    seen = np.zeros((b, n), bool)
    seen[:, starts] = True
    ids = np.broadcast_to(starts, (b, len(starts))).copy()
    dist = norms[ids] - 2 * x @ c[starts].T
    open_ = np.ones_like(ids, bool)
    rows = np.arange(b)
    while True:
        if ids.shape[1] > beam:
            keep = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
            ids, dist, open_ = (np.take_along_axis(a, keep, 1) for a in (ids, dist, open_))
        masked = np.where(open_, dist, np.inf)
        pick = masked.argmin(1)
        live = np.isfinite(masked[rows, pick])
        if not live.any():
            break
        open_[rows, pick] = False
        nxt = edges[ids[rows, pick]]
        fresh = live[:, None] & ~seen[rows[:, None], nxt]
        seen[rows[:, None], nxt] |= live[:, None]
        first = np.ones_like(fresh)
        for j in range(1, nxt.shape[1]):  # an edge list may repeat
            first[:, j] = (nxt[:, j : j + 1] != nxt[:, :j]).all(1)
        d = np.where(fresh & first, norms[nxt] - 2 * np.einsum("bd,bkd->bk", x, c[nxt]), np.inf)
        ids, dist, open_ = np.hstack([ids, nxt]), np.hstack([dist, d]), np.hstack([open_, np.isfinite(d)])
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    return ids, np.maximum(dist + (x**2).sum(1)[:, None], 0)


def lists_of(x: np.ndarray, c: np.ndarray, edges: np.ndarray, beam: int, ratio: float, most: int, apart: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: lists whose distance is at most ``ratio`` times the nearest one's, ``most`` at most.

    A list whose centroid is within ``apart`` times the vector's distance of one already taken is left out: queries that
    probe it probe that one too. (With 1 no vector of 64 like dimensions has a second list: there centroids stand about as far from each other as from the vectors.)
    """
    ids, d = graph_search(x, c, edges, beam)
    d = np.sqrt(d)
    ok = np.isfinite(d) & (d <= ratio * d[:, :1] + 1e-6)
    ok[:, most:] = False
    for j in range(1, min(most, ids.shape[1])):
        for i in range(j):
            between = np.linalg.norm(c[ids[:, j]] - c[ids[:, i]], axis=1)
            ok[:, j] &= ~ok[:, i] | (between > apart * d[:, j])
    at, j = np.nonzero(ok)
    return at, ids[at, j]


def probes(q: np.ndarray, c: np.ndarray, edges: np.ndarray, ratio: float, least: float, beam: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: all lists whose distance is at most ``ratio`` times the nearest one's, or ``least`` where a query all but stands on a centroid.

    The graph is searched once. Rows whose farthest centroid found is still
    within the bound are measured against all centroids, 256 at a time: a wider
    beam takes a step for each centroid it opens, which costs the square of their number.
    """
    if not len(q):
        return np.zeros(0, int), np.zeros(0, int)
    ids, d = graph_search(q, c, edges, beam)
    d = np.sqrt(d)
    within = np.isfinite(d) & (d <= ratio * np.maximum(d[:, :1], least) + 1e-6)
    wide = within[:, -1] & (ids.shape[1] < len(c))
    at, j = np.nonzero(within & ~wide[:, None])
    rows, lists, norms = [at], [ids[at, j]], (c**2).sum(1)
    todo = np.flatnonzero(wide)
    for low in range(0, len(todo), 256):
        own = todo[low : low + 256]
        d = np.sqrt(np.maximum((q[own] ** 2).sum(1)[:, None] + norms - 2 * q[own] @ c.T, 0))
        at, j = np.nonzero(d <= ratio * np.maximum(d.min(1, keepdims=True), least) + 1e-6)
        rows.append(own[at])
        lists.append(j)
    return np.concatenate(rows), np.concatenate(lists)


def packed(c: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first cell of each list, cells of each list, number of cells): neighbouring lists share cells of about ``most`` rows, a list over that has several of its own."""
    coarse = balanced_kmeans(c, max(1, min(len(c) // 4, int(sizes.sum()) // most)))
    near = np.concatenate([((coarse**2).sum(1) - 2 * c[at : at + 512] @ coarse.T).argmin(1) for at in range(0, len(c), 512)])
    first, parts, cell, held = np.zeros(len(c), np.int64), np.ones(len(c), np.int64), 0, 0
    for own in np.argsort(near, kind="stable"):
        n = int(sizes[own])
        if held and held + n > most:
            cell, held = cell + 1, 0
        first[own], parts[own] = cell, max(1, -(-n // most))
        if parts[own] > 1:
            cell, held = cell + int(parts[own]), 0
        else:
            held += n
    return first, parts, cell + 1


def calibrate(v: np.ndarray, norm: float, c: np.ndarray, edges: np.ndarray, k: int, recall: float, worst: float, replicas: int, replica_ratio: float, apart: float, queries: int = 512) -> tuple[float, float]:
    """(probe ratio, median distance of the nearest list): the least ratio at which, on the sample itself, queries find ``recall`` of brute force's k nearest on average, and 19 of 20 queries ``worst`` of theirs."""
    at = np.unique(np.linspace(0, len(v) - 1, min(queries, len(v))).astype(int))
    m = min(k, len(v) - 1)
    if m < 1 or len(c) == 1:
        return 1.0, 0.0
    top = np.empty((len(at), m), np.int64)
    for low in range(0, len(at), 32):  # a few queries at a time against the whole sample
        score = v[at[low : low + 32]] @ v.T
        score[np.arange(len(score)), at[low : low + 32]] = -np.inf
        top[low : low + 32] = np.argpartition(score, len(v) - m, axis=1)[:, len(v) - m :]
    found = [lists_of(_lifted(v[top.ravel()[low : low + 256]], norm, False), c, edges, 24, replica_ratio, replicas, apart) for low in range(0, top.size, 256)]
    row, own = np.concatenate([r + 256 * k for k, (r, _) in enumerate(found)]), np.concatenate([o for _, o in found])
    q = _lifted(v[at], norm, True)
    d = np.sqrt(np.maximum((q**2).sum(1)[:, None] + (c**2).sum(1) - 2 * q @ c.T, 0))
    least = float(np.median(d.min(1)))
    ratios = d / np.maximum(d.min(1, keepdims=True), max(least, 1e-9))
    needed = np.full(top.size, np.inf)
    np.minimum.at(needed, row, ratios[row // m, own])
    needed = np.sort(needed.reshape(-1, m), axis=1)
    on_average = np.quantile(needed, recall, method="higher")
    each = needed[:, max(int(np.ceil(m * worst)) - 1, 0)]
    return float(max(on_average, np.quantile(each, 0.95, method="higher"), 1.0)), least


def _lifted(v: np.ndarray, norm: float, query: bool) -> np.ndarray:
    """Rows with one component more, all of length ``norm``. A query gets a 0 there and is scaled, which leaves its order of inner products as it is."""
    length = np.sqrt((v**2).sum(1))
    if query:
        return np.hstack([v * (norm / length)[:, None], np.zeros((len(v), 1))]).astype(np.float32)
    return np.hstack([v, np.sqrt(np.maximum(norm**2 - length**2, 0))[:, None]]).astype(np.float32)


def share_scored(v: np.ndarray, q: np.ndarray, norm: float, c: np.ndarray, edges: np.ndarray, probe: tuple[float, float], replicas: int, replica_ratio: float, apart: float) -> tuple[float, float]:
    """(share of the vectors that a query is scored against, lists that a vector stands in), on average: what pruning and replication do."""
    row, own = lists_of(_lifted(v, norm, False), c, edges, 24, replica_ratio, replicas, apart)
    member = np.zeros((len(c), len(v)), bool)
    member[own, row] = True
    at, lists = probes(_lifted(q, norm, True), c, edges, *probe)
    return float(np.mean([member[lists[at == i]].any(0).mean() for i in range(len(q))])), len(row) / len(v)


def _rows_of_cells(batch: pa.RecordBatch, row: np.ndarray, cell: np.ndarray, lists: np.ndarray) -> pa.RecordBatch:
    """A row for each (row, cell) that occurs: the cell, the batch's columns, and its lists in that cell."""
    order = np.lexsort((lists, cell, row))
    row, cell, lists = row[order], cell[order], lists[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])
    starts = np.append(np.flatnonzero(new), len(row)).astype(np.int32)
    own = {name: batch.column(i).take(pa.array(row[new])) for i, name in enumerate(batch.schema.names) if name != "lists"}
    return pa.RecordBatch.from_arrays([pa.array(cell[new].astype(np.int64)), own.pop("id"), own.pop("v"), pa.ListArray.from_arrays(starts, lists.astype(np.int32)), *own.values()], names=["cell", "id", "v", "lists", *own])


def _best_of(query: np.ndarray, rep: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Each query's k + 1 best of the rows, repeats once."""
    order = np.lexsort((rep, -score, query))
    query, rep, score = query[order], rep[order], score[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (rep[1:] != rep[:-1]) | (score[1:] != score[:-1])
    query, rep, score = query[new], rep[new], score[new]
    keep = np.arange(len(query)) - np.searchsorted(query, query) <= k
    return query[keep], rep[keep], score[keep]


def _scanned(q: pa.StructArray, p: pa.StructArray, dim: int, k: int, wide: int = 256, deep: int = 4096):
    """Hits of a block of queries in a cell's rows: a query is scored against the rows that stand in a list it probes."""
    names = np.unique(p.field("lists").flatten().to_numpy())
    own = p.field("lists")
    at = np.diff(own.offsets.to_numpy())
    nth = np.concatenate([np.arange(n) for n in at]) if len(at) else at
    table = np.full((len(p), int(at.max(initial=1))), len(names))  # the last place is a list that nobody probes
    table[np.repeat(np.arange(len(p)), at), nth] = np.searchsorted(names, own.flatten().to_numpy())
    pv, rep = p.field("v").flatten().to_numpy().reshape(-1, dim), p.field("id").to_numpy()
    for low in range(0, len(q), wide):
        part = q.slice(low, wide)
        qv, query, floor = part.field("v").flatten().to_numpy().reshape(-1, dim), part.field("id").to_numpy(), part.field("floor").to_numpy()
        asked = part.field("lists")
        row, probed = np.repeat(np.arange(len(part)), np.diff(asked.offsets.to_numpy())), asked.flatten().to_numpy()
        place = np.searchsorted(names, probed)
        known = (place < len(names)) & (names[np.minimum(place, len(names) - 1)] == probed)
        probe = np.zeros((len(names) + 1, len(part)), bool)
        probe[place[known], row[known]] = True
        for top in range(0, len(p), deep):
            rough = qv @ pv[top : top + deep].T
            lists = table[top : top + deep]
            over = rough >= floor[:, None]
            many = np.flatnonzero(over.sum(1) > 4 * (k + 9))
            if len(many):  # no floor or a low one: the best of the rows asked for, with all that tie at the edge
                asked_for = np.where(np.logical_or.reduce([probe[of][:, many].T for of in lists.T]), rough[many], -np.inf)
                m = min(asked_for.shape[1], k + 9)
                edge = np.partition(asked_for, asked_for.shape[1] - m, axis=1)[:, asked_for.shape[1] - m] - 1e-9
                over[many] = (asked_for >= np.maximum(edge, floor[many])[:, None]) & (asked_for > -np.inf)
            i, j = np.nonzero(over)
            met = np.logical_or.reduce([probe[lists[j, t], i] for t in range(lists.shape[1])])
            i, j = i[met], j[met]
            if len(i):
                yield _best_of(query[i], rep[top + j], (qv[i] * pv[top + j]).sum(1), k)


def search(spark: SparkSession, vectors: DataFrame, query_every: int = 20, k: int = 20, sample_rows: int = 65_536, list_rows: int = 48, most_lists: int = 16_384, replicas: int = 3, replica_ratio: float = 1.2, apart: float = 0.3, recall: float = 0.94, worst: float = 0.75, block: int = 2048, cell_rows: int = 16_384, pilot_rows: int = 32_768) -> DataFrame:
    """The k nearest of every row whose vec_id ``query_every`` divides: query_id, rank, vec_id, score.

    Nearness is the largest inner product. Null vectors, zero ones, those with
    a null or non-finite component and null vec_ids take no part; vectors of
    another length than the most frequent one neither. Ties go to the smaller
    vec_id; a repeated vec_id counts once for each distinct vector. Centroids
    are fitted on a sample of about ``sample_rows`` vectors and number at most
    ``most_lists``, which bounds what is broadcast; all rows are indexed. How
    many lists a query probes follows from the distance ratio alone, which is
    set on the sample so that queries find ``recall`` of brute force's result on
    average and 19 of 20 ``worst`` of theirs.
    """
    small_batches(spark)
    clean = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    )
    sized = clean.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not sized:
        return spark.createDataFrame([], out)
    dim = sized[0]["n"]
    clean = clean.where(F.size("v") == dim)
    # equal vectors once, with their k + 1 smallest ids: a query needs no more of them
    ranked = clean.distinct().withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    reps = written(spark, ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0]), "vectors")
    queries = written(spark, clean.where(F.col("vec_id") % query_every == 0).distinct().withColumnRenamed("vec_id", "query_id"), "vector-queries")
    n, norm2 = reps.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    norm = float(norm2) ** 0.5
    share = min(1.0, sample_rows / n)
    sample = reps.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").toPandas()["v"]
    v = np.stack(sample.to_list()) if len(sample) else np.ones((1, dim))
    x = _lifted(v, norm, False)
    lists = max(1, min(-(-n // list_rows), most_lists, max(len(x) // 4, 1)))
    c = balanced_kmeans(x, lists)
    edges = centroid_graph(c)
    probe_ratio, least = calibrate(v, norm, c, edges, k, recall, worst, replicas, replica_ratio, apart)
    model = spark.sparkContext.broadcast((c, edges))  # most_lists centroids at most
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def assign(batches):
        c, edges = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("v").flatten().to_numpy().reshape(-1, dim)
            for at in range(0, len(flat), 256):
                row, own = lists_of(_lifted(flat[at : at + 256], norm, False), c, edges, 24, replica_ratio, replicas, apart)
                order = np.lexsort((own, row))
                starts = np.searchsorted(row[order], np.arange(min(256, len(flat) - at) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(starts, own[order].astype(np.int32)), *(batch.column(i).slice(at, 256) for i in range(batch.num_columns))], names=["lists", *batch.schema.names])

    postings = written(spark, reps.select("rep", "v").repartition(tasks).mapInArrow(assign, "lists array<int>, rep long, v array<double>"), "postings")
    sizes = np.zeros(len(c), np.int64)
    for r in postings.select(F.explode("lists").alias("list")).groupBy("list").count().collect():  # a row for each list
        sizes[r["list"]] = r["count"]
    first, parts, cells = packed(c, sizes, max(1024, min(cell_rows, int(sizes.sum()) // 64)))
    places = spark.sparkContext.broadcast((first, parts))
    some = int(min(1 / 8, pilot_rows / n) * (1 << 20))
    pilot = postings.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < some).select("v", "lists").toPandas()
    pv = np.stack(pilot["v"].to_list()) if len(pilot) else np.ones((0, dim))
    in_lists = np.full((len(pv), replicas), len(c))
    for i, own in enumerate(pilot["lists"]):
        in_lists[i, : len(own)] = own
    ahead = spark.sparkContext.broadcast((pv, in_lists))  # about pilot_rows vectors and the lists they stand in

    def in_cells(batches):
        """A row for each cell that a vector stands in, with its lists there."""
        first, parts = places.value
        for batch in batches:
            held = batch.column("lists").flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("lists").offsets.to_numpy()))
            cell = first[held] + (batch.column("id").to_numpy()[row] * 2_654_435_761 >> 16) % parts[held]  # ids of one step are spread too
            yield _rows_of_cells(batch, row, cell, held)

    def probing(batches):
        """As ``in_cells``, for the lists that a query probes and all their cells; ``floor`` is a score that k + 1 vectors of these lists reach, so no less can count."""
        c, edges = model.value
        first, parts = places.value
        pv, in_lists = ahead.value
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy().reshape(-1, dim)
            for at in range(0, len(flat), 256):
                part = flat[at : at + 256]
                row, own = probes(_lifted(part, norm, True), c, edges, probe_ratio, least)
                floor = np.full(len(part), -np.inf)
                probed = np.zeros((len(part), len(c) + 1), bool)
                probed[row, own] = True
                for low in range(0, len(part) if len(pv) > k else 0, 32):
                    score = part[low : low + 32] @ pv.T
                    score[~np.logical_or.reduce([probed[low : low + 32][:, of] for of in in_lists.T])] = -np.inf
                    floor[low : low + 32] = np.partition(score, len(pv) - k - 1, axis=1)[:, len(pv) - k - 1]
                own, again = np.repeat(own, parts[own]), np.repeat(np.arange(len(own)), parts[own])
                nth = np.arange(len(own)) - np.searchsorted(again, again)
                held = pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, 256) for i in range(batch.num_columns)), pa.array(floor - 1e-9)], names=[*batch.schema.names, "floor"])
                yield _rows_of_cells(held, row[again], first[own] + nth, own)

    def blocks(df: DataFrame, n: int, name: str, *held: str) -> DataFrame:
        """The rows of each cell in ``n`` blocks, each an array."""
        dealt = df.withColumn("b", F.pmod(F.xxhash64("id", "v"), F.lit(n)))
        return dealt.groupBy("cell", "b").agg(F.collect_list(F.struct("id", "v", "lists", *held)).alias(name))

    # every block of queries goes to its cell's rows
    shape = "cell long, id long, v array<double>, lists array<int>"
    kept = blocks(postings.select("lists", F.col("rep").alias("id"), "v").mapInArrow(in_cells, shape), 1, "p")
    asking = blocks(queries.select(F.col("query_id").alias("id"), "v").repartition(tasks).mapInArrow(probing, f"{shape}, floor double"), -(-max(queries.count(), 1) // block), "q", "floor")
    pairs = asking.select("cell", "q").join(kept.select("cell", "p"), "cell").select("q", "p")

    def out(hits):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in hits], names=["query_id", "rep", "score"])

    def scan(batches):
        """Scores of pairs of blocks; a task thins its hits per query before they are shuffled, and never holds more than a bounded number."""
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def thinned():
            return _best_of(*(np.concatenate(c) for c in zip(*held)), k)

        for batch in batches:
            for q, p in zip(batch.column("q"), batch.column("p")):
                for hits in _scanned(q.values, p.values, dim, k):
                    held.append(hits)
                    rows += len(hits[0])
                    if rows > 1 << 20:
                        held = [thinned()]
                        rows = len(held[0][0])
                        if rows > 1 << 19:  # so many queries: what stands so far goes on
                            yield out(held[0])
                            held, rows = [], 0
        if held:
            yield out(thinned())

    hits = pairs.mapInArrow(scan, "query_id long, rep long, score double").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    top = hits.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth")
    members = top.join(reps.select("rep", "ids"), "rep").select("query_id", "score", F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return members.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
