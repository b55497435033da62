"""Near-duplicates by SimHash, found with the generalised pigeonhole principle.

The 64 bits are dealt into parts so that correlated bits stand together. If
the thresholds of the parts add up to tau - parts + 1, two fingerprints within
tau bits are within the threshold of at least one part. A dynamic programme
chooses the thresholds, unequal if that is cheaper, from estimated candidate
counts over all fingerprints. A part of threshold t is probed by its value
with every choice of t bits masked; those that meet under one key are verified.

Texts of a Jaccard similarity near 0.8 differ in about 15 % of the bits, too
many for one fingerprint of 64. ``similar_groups`` takes several independent
ones, probes each for itself by keys whose width does not depend on the size
of the table, and verifies every link on the sets of shingles themselves.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.llm.common import small_batches, written
from tidemark.operators.components import components

_HASH = xxhash.xxh64_intdigest
#: The column of ``_parities``, and the bits that a set has of them at least and at most.
PARITIES = ["odd"]
LEAST_BITS, MOST_BITS = 512, 1 << 16


def _more(hashes: np.ndarray, words: int) -> np.ndarray:
    """(shingles, words): the hash itself, then hashes of it by an odd step and the finaliser of splitmix64."""
    out = hashes[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rest = out[:, 1:]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        rest ^= rest >> np.uint64(shift)
        rest *= np.uint64(factor)
    rest ^= rest >> np.uint64(31)
    return out


def shingles(text: str | None, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Hashes of a whole text's shingles in order, with repeats: ASCII lower case; of fewer words the whole sequence, without words none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, "<u8")
    line = b" ".join(tokens)
    if len(tokens) <= shingle:
        return np.array([_HASH(line, seed)], "<u8")
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - shingle + 1].tolist()
    return np.array([_HASH(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], "<u8")


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42, words: int = 1) -> np.ndarray:
    """``words`` independent SimHashes of a whole text: ASCII lower case, shingles with repeats; 0 without words."""
    hashes = shingles(text, shingle, seed)
    if not len(hashes):
        return np.zeros(words, np.uint64)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255):  # counts of 255 rows fit a byte
        part = _more(hashes[at : at + 255], words)
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def _names(words: int) -> list[str]:
    return ["fp", *(f"fp{i}" for i in range(1, words))]


def _set_id(distinct: np.ndarray) -> int:
    """A signed 64-bit hash of a sorted set of shingles."""
    return xxhash.xxh3_64_intdigest(distinct.tobytes()) - (1 << 63)


def _parities(distinct: np.ndarray) -> np.ndarray:
    """A set of shingles as bits: 1 if an odd number of them falls on it. Two of them differ in no more bits than the sets in shingles.

    Two to four bits a shingle, a power of two; more than ``MOST_BITS`` would make long rows, so longer sets are told apart less well.
    """
    bits = min(max(LEAST_BITS, 2 << (len(distinct) - 1).bit_length()), MOST_BITS) if len(distinct) else LEAST_BITS
    odd = np.bincount((distinct % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _bits_apart(x: Column, y: Column) -> Column:
    """In how many bits two columns of ``_parities`` differ, of which one is at most twice as long: its halves fall together."""
    xor = lambda a, b: a.bitwiseXOR(b)
    half = lambda c: (F.size(c) / 2).cast("int")
    folded = lambda c: F.zip_with(F.slice(c, F.lit(1), half(c)), F.slice(c, half(c) + 1, half(c)), xor)
    fit = lambda c, other: F.when(F.size(c) > F.size(other), folded(c)).otherwise(c)
    return F.aggregate(F.zip_with(fit(x, y), fit(y, x), lambda a, b: F.bit_count(xor(a, b))), F.lit(0), lambda n, b: n + b)


def fingerprints(spark: SparkSession, docs: DataFrame, shingle: int = 3, words: int = 1, sets: bool = False) -> DataFrame:
    """(doc_id, fp, fp1, ...) of every row, each fp a signed long of 64 bits. A null text has no words. ``sets`` adds node, which tells its set of shingles, size and ``PARITIES``."""
    small_batches(spark)
    names = _names(words)

    told = ["doc_id", *names, "node", "size", *PARITIES]

    def run_sets(batches):
        for batch in batches:
            rows = []
            for t in batch.column(1):
                raw = t.as_py()
                own = np.unique(shingles(raw, shingle))
                rows.append((*fingerprint(raw, shingle, words=words).view(np.int64).tolist(), _set_id(own), len(own), _parities(own)))
            columns = list(zip(*rows)) if rows else [[]] * (len(told) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.list_(pa.int64()))], names=told)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, words=words) for t in batch.column(1)], np.uint64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(fps[:, i]).view(np.int64)) for i in range(words))], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.ArrayType(T.LongType()) if c in PARITIES else T.LongType()) for c in (told[1:] if sets else names))])
    return docs.select("doc_id", "text").mapInArrow(run_sets if sets else run, schema)


def _statistics(distinct: DataFrame, words: int) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each word, how often bits i and j are both set, over all of them."""

    def run(batches):
        total, n = np.zeros((words, 64, 64)), 0
        for batch in batches:
            for i in range(words):
                bits = np.unpackbits(batch.column(i).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total[i] += bits.T @ bits
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size + 1, dtype=np.int32)), pa.array(np.append(total.ravel(), n).astype(np.int64))], names=["at", "n"])

    found = distinct.select(*_names(words)).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # 4,096 rows a word and one
    counts = np.zeros(words * 4096 + 1)
    for r in found:
        counts[r["at"]] = r["n"]
    return int(counts[-1]), counts[:-1].reshape(words, 64, 64)


def deal_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of about equal width, each grown from the bit left that is most correlated with what it has."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, dealt = set(range(64)), []
    for i in range(parts):
        width = len(left) // (parts - i)
        seed = max(left, key=lambda b: (sum(corr[b, x] for x in left), -b))
        own = [seed]
        left.remove(seed)
        while len(own) < width:
            b = max(left, key=lambda b: (sum(corr[b, x] for x in own), -b))
            own.append(b)
            left.remove(b)
        dealt.append(sorted(own))
    return dealt


def allocate(n: int, both: np.ndarray, dealt: list[list[int]], tau: int) -> tuple[list[int], float]:
    """Thresholds of the parts (-1: not probed) of least estimated cost, by dynamic programming; and that cost.

    Cost: pairs expected to meet under the keys of a part (bits agree with
    p*p + (1-p)*(1-p)), and a few operations for each key.
    """
    n = max(n, 2)  # an empty table must not make keys look free
    p = np.diag(both) / n
    agree = p * p + (1 - p) * (1 - p)
    want = tau - len(dealt) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in dealt:
        costs = [(-1, 0.0)]
        for t in range(0, min(tau, 3) + 1):
            left_out = np.zeros(t + 1)  # elementary symmetric polynomials of 1 / agree: the sum over all choices of t bits
            left_out[0] = 1
            for b in bits:
                left_out[1:] += left_out[:-1] / agree[b]
            pairs = float(np.prod(agree[bits]) * left_out[t]) * n * n / 2
            costs.append((t, pairs + 40.0 * n * comb(len(bits), t)))
        nxt: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, ts) in best.items():
            for t, c in costs:
                if done + t not in nxt or cost + c < nxt[done + t][0]:
                    nxt[done + t] = (cost + c, [*ts, t])
        best = nxt
    cost, ts = min((v for k, v in best.items() if k >= want), default=(float("inf"), []))
    return ts, cost


def masks(n: int, both: np.ndarray, tau: int, parts: int | None = None) -> list[int]:
    """The bits compared by every probe of the cheapest number of parts; with ``parts`` given, of tau + 1 parts probed by their plain values."""
    if parts is not None:
        if parts <= tau:
            raise ValueError("plain values of so few parts would miss pairs within tau")
        return [sum(1 << b for b in bits) for bits in deal_bits(n, both, parts)]
    tried = []
    for parts in range(1, min(tau + 1, 16) + 1):
        dealt = deal_bits(n, both, parts)
        ts, cost = allocate(n, both, dealt, tau)
        if ts:
            tried.append((cost, parts, dealt, ts))
    _, _, dealt, ts = min(tried, key=lambda x: x[:2])
    return [sum(1 << b for b in bits if b not in c) for bits, t in zip(dealt, ts) if t >= 0 for c in combinations(bits, t)]


def _forest(keys: np.ndarray, fps: np.ndarray, steps: tuple[int, ...], crossing: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of equal keys that span what is within ``steps[-1]`` bits, nearer ones (``steps``) first; rows are sorted by key, fps has a column for each word."""
    n = len(fps)
    root = np.arange(n)
    out_a, out_b = [], []
    for most in steps:
        at = np.arange(n - 1)
        shift = 1
        while len(at):
            at = at[at + shift < n]
            at = at[keys[at] == keys[at + shift]]
            if not len(at):
                break
            ok = at if crossing is None else at[crossing[at] != crossing[at + shift]]
            ok = ok[root[ok] != root[ok + shift]]  # the rest is linked already
            if len(ok):
                ok = ok[np.bitwise_count(fps[ok] ^ fps[ok + shift]).sum(1, dtype=np.int64) <= most]
            for i in ok.tolist():
                a, b = i, i + shift
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out_a.append(i)
                    out_b.append(i + shift)
            while len(ok) and (root[root] != root).any():  # every row points to its root
                root = root[root]
            shift += 1
    return np.array(out_a, int), np.array(out_b, int)


def links(spark: SparkSession, distinct: DataFrame, tau: int = 3, block: int = 1000, words: int = 1, steps: tuple[int, ...] = (), parts: int | None = None, verified: int | None = None) -> DataFrame:
    """(a, b): links between the nodes of distinct fingerprints that span every group.

    ``distinct`` has node (else fp is), fp, fp1, ... Two nodes may be linked if
    they are within tau bits in one word at least and within ``steps[-1]``
    (tau, with one word) in the first ``verified`` words together. Of the pairs
    of one key only a spanning forest is emitted, the nearest pairs first. A
    key of more than ``block`` fingerprints is cut into blocks, and every two
    blocks meet in a task of their own.
    """
    steps = steps or (tau,)
    verified = verified or words
    if "node" not in distinct.columns:
        distinct = distinct.withColumn("node", F.col("fp"))
    n, both = _statistics(distinct, words)
    probes = [(name, m) for name, own in zip(_names(words), both) for m in masks(n, own, tau, parts)]
    names = _names(verified)
    keyed = distinct.select("node", *names, F.explode(F.array([F.struct(F.lit(i).alias("probe"), F.col(name).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("value")) for i, (name, m) in enumerate(probes)])).alias("k")).select("k.probe", "k.value", "node", *names)
    hot = written(spark, keyed.groupBy("probe", "value").agg(F.count("*").alias("n")).where(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n"), "hot-keys")
    zero = F.lit(0)
    if hot.limit(1).count():
        joined = keyed.join(hot, ["probe", "value"], "left").withColumn("own", F.when(F.col("blocks").isNull(), zero).otherwise(F.pmod(F.xxhash64("node"), "blocks").cast("int")))
        pairs = F.when(F.col("blocks").isNull(), F.array(F.struct(zero.alias("x"), zero.alias("y")))).otherwise(F.transform(F.sequence(zero, F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("x"), F.greatest("own", j).alias("y"))))
        keyed = joined.select("probe", "value", "node", *names, "own", F.explode(pairs).alias("xy")).select("probe", "value", "node", *names, "own", "xy.x", "xy.y")
    else:
        keyed = keyed.select("probe", "value", "node", *names, zero.alias("own"), zero.alias("x"), zero.alias("y"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Keys whose 64-bit hashes are equal meet as one; verification parts them.
    dealt = keyed.select(F.xxhash64("probe", "value", "x", "y").alias("h"), (F.col("x") == F.col("y")).alias("within"), "own", "node", *names).repartition(tasks, "h").sortWithinPartitions("h", "within", "own", "node")

    def verify(batches):
        rest: list[pa.RecordBatch] = []
        schema = None

        def solve(table: pa.Table):
            h, within, own, node, *fps = (table.column(i).to_numpy() for i in range(4 + verified))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (within[1:] != within[:-1])
            side = np.where(within, np.arange(len(h)), -1 - own)  # between two blocks only pairs across
            a, b = _forest(np.cumsum(new), np.stack(fps, 1).view(np.uint64), steps, side)
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            rest.append(batch)
            held += batch.num_rows
            if held >= 65_536:  # all whole keys; the last may go on in the next batch
                every = pa.Table.from_batches(rest, schema)
                h = every.column(0).to_numpy()
                cut = int(np.searchsorted(h, h[-1]))
                if cut:
                    yield solve(every.slice(0, cut))
                rest = every.slice(cut).combine_chunks().to_batches()
                held = every.num_rows - cut
        if held:
            yield solve(pa.Table.from_batches(rest, schema))

    return dealt.mapInArrow(verify, "a long, b long").distinct()


def similar_pairs(spark: SparkSession, pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts (node, text) have sets of shingles of Jaccard similarity ``least`` or more, exactly."""

    def sets(batches):
        for batch in batches:
            found = [np.unique(shingles(t.as_py(), shingle)).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "s"])

    own = written(spark, texts.select("node", "text").mapInArrow(sets, "node long, s array<long>"), "shingle-sets")

    def compare(batches):
        for batch in batches:
            a, b = batch.column("sa"), batch.column("sb")
            ok = []
            for x, y in zip(a, b):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= least * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    first = pairs.join(own.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    return first.join(own.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def contracted(pairs: DataFrame) -> DataFrame:
    """Links (a, b), a < b, that join the same nodes: all smaller neighbours of b are led to the smallest of them, so that many links become the same one."""
    up = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    smallest = up.groupBy("b").agg(F.min("a").alias("m"))
    return up.join(smallest, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct()


def _common_shingles(spark: SparkSession, docs: DataFrame, shingle: int, rows: int, least: int = 3, most: int = 1 << 19) -> np.ndarray:
    """Hashes, sorted, of shingles that ``least`` of a sample of about ``rows`` texts have; ``most`` at most. They only order tokens: any list gives the same links, a good one fewer candidates."""
    n = docs.count()
    share = min(1.0, rows / max(n, 1))

    def sets(batches):
        for batch in batches:
            found = [np.unique(shingles(t.as_py(), shingle)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found or [np.zeros(0, "<u8")]).view(np.int64))], names=["token"])

    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).distinct()
    counted = sample.mapInArrow(sets, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r["token"] for r in counted.orderBy(F.desc("n"), "token").limit(most).select("token").collect()], np.int64).view(np.uint64))


def _depth(n: int) -> int:
    """How many tokens two sets have to share in their prefixes: more of them makes the prefixes longer and the candidates fewer."""
    return n // 25 + 1


def _prefix_rows(least: float, shingle: int, common: np.ndarray):
    def found(batches):
        seen: set[int] = set()
        for batch in batches:
            tokens, nodes = [], []
            for t in batch.column(0):
                own = np.unique(shingles(t.as_py(), shingle))
                node = _set_id(own)
                if not len(own) or node in seen:
                    continue
                if len(seen) < 1 << 16:
                    seen.add(node)
                often = np.isin(own, common, assume_unique=True)
                first = np.r_[own[~often], own[often]][: len(own) - int(np.ceil(least * len(own) - 1e-9)) + _depth(len(own))]
                tokens.append(first.view(np.int64))
                nodes.append(np.full(len(first), node, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(nodes))], names=["token", "node"])

    return found


def _shared(batches):
    """Rows (token, node) in order -> those of tokens that several nodes have, once each."""
    last, told = None, False  # the last row, and whether it was given out
    for batch in batches:
        rows = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        if last is not None:
            rows = np.c_[last, rows]
        new = np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(0)] if rows.shape[1] else np.zeros(0, bool)
        rows = rows[:, new]
        if not rows.shape[1]:
            continue
        same = rows[0, 1:] == rows[0, :-1]
        keep = np.r_[False, same] | np.r_[same, False]
        out = keep.copy()
        if last is not None and told:
            out[0] = False
        told = bool(keep[-1]) or (rows.shape[1] == 1 and last is not None and told)
        last = rows[:, -1:]
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(rows[0, out]), pa.array(rows[1, out])], names=["token", "node"])


def left_out(spark: SparkSession, docs: DataFrame, roots: DataFrame, shingle: int, least: float, sample_rows: int = 20_000) -> DataFrame:
    """(a, b): candidates between nodes of different roots, among them every pair of sets (roots: node, size, root, ``PARITIES``) of Jaccard similarity ``least`` or more.

    Prefix filter: shingles in one order, rare ones first; if two sets share
    c shingles, their first size - c + d share d. Only shingles that several
    sets have there are looked at further, so what fingerprints have linked already costs nothing.
    Shingles that the same sets have there count as one of their number, so a long passage
    brings its sets together once. Sets that meet are told apart by their parities, so that
    those with a passage in common, and copies that are not near enough, give no rows.
    """
    small_batches(spark)
    common = _common_shingles(spark, docs, shingle, sample_rows)
    rows = docs.select("text").mapInArrow(_prefix_rows(least, shingle, common), "token long, node long")
    shared = rows.repartition("token").sortWithinPartitions("token", "node").mapInArrow(_shared, "token long, node long")
    told = written(spark, shared.join(roots.select("node", "size", "root"), "node"), "prefixes")
    # The sets of a token by two hashes of them all: tokens of the same sets are one of their number.
    same = ["sets", "sets2"]
    of_token = told.groupBy("token").agg(F.bit_xor(F.xxhash64("node")).alias("sets"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("sets2"), F.min("root").alias("r"), F.max("root").alias("r2")).where("r < r2").select("token", *same)
    met = written(spark, told.join(of_token, "token").groupBy(*same, "node", "size", "root").agg(F.count("*").alias("tokens")), "prefixes-met")
    # Of those sets most are often of one group: they are not tried against each other, only the others against all.
    by_root = met.groupBy(*same, "root").agg(F.count("*").alias("n"))
    most = by_root.groupBy(*same).agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    apart = written(spark, met.join(most, same).join(roots.select("node", *PARITIES), "node"), "prefixes-apart")
    a = apart.where("root <> main").select(*same, "tokens", F.col("node").alias("x"), F.col("root").alias("rx"), F.col("size").alias("na"), F.col("odd").alias("xodd"))
    b = apart.select(*same, F.col("node").alias("y"), F.col("root").alias("ry"), F.col("size").alias("nb"), (F.col("root") == F.col("main")).alias("main"), F.col("odd").alias("yodd"))
    sizes = F.col("na") + F.col("nb")
    alike = F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9
    near = F.when(alike, _bits_apart(F.col("xodd"), F.col("yodd")) <= sizes - 2 * F.ceil(sizes * (least / (1 + least)) - 1e-9)).otherwise(F.lit(False))
    pairs = a.join(b, same).where("rx <> ry AND (main OR x < y)").where(near)
    pairs = pairs.select("tokens", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.least("na", "nb").alias("na"), F.greatest("na", "nb").alias("nb"))
    depth = F.floor(F.least("na", "nb") / 25) + 1
    return pairs.groupBy("a", "b", "na", "nb").agg(F.sum("tokens").alias("n")).where(F.col("n") >= depth).select("a", "b")


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 3, tau: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links of at most tau bits reach.

    Equal fingerprints are one node, so copies cost nothing beyond a count.
    Rows without words share fingerprint 0 and link like any other; a null
    doc_id has no say in component_id unless a group has no other.
    """
    own = written(spark, fingerprints(spark, docs.select(F.col("doc_id").cast("long"), "text"), shingle), "fingerprints")
    distinct = written(spark, own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    nodes = components(spark, written(spark, links(spark, distinct, tau), "near"))
    rooted = distinct.join(nodes, distinct.fp == nodes.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(spark, rooted.join(least, "root").select("fp", "component_id"), "classes")
    return own.join(classes, "fp").select("doc_id", "fp", "component_id")


def similar_groups(spark: SparkSession, docs: DataFrame, shingle: int = 5, least: float = 0.8, words: int = 12, parts: int = 4, verified: int = 4, steps: tuple[int, ...] = (26, 52), exact: bool = True) -> DataFrame:
    """(doc_id, component_id) of rows that links of similarity ``least`` or more reach: component_id is the smallest doc_id there.

    doc_id may be of any type that has an order; rows of equal doc_id should be
    equal. Two sets of shingles of Jaccard similarity s have a cosine of about
    2s / (1 + s), so 15 % of the bits differ at 0.8. Of ``words`` fingerprints
    each is cut into ``parts`` keys of 16 bits, whatever the size of the table:
    at 0.8 one of the 48 keys agrees in 97 of 100 pairs, above it more often.
    Where a key agrees, the first ``verified`` words may differ in
    ``steps[-1]`` bits (52 of 256 leaves out 1 pair in 100 at 0.8); what that
    lets through is decided by the sets of shingles themselves, so no link is
    under ``least``. Nearer pairs (``steps[0]``) are linked first, so a pair
    that fails joins two groups that hold together without it.

    Then, with ``exact``, a prefix filter over the sets finds the pairs between
    groups that share no key or fail the cut (``left_out``), so that no link is lost.

    Rows without words are alike; rows of one set of shingles are one node, so
    copies cost nothing beyond a count; null texts have no words; extra
    columns are not read; an empty table stays empty.
    """
    names = _names(words)
    own = written(spark, fingerprints(spark, docs, shingle, words, sets=True), "fingerprints")
    grouped = own.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.max("size").alias("size"), F.min(F.struct(*names, *PARITIES)).alias("fps"))
    distinct = written(spark, grouped.select("node", "least_id", "size", "fps.*"), "distinct")
    found = written(spark, links(spark, distinct.drop("least_id", "size", *PARITIES), parts - 1, words=words, steps=steps, parts=parts, verified=verified), "candidates")

    def verified_links(found: DataFrame) -> DataFrame:
        ends = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
        named = distinct.join(ends, "node").select("node", F.col("least_id").alias("doc_id"))
        texts = docs.select("doc_id", "text").join(named, "doc_id").dropDuplicates(["node"])
        return written(spark, similar_pairs(spark, found, texts, shingle, least), "near")

    def rooted(near: DataFrame) -> DataFrame:
        nodes = components(spark, written(spark, contracted(contracted(near)), "contracted"))
        return distinct.join(nodes, "node", "left").select("node", "size", "least_id", F.coalesce("root", "node").alias("root"), *PARITIES)

    near = verified_links(found)
    if exact:
        rest = written(spark, left_out(spark, docs, written(spark, rooted(near).drop("least_id"), "roots"), shingle, least), "left-out")
        near = near.unionByName(verified_links(rest))
    groups = rooted(near)
    component = groups.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = written(spark, groups.join(component, "root").select("node", "component_id"), "classes")
    return own.join(classes, "node").select("doc_id", "component_id")
