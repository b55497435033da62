"""Maximal runs of repeated words, found on suffix trees.

After Stoye and Gusfield: a node of the suffix tree with depth D holds the
places at which one stretch of D words stands. If i and i + D are both among
them but continue differently, the 2 D words from i are a branching tandem
repeat. Every leaf but those of a node's largest child is asked for its partner
D before and D behind; so each leaf is asked at most log(n) times. A branching
repeat is the last one of its run: rotated to the left as long as the words
agree, it gives the run's start.

The trees of many documents are built together as arrays: a node is an interval
of the suffix array, its children are that interval's parts, and the first word
of a suffix carries its document, so that trees never share a node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.llm.common import small_batches

#: What separates words: bytes.split() splits at these and no others.
WORD = r"[^\x20\x09-\x0D]+"
_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType(), False), T.StructField("length", T.LongType(), False), T.StructField("period", T.LongType(), False)]), False)


def suffix_order(letters: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks, ranks by the first 1, 2, 4... letters). A suffix stops at its ``ends``; prefixes come first.

    Prefix doubling that sorts again only what is still tied.
    """
    n = len(letters)
    sa = np.argsort(letters, kind="stable")
    heads = np.flatnonzero(np.r_[True, letters[sa][1:] != letters[sa][:-1]])
    sizes = np.diff(np.r_[heads, n])
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(heads, sizes)
    slots, levels, k = np.flatnonzero(np.repeat(sizes > 1, sizes)), [], 1
    while len(slots):
        levels.append(rank.astype(np.int32))
        tied = sa[slots]
        after = tied + k
        inside = after < ends[tied]
        key = rank[tied] * (n + 1) + np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        sa[slots] = tied
        first = np.r_[True, key[1:] != key[:-1]]
        heads = np.flatnonzero(first)
        sizes = np.diff(np.r_[heads, len(slots)])
        rank[tied] = np.repeat(slots[heads], sizes)
        slots, k = slots[np.repeat(sizes > 1, sizes)], 2 * k
    return sa, rank, levels


def common_prefixes(sa: np.ndarray, ends: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Letters that each suffix shares with the one before it in the order; 0 at the first."""
    a, b = sa[:-1].copy(), sa[1:].copy()
    shared = np.zeros(len(a), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        k, rank = 1 << t, levels[t]
        fits = np.flatnonzero((a + k <= ends[sa[:-1]]) & (b + k <= ends[sa[1:]]))
        same = fits[rank[a[fits]] == rank[b[fits]]]
        shared[same] += k
        a[same] += k
        b[same] += k
    return np.r_[0, shared]


def _bounds(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest smaller value to the left and to the right of it."""
    n = len(lcp)
    left, right, stack = [0] * n, [n] * n, []
    for k, v in enumerate(lcp.tolist()):
        while stack and stack[-1][0] >= v:
            w, at = stack.pop()
            if w > v:
                right[at] = k
            else:  # equal values: the later one is asked in place of the earlier
                right[at] = -k
        left[k] = stack[-1][1] if stack else 0
        if v:
            stack.append((v, k))
        else:
            stack = [(0, k)]
    for k in range(n - 1, -1, -1):
        if right[k] < 0:
            right[k] = right[-right[k]]
    return np.array(left), np.array(right)


def branching_repeats(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray, least_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, D) of the branching tandem repeats with D * ``least_exponent`` words in their document."""
    sa, rank, levels = suffix_order(letters, ends)
    lcp = common_prefixes(sa, ends, levels)
    del levels
    at = np.flatnonzero(lcp)
    if not len(at):
        return at, at
    left, right = _bounds(lcp)
    at = at[lcp[at] * least_exponent <= (ends - starts)[sa[at]]]
    # A node is told by its interval's left end and depth; its children start there and at each of its places.
    order = np.lexsort((at, lcp[at], left[at]))
    at = at[order]
    depth, l, r = lcp[at], left[at], right[at]
    new = np.r_[True, (l[1:] != l[:-1]) | (depth[1:] != depth[:-1])] if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    node = np.cumsum(new) - 1
    next_start = np.where(np.r_[new[1:], True], r, np.r_[at[1:], 0]) if len(at) else at
    child_from, child_to, child_node = np.r_[at, l[first]], np.r_[next_start, at[first]], np.r_[node, np.arange(len(first))]
    depth, l, r = depth[first], l[first], r[first]
    sizes = child_to - child_from
    by = np.lexsort((sizes, child_node))
    largest = by[np.r_[child_node[by][1:] != child_node[by][:-1], True]] if len(by) else by
    small = np.ones(len(sizes), bool)
    small[largest] = False
    child_from, sizes, child_node = child_from[small], sizes[small], child_node[small]
    found_at, found_d = [], []
    n = len(letters)
    for part in np.array_split(np.arange(len(sizes)), max(1, int(sizes.sum()) >> 21)):
        if not len(part):
            continue
        c = sizes[part]
        v = np.repeat(child_node[part], c)
        i = sa[np.repeat(child_from[part] - np.r_[0, np.cumsum(c)[:-1]], c) + np.arange(c.sum())]
        d = depth[v]
        for j, low in ((i, i), (i - d, i - d)):  # the repeat would start at the leaf, or end with it
            ok = (low >= starts[i]) & (j + 2 * d <= ends[i])
            j, dd, vv, other = j[ok], d[ok], v[ok], (i + d if low is i else i - d)[ok]
            inside = (rank[other] >= l[vv]) & (rank[other] < r[vv])
            j, dd = j[inside], dd[inside]
            over = j + 2 * dd
            differs = (over >= ends[j]) | (letters[np.minimum(over, n - 1)] != letters[j + dd])
            found_at.append(j[differs])
            found_d.append(dd[differs])
    pairs = np.unique(np.stack([np.concatenate(found_at), np.concatenate(found_d)]), axis=1) if found_at else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1]


def _rotated(letters: np.ndarray, starts: np.ndarray, at: np.ndarray, d: np.ndarray, steps: int = 64) -> np.ndarray:
    """Where the runs start whose last repeats stand at ``at``."""
    at, live = at.copy(), np.arange(len(at))
    for _ in range(steps):
        live = live[at[live] > starts[at[live]]]
        before = at[live] - 1
        live = live[letters[before] == letters[before + d[live]]]
        if not len(live):
            return at
        at[live] -= 1
    for x in live.tolist():  # long ones by stretches that grow
        i, q, first, chunk = int(at[x]), int(d[x]), int(starts[at[x]]), steps
        while i > first:
            low = max(first, i - chunk)
            off = np.flatnonzero(letters[low:i] != letters[low + q : i + q])
            if len(off):
                i = low + int(off[-1]) + 1
                break
            i, chunk = low, 2 * chunk
        at[x] = i
    return at


def maximal_runs(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray, least_length: int = 6, least_exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period.

    ``letters`` are the words of all documents, ``starts`` and ``ends`` at each word where its document starts and ends.
    """
    at, d = branching_repeats(letters, starts, ends, least_exponent)
    out = []
    while len(at):
        end = at + 2 * d
        order = np.lexsort((d, end))
        at, d, end = at[order], d[order], end[order]
        lead = np.r_[True, end[1:] != end[:-1]]  # of the repeats with one end that of smallest period
        s, q, e = _rotated(letters, starts, at[lead], d[lead]), d[lead], end[lead]
        long = e - s >= np.maximum(least_length, least_exponent * q)
        out.append(np.stack([s[long], e[long], q[long]]))
        # A repeat within that run has the run's period: its root repeats itself.
        rest = ~lead & (at < s[np.cumsum(lead) - 1])
        at, d = at[rest], d[rest]
    found = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
    found = found[:, np.lexsort((found[2], found[0]))]
    return found[0], found[1], found[2]


def _groups(texts: pa.Array, words: int) -> Iterator[list[list[bytes]]]:
    """Documents of about so many words at a time; a longer one by itself."""
    held, size = [], 0
    for t in texts:
        split = (t.as_py() or "").encode().split()
        if held and size + len(split) > words:
            yield held
            held, size = [], 0
        held.append(split)
        size += len(split)
    if held:
        yield held


def runs_of(docs: list[list[bytes]], least_length: int = 6, least_exponent: int = 4) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each document's runs."""
    ids: dict[bytes, int] = {}
    letters = np.array([ids.setdefault(w, len(ids)) for d in docs for w in d], np.int64)
    sizes = np.array([len(d) for d in docs])
    offsets = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(docs)), sizes)
    starts, ends = offsets[doc], (offsets + sizes)[doc]
    s, e, q = maximal_runs(letters + doc * (len(ids) + 1), starts, ends, least_length, least_exponent)
    found: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for a, b, p in zip(s.tolist(), e.tolist(), q.tolist()):
        k = int(doc[a])
        found[k].append((a - int(offsets[k]), b - a, p))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, with single spaces."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def find_runs(spark: SparkSession, docs: DataFrame, least_length: int = 6, least_exponent: int = 4, group_words: int = 1 << 17) -> DataFrame:
    """``docs`` (with text) plus runs and collapsed, the text without what its runs repeat.

    A run is a stretch of words with smallest period q, at least
    ``least_length`` words and ``least_exponent`` periods, that can't be made longer. Runs of
    one text are ordered by start, then period; ties can't occur. Null and
    empty texts have no runs and an empty collapsed text; repeated rows get equal results; an empty
    table stays empty. A very long text is one tree of its own, with
    about 150 bytes a word and 4 more for each doubling of its longest repeat. Columns of
    ``docs`` named runs or collapsed give way. No shuffle.
    """
    small_batches(spark)
    kept = docs.drop("runs", "collapsed")
    names = kept.columns
    text_at = names.index("text")
    kind = pa.list_(pa.field("element", pa.struct([pa.field(f.name, pa.int64(), False) for f in _RUNS.elementType.fields]), False))

    def found(batches):
        for batch in batches:
            runs, texts = [], []
            for held in _groups(batch.column(text_at), group_words):
                for words, own in zip(held, runs_of(held, least_length, least_exponent)):
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                    texts.append(collapsed(words, own).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, kind), pa.array(texts, pa.string())], names=[*names, "runs", "collapsed"])

    schema = T.StructType([*kept.schema.fields, T.StructField("runs", _RUNS), T.StructField("collapsed", T.StringType())])
    return kept.mapInArrow(found, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text; of every tenth document by crc32 of its id with its words from some place on repeating."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    h, n = F.crc32(doc_id.cast("string").cast("binary")), F.size(words)
    g = F.floor(h / 10).cast("long")
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    turns = F.ceil((n - a) / p).cast("int")
    turned = F.slice(F.concat(F.slice(words, 1, a), F.flatten(F.array_repeat(F.slice(words, a + 1, p), turns))), F.lit(1), n)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(turned, " ")).otherwise(text)


def report(found: DataFrame) -> DataFrame:
    """doc_id with the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    best = F.struct((-best["col2"]).alias("start"), best["length"].alias("length"), (-best["col3"]).alias("period"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), "runs", lines.alias("lines"), "collapsed").select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.col("n_runs") > 0, F.concat("lines", F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
