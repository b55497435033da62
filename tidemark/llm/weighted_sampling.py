"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A text is a weighted set: its words, weighted by how often they occur. For
each of ``samples`` draws a term has r, c ~ Gamma(2, 1) and beta ~ U(0, 1) that
follow from the term's hash; with t = floor(ln w / r + beta) and
ln a = ln c - r (t - beta + 1) the draw is the (term, t) of least a. Two sets
agree in a draw with a probability equal to their generalised Jaccard
similarity.

With r = -ln q and c = -ln p, a is at least 2 (1 - p) / (1 + p) q / w, which
needs no logarithm. The least a of a set of total weight W is exponential of
rate W, so a term whose bound is over ``SURE`` / W is not worked out: that it
were the least has a probability of e^-SURE. A draw without any term worked
out counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_SPACE = r"[\x20\x09-\x0D]"
#: Terms with a bound over this over the total weight are passed over; e^-20 is 2e-9.
SURE = 20.0
_LOW = 0xFFFFFFFF


def _unit(bits: Column) -> Column:
    """U(0, 1) from 32 bits."""
    return (bits.cast("double") + 0.5) * (1.0 / (1 << 32))


def draw(term: Column, weight: Column, log_weight: Column, total: Column, i: int) -> Column:
    """A long whose minimum over a set is the i-th draw: ln a in the high bits, a hash of (term, t) in the low 32. Null if it can't be the minimum."""
    low = F.lit(_LOW)
    h1 = F.xxhash64(term, F.lit(i))
    h2 = F.xxhash64(h1)
    h3 = F.xxhash64(h2)
    p = _unit(F.shiftrightunsigned(h1, 32)) * _unit(h1.bitwiseAND(low))
    q = _unit(F.shiftrightunsigned(h2, 32)) * _unit(h2.bitwiseAND(low))
    log_q, beta = F.log(q), _unit(h3.bitwiseAND(low))
    t = F.floor(beta - log_weight / log_q)
    log_a = F.log(-F.log(p)) + log_q * (t - beta + 1.0)
    key = F.shiftleft(((log_a + 128.0) * float(1 << 23)).cast("long"), 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64(h3, t), 32))
    return F.when((1.0 - p) * q * total * 2.0 <= (1.0 + p) * weight * SURE, key)


def words(text: Column) -> Column:
    """The words of a text; an empty array if it has none."""
    found = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"^{_SPACE}+|{_SPACE}+$", ""), f"{_SPACE}+")
    return F.when(F.element_at(found, 1) != "", found).otherwise(F.array().cast("array<string>"))


def _mins(weighted: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """Rows of keys, term (a hash), w and total -> keys and mins: the least draw of each kind, null if none was worked out."""
    drawn = weighted.select(*keys, "term", "total", F.col("w").cast("double").alias("w"), F.log(F.col("w").cast("double")).alias("log_w"))
    mins = drawn.groupBy(*keys).agg(*[F.min(draw(F.col("term"), F.col("w"), F.col("log_w"), F.col("total"), i)).alias(f"s{i}") for i in range(samples)])
    return mins.select(*keys, F.array(*[F.col(f"s{i}") for i in range(samples)]).alias("mins"))


def _lows(mins: Column) -> Column:
    return F.transform(mins, lambda x: F.coalesce(x.bitwiseAND(F.lit(_LOW)), F.lit(0)))


def signatures(texts: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """Rows of keys and term (a hash), a row for each occurrence -> keys and signature, an array of ``samples`` longs of 32 bits.

    Repeated rows are weight. A null term is a term like any other; an empty
    table stays empty; other columns are not read. Ties of ln a go to the smaller hash.
    """
    weighted = texts.groupBy(*keys, "term").agg(F.count("*").alias("w"))
    totals = weighted.groupBy(*[F.col(k).alias(f"own {k}") for k in keys]).agg(F.sum("w").alias("total"))
    joined = weighted.join(totals, [F.col(k).eqNullSafe(F.col(f"own {k}")) for k in keys])
    return _mins(joined, keys, samples).select(*keys, _lows(F.col("mins")).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """The share of draws in which two signatures agree: an estimate of their generalised Jaccard similarity, of standard error sqrt(s (1 - s) / draws). Null if one is."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def as_bytes(signature: Column) -> Column:
    """16 bits of each draw: other draws look alike with a probability of 2^-16."""
    return F.unhex(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFF))), 4, "0")), ""))


def _bucket(column: Column, bounds: list) -> Column:
    """How many bounds are below the value, found in two steps; 0 for null."""
    if not bounds:
        return F.lit(0)
    g = max(int(len(bounds) ** 0.5), 1)
    groups = [bounds[at : at + g] for at in range(0, len(bounds), g)]
    coarse = F.size(F.filter(F.lit([x[-1] for x in groups[:-1]] or [bounds[-1]]), lambda b: b < column)) if len(groups) > 1 else F.lit(0)
    fine = F.size(F.filter(F.element_at(F.array(*[F.lit(x) for x in groups]), coarse + 1), lambda b: b < column))
    return F.when(column.isNull(), 0).otherwise(coarse * g + fine)


def _keys_of(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions an int that hash partitioning sends there."""
    found, tried = {}, 0
    while len(found) < n:
        more = spark.range(tried, tried + 32 * n + 1000).select(F.col("id").cast("int").alias("k"))
        found |= {r["p"]: r["k"] for r in more.groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect() if r["p"] not in found}
        tried += 32 * n + 1000
    return [found[p] for p in range(n)]


def with_next(spark: SparkSession, docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text, next_text, deal, at, ghost: documents in descending doc_id, each with the text after it.

    The order is dealt into ``buckets`` ranges of doc_id, each a partition of
    its own (``deal`` hashes there) with its documents numbered by ``at``. A bucket ends with
    a ghost, a copy of the first document of the next one (after the last: of
    the first), so no range needs to see another. Null doc_ids come last;
    equal ones are ordered by text.
    """
    wanted = [i / buckets for i in range(1, buckets)]
    bounds = sorted({b for b in docs.agg(F.percentile_approx("doc_id", wanted, 100_000)).first()[0] or []}) if wanted else []
    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("bucket", _bucket(F.col("doc_id"), bounds))
    tops = {r["bucket"]: r["top"] for r in docs.select(F.col("doc_id").cast("long")).withColumn("bucket", _bucket(F.col("doc_id"), bounds)).groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops, reverse=True)
    before = {after: own for own, after in zip(order, order[1:] + order[:1])}  # a bucket's top is seen from the end of this one
    ids = [t for t in tops.values() if t is not None]
    at_top = F.col("doc_id").isin(ids) if ids else F.lit(False)
    if None in tops.values():
        at_top = at_top | F.col("doc_id").isNull()
    first = plain.where(at_top).groupBy("bucket", "doc_id").agg(F.max("text").alias("text"))
    moves = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0), F.lit(0))
    top_of = F.create_map(*[F.lit(x) for b, t in tops.items() if t is not None for x in (b, t)]) if ids else None
    own_top = (F.col("doc_id") == top_of[F.col("bucket")]) | (F.col("doc_id").isNull() & top_of[F.col("bucket")].isNull()) if top_of is not None else F.lit(True)
    ghosts = first.where(own_top).select("doc_id", "text", moves[F.col("bucket")].alias("bucket")).withColumn("ghost", F.lit(True))
    every = plain.select("doc_id", "text", "bucket").withColumn("ghost", F.lit(False)).unionByName(ghosts)
    dealt = every.withColumn("deal", F.element_at(F.array(*[F.lit(k) for k in _keys_of(spark, buckets)]), F.col("bucket") + 1)).drop("bucket")
    in_bucket = Window.partitionBy("deal").orderBy("ghost", F.desc_nulls_last("doc_id"), F.desc("text"))
    return dealt.repartition(buckets, "deal").select("*", F.lead("text").over(in_bucket).alias("next_text"), F.row_number().over(in_bucket).alias("at"))


def fingerprint_edits(spark: SparkSession, docs: DataFrame, samples: int = 64, buckets: int | None = None) -> DataFrame:
    """Fingerprint of every whole text and of its edited text: the second half gives way to the start of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. Null texts are empty; texts without words have
    one fingerprint of their own; equal texts have equal fingerprints; equal
    doc_ids follow in order of text, null ones come last; repeated rows stay;
    other columns are not read; an empty table stays empty.

    Words of the half that stays are counted and drawn once for both texts: a
    word's draw is shared unless it is found a different number of times.
    """
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    pairs = with_next(spark, docs, buckets).select("deal", "at", "ghost", "doc_id", "text", n.alias("n_chars"), F.substring("text", F.lit(1), n - half).alias("stays"), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half).alias("comes"))
    cut = pairs.select("deal", "at", "text", F.concat("stays", "comes").alias("edited"), F.regexp_extract("stays", rf"^([\s\S]*){_SPACE}", 1).alias("shared"))
    at = F.char_length("shared") + 1
    rest = lambda c: words(F.substring(F.col(c), at, F.char_length(c)))
    listed = cut.select("deal", "at", words(F.col("shared")).alias("b"), rest("text").alias("t"), rest("edited").alias("e"))
    none = lambda c: F.when(F.size("b") + F.size(c) == 0, F.array(F.lit(None).cast("string"))).otherwise(F.col(c))  # noqa: E731  a text without words has a term of its own
    total = (F.size("b") + F.greatest(F.least(F.size("t"), F.size("e")), F.when(F.size("b") == 0, 1).otherwise(0))).cast("double")
    parts = F.array(*[F.struct(F.lit(k).alias("k"), c.alias("words")) for k, c in ((3, F.col("b")), (1, none("t")), (2, none("e")))])
    found = listed.select("deal", "at", total.alias("total"), F.explode(parts).alias("x")).select("deal", "at", "total", "x.k", F.explode("x.words").alias("word")).select("deal", "at", "total", "k", F.xxhash64("word").alias("term"))
    counted = found.groupBy("deal", "at", "total", "term").agg(F.sum(F.col("k").bitwiseAND(F.lit(1))).alias("t"), F.sum(F.shiftright("k", 1)).alias("e"))
    one = lambda k, w: F.struct(F.lit(k).alias("k"), F.col(w).alias("w"))
    kinds = F.when(F.col("t") == F.col("e"), F.array(one(3, "t"))).when(F.col("e") == 0, F.array(one(1, "t"))).when(F.col("t") == 0, F.array(one(2, "e"))).otherwise(F.array(one(1, "t"), one(2, "e")))
    weighted = counted.select("deal", "at", "total", "term", F.explode(kinds).alias("x")).select("deal", "at", "total", "term", "x.k", "x.w")
    of = lambda k: F.first(F.when(F.col("k") == k, F.col("mins")), ignorenulls=True)
    both = _mins(weighted, ["deal", "at", "k"], samples).groupBy("deal", "at").agg(of(1).alias("t"), of(2).alias("e"), of(3).alias("b"))
    least = lambda own: F.coalesce(F.zip_with(own, "b", lambda x, y: F.least(x, y)), F.col(own), F.col("b"))
    signed = both.select("deal", "at", _lows(least("t")).alias("own"), _lows(least("e")).alias("edit"))
    lined = signed.withColumn("after", F.lead("own").over(Window.partitionBy("deal").orderBy("at"))).select(
        "deal", "at", as_bytes(F.col("own")).alias("own"), as_bytes(F.col("edit")).alias("edit"),
        likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
    ids = pairs.where("NOT ghost").select("deal", "at", "doc_id", F.col("n_chars").cast("long"), F.unhex(F.sha2(F.concat("stays", "comes"), 256)).alias("sha"))
    shown = lambda c: F.lower(F.hex(c))
    return ids.join(lined, ["deal", "at"]).select(
        "doc_id", "n_chars", shown("sha").alias("edited_sha256"), shown("own").alias("fingerprint"), shown("edit").alias("edited_fingerprint"), "near_edited", "near_next",
    )
