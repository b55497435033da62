"""Merkle manifests of a dataset, kept as the preimages of its parents.

A parent is stored as the concatenated digests of its children; its own digest
is the sha256 of that text. A leaf's proof is the list of its ancestors'
preimages: cutting its 64-character slot out of each gives the siblings,
putting another digest in its place and hashing gives the next level up.

Trees are built a tier at a time. A tier takes ``arity ** depth`` neighbours
as one row, so a tree of n leaves needs log(n) / log(arity ** depth) shuffles
of digests and no row grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import written

DIGEST = 64
_PATH = "array<struct<pre:string,slot:int>>"


def encoded(column: Column) -> Column:
    """A value's canonical form: ``-`` for null, else its UTF-8 byte count, a colon, the value."""
    value = column.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_of(*columns: Column) -> Column:
    """Digest of a row: of its values' canonical forms, one after the other."""
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def numbered(spark: SparkSession, rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with pos (from 0 within its key) and n (rows of its key), by ``order``, nulls first.

    Spark deals ranges of (key, order), so a common key is spread over many
    tasks; only the row counts of key and range meet in one place.
    """
    sorted_rows = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_id", F.monotonically_increasing_id())
    placed = written(spark, sorted_rows.withColumn("_part", F.shiftright("_id", 33)), "merkle-rows")
    counts = placed.groupBy(key, "_part").agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    by_part = Window.partitionBy(key).orderBy("_part")
    before = F.coalesce(F.sum("_rows").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(key, "_part", (F.col("_first") - before).alias("_from"), F.sum("_rows").over(Window.partitionBy(key)).alias("n"))
    return placed.join(starts, [key, "_part"]).select(*rows.columns, (F.col("_id") - F.col("_from")).alias("pos"), "n")


def _levels(digests: Column, height: Column, arity: int) -> Column:
    """Preimages of the parents of ``digests``, of their parents and so on: an array for each of ``height`` levels."""
    runs = lambda hashes: F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / arity).cast("int")), lambda i: F.array_join(F.slice(hashes, i * arity + 1, arity), ""))
    start = F.struct(digests.alias("hashes"), F.array().cast("array<array<string>>").alias("levels"))

    def up(state, _):
        return F.transform(F.array(runs(state["hashes"])), lambda pres: F.struct(F.transform(pres, lambda p: F.sha2(p, 256)).alias("hashes"), F.concat(state["levels"], F.array(pres)).alias("levels")))[0]

    rounds = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, start, up, lambda s: s["levels"])


def _tier(nodes: DataFrame, key: str, arity: int, depth: int) -> DataFrame:
    """(key, pos, n, hash, more) -> one row for each ``arity ** depth`` neighbours: key, pos (of the row), n (rows of the key), members, levels, hash (of its top)."""
    width = arity**depth
    height = F.least(F.lit(depth), F.ceil(F.log(F.col("n").cast("double")) / F.log(F.lit(float(arity))) - 1e-9).cast("int"))
    rows = nodes.groupBy(key, F.floor(F.col("pos") / width).cast("long").alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("pos", "hash", "more"))).alias("members"))
    built = rows.withColumn("levels", _levels(F.transform("members", lambda m: m["hash"]), F.greatest(height, F.lit(0)), arity))
    top = F.when(F.size("levels") > 0, F.sha2(F.element_at("levels", -1)[0], 256)).otherwise(F.col("members")[0]["hash"])
    return built.select(key, F.col("block").alias("pos"), F.ceil(F.col("n") / width).cast("long").alias("n"), "members", "levels", top.alias("hash"))


def paths(spark: SparkSession, leaves: DataFrame, key: str, arity: int = 2, depth: int = 8) -> DataFrame:
    """Every leaf with its ancestors' preimages.

    ``leaves`` has key (never null), pos, n (see ``numbered``), hash and more (any
    column, carried along). Returns key, pos, hash, more, path (preimage and
    slot of each ancestor, parent first) and top (the tree's digest). A key of one leaf
    has an empty path and that leaf as top. An empty table stays empty.
    """
    tiers, nodes = [], leaves.select(key, "pos", "n", "hash", "more")
    while True:
        tiers.append(written(spark, _tier(nodes, key, arity, depth), "merkle-tier"))
        if tiers[-1].where("n > 1").isEmpty():
            break
        nodes = tiers[-1].where("n > 1").select(key, "pos", "n", "hash", F.lit(None).cast("int").alias("more"))
    above = None
    for tier in reversed(tiers):
        whole = tier.where("n = 1").select(key, "pos", "members", "levels", F.array().cast(_PATH).alias("upper"), F.col("hash").alias("top"))
        if above is not None:
            part = tier.where("n > 1").select(key, "pos", "members", "levels").join(above, [key, "pos"])
            whole = whole.unionByName(part.select(key, "pos", "members", "levels", F.col("path").alias("upper"), "top"))
        power = lambda e: F.pow(F.lit(float(arity)), e.cast("double")).cast("long")

        def ancestors(j):
            return F.transform("levels", lambda pres, v: F.struct(F.get(pres, F.floor(j / power(v + 1)).cast("int")).alias("pre"), (F.floor(j / power(v)) % arity).cast("int").alias("slot")))

        with_path = F.transform("members", lambda m, j: F.struct(m["pos"].alias("pos"), m["hash"].alias("hash"), m["more"].alias("more"), F.concat(ancestors(j).cast(_PATH), F.col("upper")).alias("path")))
        found = whole.select(key, "top", F.explode(with_path).alias("m")).select(key, "m.*", "top")
        if tier is tiers[0]:
            return found
        above = written(spark, found.select(key, "pos", "path", "top"), "merkle-paths")


def siblings(path: Column) -> Column:
    """The other digests of each ancestor's run, bottom up, left to right, as one text."""
    return F.array_join(F.transform(path, lambda a: F.concat(F.substr(a["pre"], F.lit(1), a["slot"] * DIGEST), F.substr(a["pre"], (a["slot"] + 1) * DIGEST + 1))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The top digest that ``leaf`` gives in its place."""
    return F.aggregate(path, leaf, lambda h, a: F.sha2(F.concat(F.substr(a["pre"], F.lit(1), a["slot"] * DIGEST), h, F.substr(a["pre"], (a["slot"] + 1) * DIGEST + 1)), 256))


def manifest(spark: SparkSession, docs: DataFrame, tampered: Column, arity: int = 2, depth: int = 8) -> DataFrame:
    """Leaves, proofs and roots of ``documents``, and what a check against a changed copy gives.

    ``tampered`` says (null: no) whose copy has n_chars one higher. Each row is
    a leaf. Within a lang, leaves ascend by doc_id (null first; equal ones by
    digest, so equal rows are interchangeable). Null values and empty texts are told
    apart by their canonical form; very long texts are hashed where they are
    read and never shuffled. An empty table gives no rows. Other columns of
    ``docs`` are not looked at.

    Returns doc_id, leaf, subroot, root, proof (the siblings' digests),
    proof_sha256, folded_root, verified.
    """
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    key = F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), F.col("lang")))  # "-" sorts before ":"
    rows = docs.select("doc_id", key.alias("key"), leaf_of(*values).alias("hash"), F.when(tampered & F.col("n_chars").isNotNull(), leaf_of(*changed)).alias("copy"))
    leaves = numbered(spark, written(spark, rows, "merkle-leaves"), "key", "doc_id", "hash")
    low = paths(spark, leaves.select("key", "pos", "n", "hash", F.struct("doc_id", "copy").alias("more")), "key", arity, depth)
    low = written(spark, low, "merkle-proofs")
    tops = low.groupBy("key").agg(F.first("top").alias("hash")).withColumn("all", F.lit("all"))
    tops = numbered(spark, written(spark, tops, "merkle-subroots"), "all", "key")
    high = paths(spark, tops.select("all", "pos", "n", "hash", F.col("key").alias("more")), "all", arity, depth)
    high = high.select(F.col("more").alias("key"), F.col("path").alias("upper"), F.col("top").alias("root"))
    found = low.join(high, "key").select("more.doc_id", F.col("hash").alias("leaf"), F.coalesce("more.copy", "hash").alias("copy"), F.concat("path", "upper").alias("path"), F.col("top").alias("subroot"), "root")
    found = found.select("doc_id", "leaf", "subroot", "root", siblings(F.col("path")).alias("proof"), folded(F.col("copy"), F.col("path")).alias("folded_root"))
    return found.select("doc_id", "leaf", "subroot", "root", "proof", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Every node of every tree, then each leaf's siblings and its fold level by level. DuckDB has no crc32: it is worked out byte by byte.
ORACLE = """
WITH RECURSIVE poly AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
d AS (SELECT *, CASE WHEN lang IS NULL THEN '-' ELSE ':' || lang END AS k,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS crc
  FROM documents, poly),
e AS (SELECT doc_id, k, n_chars, crc,
  coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail FROM d),
f AS (SELECT doc_id, k, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS h,
  CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN sha256(head || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS copy FROM e),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM f),
tree AS (
  SELECT k, 0 AS lvl, pos, h, count(*) OVER (PARTITION BY k) AS n FROM l
  UNION ALL
  SELECT k, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY k, lvl, pos // 2),
subroots AS (SELECT k, h, lvl AS height, row_number() OVER (ORDER BY encode(k)) - 1 AS pos FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, pos // 2),
steps AS (
  SELECT l.k, l.pos, t.lvl, (l.pos >> t.lvl) % 2 AS slot, s.h AS sibling
  FROM l JOIN (SELECT DISTINCT k, lvl FROM tree WHERE n > 1) t ON t.k = l.k
  LEFT JOIN tree s ON s.k = l.k AND s.lvl = t.lvl AND s.pos = xor(l.pos >> t.lvl, 1)
  UNION ALL
  SELECT l.k, l.pos, r.height + t.lvl, (r.pos >> t.lvl) % 2, s.h
  FROM l JOIN subroots r ON r.k = l.k CROSS JOIN (SELECT DISTINCT lvl FROM top WHERE n > 1) t
  LEFT JOIN top s ON s.lvl = t.lvl AND s.pos = xor(r.pos >> t.lvl, 1)),
proofs AS (SELECT l.k, l.pos, sha256(coalesce(string_agg(sibling, '' ORDER BY lvl), '')) AS proof FROM l LEFT JOIN steps USING (k, pos) GROUP BY l.k, l.pos),
fold AS (
  SELECT k, pos, 0 AS lvl, coalesce(copy, h) AS h FROM l
  UNION ALL
  SELECT k, pos, lvl + 1, sha256(CASE WHEN slot = 1 THEN coalesce(sibling, '') || h ELSE h || coalesce(sibling, '') END) FROM fold JOIN steps USING (k, pos, lvl)),
ends AS (SELECT k, pos, arg_max(h, lvl) AS folded_root FROM fold GROUP BY k, pos)
SELECT l.doc_id, l.h AS leaf, r.h AS subroot, x.h AS root, p.proof AS proof_sha256, e.folded_root, e.folded_root = x.h AS verified
FROM l JOIN subroots r ON r.k = l.k JOIN proofs p ON p.k = l.k AND p.pos = l.pos JOIN ends e ON e.k = l.k AND e.pos = l.pos CROSS JOIN (SELECT h FROM top WHERE n = 1) x"""
