"""Scans of a document store: parser output, manifests, chunk files, catalogs, registration, vectors, model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Kinds of parser items that hold page furniture, and the scale of their boxes.
AUXILIARY = ("discarded", "footer", "header", "page_footnote", "page_number")
BOX_SCALE, BOX_TOLERANCE = 1000.0, 5.0
ITEM = "struct<type:string,text:string,text_level:int,table_body:string,table_caption:array<string>,img_path:string,image_caption:array<string>,latex:string,page_idx:int,bbox:array<double>>"


def parser_blocks(output: DataFrame) -> DataFrame:
    """Parser output (document_id, items: a JSON array) to canonical blocks.

    document_id, block_id ``p{page}-b{n}``, page, reading_order, type, text,
    caption, asset, box (0 to 1, clamped), warning. Page furniture is left out;
    an item of unknown type, a text without text and a broken box give a row
    with a warning and no block id. Null or broken JSON gives no rows; repeated
    documents stay apart only by their rows. One document's items are one row.
    """
    items = output.select("document_id", F.posexplode(F.from_json("items", f"array<{ITEM}>")).alias("at", "i")).where(~F.coalesce(F.col("i.type"), F.lit("")).isin(*AUXILIARY))
    joined = lambda c: F.nullif(F.array_join(F.filter(F.transform(c, lambda p: F.trim(p)), lambda p: p != ""), "\n"), F.lit(""))
    kind = F.col("i.type")
    of_type = F.when((kind == "text") & (F.col("i.text_level") > 0), "title").when(kind == "text", "text").when(kind.isin("table", "image"), kind).when(kind == "equation", "formula")
    text = F.when(kind == "text", F.col("i.text")).when(kind == "table", F.col("i.table_body")).when(kind == "equation", F.coalesce("i.latex", "i.text"))
    caption = F.when(kind == "table", joined("i.table_caption")).when(kind == "image", joined("i.image_caption"))
    asset = F.when(kind.isin("table", "image") & ~F.coalesce(F.col("i.img_path"), F.lit("")).rlike(r"^/|(^|/)\.\.(/|$)"), F.nullif("i.img_path", F.lit("")))
    box = F.transform("i.bbox", lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(BOX_SCALE)) / BOX_SCALE)
    off = F.exists("i.bbox", lambda v: (v < -BOX_TOLERANCE) | (v > BOX_SCALE + BOX_TOLERANCE)) | (F.size("i.bbox") != 4)
    clamped = F.exists("i.bbox", lambda v: (v < 0) | (v > BOX_SCALE))
    empty = (F.col("type").isin("text", "title", "formula") & (F.trim(F.coalesce("text", F.lit(""))) == "")) | ((F.col("type") == "table") & F.col("text").isNull() & F.col("asset").isNull()) | ((F.col("type") == "image") & F.col("asset").isNull())
    warning = F.when(of_type.isNull(), "unsupported_type").when(F.coalesce(off, F.lit(False)), "invalid_box")
    told = items.select("document_id", "at", (F.coalesce(F.col("i.page_idx"), F.lit(0)) + 1).alias("page"), of_type.alias("type"), text.alias("text"), caption.alias("caption"), asset.alias("asset"), box.alias("box"), warning.alias("warning"), F.coalesce(clamped, F.lit(False)).alias("clamped"))
    told = told.withColumn("warning", F.coalesce("warning", F.when(empty, "no_content"), F.when(F.col("clamped"), "box_clamped")))
    kept = F.col("warning").isNull() | (F.col("warning") == "box_clamped")
    nth = F.count(F.when(kept, 1)).over(Window.partitionBy("document_id", "page").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return told.select("document_id", F.when(kept, F.concat(F.lit("p"), F.col("page"), F.lit("-b"), nth)).alias("block_id"), "page", F.when(kept, nth - 1).alias("reading_order"), F.when(kept, F.col("type")).alias("type"), "text", "caption", "asset", "box", "warning", "at")


def parser_stats(blocks: DataFrame) -> DataFrame:
    """document_id, blocks, titles, texts, tables, images, formulas, warnings."""
    n = lambda kind: F.count_if(F.coalesce(F.col("type") == kind, F.lit(False)))
    return blocks.groupBy("document_id").agg(F.count("block_id").alias("blocks"), n("title").alias("titles"), n("text").alias("texts"), n("table").alias("tables"), n("image").alias("images"), n("formula").alias("formulas"), F.count("warning").alias("warnings"))


def corpus(documents: DataFrame, manifest: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Documents that the manifest (``key``, position) names, in its order; ``limit`` takes the first."""
    found = documents.join(manifest.select(key, "position"), key)
    return found if limit is None else found.orderBy("position", key).limit(limit)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """A file or folder of JSON lines with an explicit schema; a broken line is an error, not a null."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def catalog(spark: SparkSession, tables: list[str]) -> DataFrame:
    """table_name, column_name, position, kind of the given temporary views."""
    rows = [(t, f.name, i + 1, f.dataType.simpleString()) for t in sorted(tables) for i, f in enumerate(spark.table(t).schema)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int, kind string")


def register(uploads: DataFrame, existing: DataFrame | None = None, most_bytes: int = 50 << 20) -> DataFrame:
    """Uploads (kb, document_id, content) with sha256, size and state.

    ``too_large``, ``empty``, ``conflict`` (the same content is in the knowledge
    base already, or came with a smaller document_id), else ``registered``.
    """
    content = F.coalesce("content", F.lit(""))
    told = uploads.select("kb", "document_id", F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("size"))
    fit = (F.col("size") > 0) & (F.col("size") <= most_bytes)
    first = told.where(fit).groupBy("kb", "sha256").agg(F.min("document_id").alias("first"))
    known = first.join(existing.select("kb", "sha256").distinct().withColumn("old", F.lit(True)), ["kb", "sha256"], "left") if existing is not None else first.withColumn("old", F.lit(None).cast("boolean"))
    known = known.select(F.col("kb").alias("_kb"), F.col("sha256").alias("_sha"), "first", "old")
    same = F.col("kb").eqNullSafe(F.col("_kb")) & (F.col("sha256") == F.col("_sha"))
    state = F.when(F.col("size") == 0, "empty").when(F.col("size") > most_bytes, "too_large").when(F.col("old") | (F.col("first") != F.col("document_id")), "conflict").otherwise("registered")
    return told.join(known, same, "left").select("kb", "document_id", "sha256", "size", state.alias("state"))


def scroll(points: DataFrame, key: str, page: int = 256) -> DataFrame:
    """Points with the page they stand on in order of key. Ranges are sorted each for itself; offsets come from their counts."""
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = points.repartitionByRange(n, key).withColumn("_part", F.spark_partition_id())
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return placed.join(F.broadcast(before), "_part").withColumn("page", F.floor((nth + F.col("_before")) / page)).drop("_part", "_n", "_before")


def model_json(answer: Column) -> Column:
    """The JSON object in a model's answer: fenced, or from the first brace to the last; null if there is none."""
    fenced = F.nullif(F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    return F.coalesce(fenced, F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit("")))


def parse_answer(df: DataFrame, answer: str, schema: str, required: list[str]) -> DataFrame:
    """Adds ``parsed`` and ``issue``: no_json, invalid_json, duplicate_key, missing_field, or null."""
    raw = model_json(F.col(answer))
    parsed = F.from_json(raw, f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    keys = F.regexp_extract_all(raw, F.lit(r'[{,]\s*"([^"\\]+)"\s*:'), F.lit(1))
    flat = ~F.regexp_replace(raw, r'^\{|\}$', "").rlike(r"[{\[]")  # names repeat rightly in nested objects
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(f"parsed.{name}").isNull()
    issue = F.when(F.col("_raw").isNull(), "no_json").when(F.col("parsed._broken").isNotNull(), "invalid_json").when(F.col("_repeats"), "duplicate_key").when(missing, "missing_field")
    told = df.withColumn("_raw", raw).withColumn("parsed", parsed).withColumn("_repeats", flat & (F.size(F.array_distinct(keys)) < F.size(keys)))
    return told.withColumn("issue", issue).drop("_raw", "_repeats")


def evidence(blocks: DataFrame) -> DataFrame:
    """One evidence for each block with its typed representations: evidence_id, document_id, block_id, modality, fingerprint, representations."""
    rep = lambda kind, content, searchable: F.struct(F.lit(kind).alias("kind"), content.alias("content"), F.lit(searchable).alias("searchable"))
    own = F.when(F.col("type").isin("text", "title"), F.array(rep("text", F.col("text"), True))).when(F.col("type") == "formula", F.array(rep("latex", F.col("text"), True)))
    own = own.when(F.col("type") == "table", F.array(rep("table", F.col("text"), True), rep("caption", F.col("caption"), True), rep("asset", F.col("asset"), False)))
    own = own.when(F.col("type") == "image", F.array(rep("caption", F.col("caption"), True), rep("asset", F.col("asset"), False)))
    reps = F.filter(own, lambda r: F.trim(F.coalesce(r["content"], F.lit(""))) != "")
    told = blocks.where(F.col("block_id").isNotNull())
    mark = F.sha2(F.concat_ws("|", F.col("document_id").cast("string"), "block_id", "type", F.coalesce("text", F.lit("")), F.coalesce("caption", F.lit(""))), 256)
    modality = F.when(F.col("type").isin("text", "title"), "text").otherwise(F.col("type"))
    return told.select(F.concat_ws(":", F.col("document_id").cast("string"), "block_id").alias("evidence_id"), "document_id", "block_id", modality.alias("modality"), mark.alias("fingerprint"), reps.alias("representations"))


def payload(found: DataFrame) -> DataFrame:
    """A row for each searchable representation: point_id, evidence_id, document_id, modality, kind, content."""
    flat = found.select("evidence_id", "document_id", "modality", F.explode("representations").alias("r")).where("r.searchable")
    return flat.select(F.concat_ws("#", "evidence_id", "r.kind").alias("point_id"), "evidence_id", "document_id", "modality", "r.kind", "r.content")


def stale(found: DataFrame, current: DataFrame) -> DataFrame:
    """evidence_id and state against a fresh build: valid, stale (another fingerprint), missing, unknown."""
    both = current.select("evidence_id", F.col("fingerprint").alias("_new")).join(found.select("evidence_id", F.col("fingerprint").alias("_old")), "evidence_id", "full_outer")
    return both.select("evidence_id", F.when(F.col("_old").isNull(), "missing").when(F.col("_new").isNull(), "unknown").when(F.col("_old") == F.col("_new"), "valid").otherwise("stale").alias("state"))
