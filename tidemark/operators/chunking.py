"""Blocks to sections and chunks.

Blocks: document_id, at (reading order), page, type (title, text, formula,
table, image), text. Sections are a window. Chunks are one pass over blocks
that Spark has sorted by document and place, with one section at a time in
memory, so a document is neither a group nor a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.evaluation import spread

# Sizes in characters, what stands between blocks, and the marks after which a text may be cut.
TARGET, MOST, LEAST = 1200, 1600, 240
BETWEEN = "\n\n"
MARKS = "。！？!?；;：:\n"
CHUNK_SCHEMA = "document_id long, ordinal int, section int, path array<string>, text string, n_chars int, blocks array<int>, types array<string>, first_page int, last_page int"


def sectionize(blocks: DataFrame) -> DataFrame:
    """Adds section: a run of blocks that starts at a run of titles. blocks: document_id, at, type."""
    w = Window.partitionBy("document_id").orderBy("at")
    title = (F.col("type") == "title").cast("int")
    starts = (title == 1) & (F.coalesce(F.lag(title).over(w), F.lit(0)) == 0)
    return blocks.withColumn("section", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def rendered(kind: Column, text: Column) -> Column:
    """What a chunk has of a block: titles and formulas marked, null as nothing."""
    own = F.coalesce(text, F.lit(""))
    return F.when(kind == "title", F.concat(F.lit("## "), own)).when(kind == "formula", F.concat(F.lit("$$\n"), own, F.lit("\n$$"))).otherwise(own)


def split_text(text: str, most: int = MOST) -> Iterator[str]:
    """Pieces of at most ``most`` characters that together are the text: cut after the last mark, else after the last space, else hard."""
    at = 0
    while len(text) - at > most:
        head = text[at : at + most]
        cut = max(head.rfind(m) for m in MARKS) + 1 or next((k for k in range(len(head), 0, -1) if head[k - 1].isspace()), most)
        yield head[:cut]
        at += cut
    if at < len(text):
        yield text[at:]


@dataclass(frozen=True)
class Block:
    at: int
    page: int
    type: str
    text: str


def joined(*texts: str) -> str:
    return BETWEEN.join(t for t in texts if t)


@dataclass
class Chunk:
    blocks: list[Block]
    text: str
    whole: bool = True  # its text is that of its blocks, none of them cut

    @classmethod
    def of(cls, blocks: list[Block]) -> Chunk:
        return cls(list(blocks), joined(*(b.text for b in blocks)))

    def __add__(self, other: Chunk) -> Chunk:
        return Chunk(self.blocks + other.blocks, joined(self.text, other.text), self.whole and other.whole)


@dataclass
class Packer:
    """Packs a section's blocks; ``open`` are those of the chunk at hand, ``size`` its length."""

    target: int
    most: int
    out: list[Chunk] = field(default_factory=list)
    open: list[Block] = field(default_factory=list)
    size: int = 0

    def close(self) -> None:
        if self.open:
            self.out.append(Chunk.of(self.open))
        self.open, self.size = [], 0

    def cut(self, block: Block, before: list[Block]) -> None:
        """A block too long for the chunk at hand, alone or after its titles; texts are cut, others stay whole."""
        head = joined(*(b.text for b in before))
        if block.type != "text":
            self.out.append(Chunk.of([*before, block]))
        else:
            room = max(1, self.most - len(head) - len(BETWEEN)) if before else self.most
            for nth, piece in enumerate(split_text(block.text, room)):
                self.out.append(Chunk([block], piece, False) if nth else Chunk([*before, block], joined(head, piece), False))
        self.open, self.size = [], 0

    def add(self, block: Block) -> None:
        grown = self.size + len(BETWEEN) + len(block.text) if self.open else len(block.text)
        if self.open and grown > self.most and all(b.type == "title" for b in self.open):
            self.cut(block, self.open)
        elif len(block.text) > self.most:
            self.close()
            self.cut(block, [])
        else:
            if self.open and (self.size >= self.target or grown > self.most):
                self.close()
                grown = len(block.text)
            self.open.append(block)
            self.size = grown


def with_context(chunks: list[Chunk], most: int) -> list[Chunk]:
    """A chunk of formulas alone joins the chunk before it, or takes that one's last block if only this fits."""
    done: list[Chunk] = []
    for chunk in chunks:
        todo = [chunk]
        while todo:
            c = todo.pop()
            if done and len(c.text) <= most and all(b.type == "formula" for b in c.blocks):
                before = done[-1]
                taken = Chunk.of([before.blocks[-1], *c.blocks])
                if len((before + c).text) <= most:
                    todo.append(done.pop() + c)
                    continue
                if before.whole and len(taken.text) <= most:
                    done.pop()
                    todo += [taken, Chunk.of(before.blocks[:-1])][: len(before.blocks)]
                    continue
            done.append(c)
    return done


def chunk_section(blocks: list[Block], target: int = TARGET, most: int = MOST, least: int = LEAST) -> list[Chunk]:
    """A section's chunks: packed to the target, formulas with context, a short tail joined to the chunk before it."""
    packer = Packer(target, most)
    for b in blocks:
        packer.add(b)
    packer.close()
    chunks = with_context(packer.out, most)
    if len(chunks) > 1 and len(chunks[-1].text) < least:
        *rest, before, last = chunks
        if not {b.at for b in before.blocks} & {b.at for b in last.blocks} and len((before + last).text) <= most:
            return [*rest, before + last]
    return chunks


def _rows(document: int, ordinal: int, section: int, path: list[str], c: Chunk) -> dict:
    pages = [b.page for b in c.blocks]
    return {"document_id": document, "ordinal": ordinal, "section": section, "path": path, "text": c.text, "n_chars": len(c.text), "blocks": [b.at for b in c.blocks], "types": list(dict.fromkeys(b.type for b in c.blocks)), "first_page": min(pages), "last_page": max(pages)}


def _fold(limits: tuple[int, int, int], schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of document and place; a section is packed when its last block is seen."""
    key, blocks, path, ordinal, out = None, [], [], 0, []

    def close():
        nonlocal ordinal
        for c in chunk_section(blocks, *limits):
            out.append(_rows(*key[:1], ordinal, key[1], path, c))
            ordinal += 1

    for batch in batches:
        for document, section, at, page, kind, title, text in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (document, section):
                if blocks:
                    close()
                if key is None or key[0] != document:
                    ordinal = 0
                key, blocks, path = (document, section), [], []
            if kind == "title":
                path = [*path, title]
            blocks.append(Block(at, page, kind, text))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
    if blocks:
        close()
        yield pa.RecordBatch.from_pylist(out, schema)


def chunk(blocks: DataFrame, target: int = TARGET, most: int = MOST, least: int = LEAST) -> DataFrame:
    """Chunks of every document (see CHUNK_SCHEMA); ``path`` are the titles that a section starts with, sections count from 0.

    A block without a page is on page 1; one of null text is empty. Documents without blocks have no chunks.
    """
    page = F.col("page") if "page" in blocks.columns else F.lit(1)
    first = F.min("section").over(Window.partitionBy("document_id"))
    told = sectionize(blocks).withColumn("section", (F.col("section") - first).cast("int"))
    rows = told.select("document_id", "section", F.col("at").cast("int").alias("at"), F.coalesce(page, F.lit(1)).cast("int").alias("page"), "type", F.coalesce("text", F.lit("")).alias("title"), rendered(F.col("type"), F.col("text")).alias("text"))
    ordered = rows.repartition("document_id").sortWithinPartitions("document_id", "at")
    ints, texts = pa.list_(pa.int32()), pa.list_(pa.string())
    kinds = {"document_id": pa.int64(), "path": texts, "text": pa.string(), "blocks": ints, "types": texts}
    schema = pa.schema([(name, kinds.get(name, pa.int32())) for name in ("document_id", "ordinal", "section", "path", "text", "n_chars", "blocks", "types", "first_page", "last_page")])
    return ordered.mapInArrow(partial(_fold, (target, most, least), schema), CHUNK_SCHEMA)


def uncovered(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Blocks with text that no chunk has."""
    covered = chunks.select("document_id", F.explode("blocks").alias("at"))
    return blocks.where(F.trim("text") != "").join(covered, ["document_id", "at"], "left_anti")


def lineage(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, ordinal, problem) of chunks that do not fit the blocks they name, the first of absent_block, order, pages, section, types; and uncovered (ordinal null) for each block that none names.

    blocks have a page; each chunk's blocks are joined on their own, so a long document is no group.
    """
    first = F.min("section").over(Window.partitionBy("document_id"))
    known = sectionize(blocks).select("document_id", F.col("at").cast("int").alias("at"), F.col("page").alias("own_page"), F.col("type").alias("own_type"), (F.col("section") - first).cast("int").alias("own_section"))
    named = chunks.select("document_id", "ordinal", "section", "first_page", "last_page", "types", "blocks", F.posexplode("blocks").alias("nth", "at")).join(known, ["document_id", "at"], "left")
    per = named.groupBy("document_id", "ordinal").agg(
        F.first("section").alias("section"), F.first("first_page").alias("first_page"), F.first("last_page").alias("last_page"), F.first("types").alias("types"), F.first("blocks").alias("blocks"),
        F.count_if(F.col("own_page").isNull()).alias("absent"), F.min("own_page").alias("low"), F.max("own_page").alias("high"), F.min("own_section").alias("s0"), F.max("own_section").alias("s1"),
        F.array_sort(F.collect_list(F.struct("nth", "own_type"))).alias("own"))
    order = F.forall(F.sequence(F.lit(1), F.greatest(F.size("blocks") - 1, F.lit(1))), lambda k: F.get("blocks", k).isNull() | (F.get("blocks", k) > F.get("blocks", k - 1)))
    kinds = F.array_distinct(F.transform("own", lambda o: o["own_type"]))
    problem = (
        F.when(F.col("absent") > 0, "absent_block").when(~order, "order").when((F.col("low") != F.col("first_page")) | (F.col("high") != F.col("last_page")), "pages")
        .when((F.col("s0") != F.col("s1")) | (F.col("s0") != F.col("section")), "section").when(kinds != F.col("types"), "types"))
    bad = per.select("document_id", "ordinal", problem.alias("problem")).where("problem IS NOT NULL")
    missed = known.join(named.select("document_id", "at").distinct(), ["document_id", "at"], "left_anti")
    return bad.unionByName(missed.select("document_id", F.lit(None).cast("int").alias("ordinal"), F.lit("uncovered").alias("problem")))


def summary(blocks: DataFrame, chunks: DataFrame, target: int = TARGET, most: int = MOST) -> DataFrame:
    """One row: how much of the blocks the chunks have, how large they are, and what they hold. blocks have a page."""
    first = F.min("section").over(Window.partitionBy("document_id"))
    known = sectionize(blocks).select("document_id", F.col("at").cast("int").alias("at"), "page", "type", F.char_length(rendered(F.col("type"), F.col("text"))).alias("n"), (F.col("section") - first).cast("int").alias("section"))
    uses = chunks.select("document_id", F.explode("blocks").alias("at")).groupBy("document_id", "at").agg(F.count("*").alias("uses"))
    told = known.join(uses, ["document_id", "at"], "left")
    atomic = F.col("type").isin("table", "formula", "image")
    share = lambda a, b: F.round(F.try_divide(a, b), 6)
    of_blocks = told.agg(
        F.count_distinct("document_id").alias("documents"), F.count_distinct("document_id", "page").alias("pages"), F.count("*").alias("source_blocks"), F.count("uses").alias("referenced_blocks"), F.count_if(F.col("uses").isNull()).alias("unreferenced_blocks"), F.count_if(F.col("uses") > 1).alias("multiply_referenced"),
        share(F.count("uses"), F.count("*")).alias("coverage_rate"), F.count_distinct("document_id", "section").alias("sections"), F.count_if((F.col("type") == "text") & (F.col("n") > most)).alias("oversized_text_blocks"), F.count_if((F.col("type") != "text") & (F.col("n") > most)).alias("oversized_other_blocks"),
        share(F.count_if(F.col("type").isin("table", "image") & F.col("uses").isNotNull()), F.count_if(F.col("type").isin("table", "image"))).alias("asset_coverage_rate"))
    pages = chunks.select("document_id", "ordinal", "section", "n_chars", "types", F.size(F.array_distinct("blocks")).alias("n_blocks"), F.explode(F.array_distinct("blocks")).alias("at")).join(known.select("document_id", "at", "page", "type", "n"), ["document_id", "at"])
    per = pages.groupBy("document_id", "ordinal").agg(
        F.first("section").alias("section"), F.first("n_chars").alias("n_chars"), F.first("types").alias("types"), F.first("n_blocks").alias("n_blocks"), F.count_distinct("page").alias("n_pages"),
        F.count_if(atomic).alias("atomic"), F.max(F.when(atomic, F.col("type"))).alias("atom"), F.max(F.when(atomic, F.col("n"))).alias("atom_chars"))
    per = per.withColumn("before", F.lag("section").over(Window.partitionBy("document_id").orderBy("ordinal"))).withColumn("of_section", F.count("*").over(Window.partitionBy("document_id", "section")))
    single = (F.col("n_blocks") == 1) & (F.col("atomic") == 1)
    over = (F.col("atomic") == 1) & ~F.array_contains("types", "text") & (F.col("atom_chars") > most)
    of_kind = lambda name, what: [F.count_if(what).alias(name), *[F.count_if(what & (F.col("atom") == k)).alias(f"{name}_{k}") for k in ("table", "formula", "image")]]
    of_chunks = per.agg(
        F.count("*").alias("chunks"), *spread("n_chars", "chars"), *spread("n_pages", "pages"), *spread("n_blocks", "blocks"),
        F.count_if(F.col("before") != F.col("section")).alias("section_boundary_splits"), F.count_distinct(F.when(F.col("of_section") > 1, F.struct("document_id", "section"))).alias("sections_split"), F.count_if(F.col("n_chars") > most).alias("over_most"),
        *of_kind("single", single), *of_kind("oversized_atomic", over), *[F.count_if(F.array_contains("types", k)).alias(f"with_{k}") for k in ("table", "formula", "image")])
    return of_blocks.crossJoin(of_chunks)  # one row each
