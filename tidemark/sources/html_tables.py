"""Tables inside HTML and Markdown as cells (row, col, text, derived)."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from tidemark.functions.text import header_unit, header_year, is_missing, is_percent, number

CELLS = ArrayType(StructType([StructField("row", IntegerType()), StructField("col", IntegerType()), StructField("text", StringType()), StructField("derived", BooleanType())]))


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.done, self.muted = 0, False, 0
        self.rows: list[list[list]] = []
        self.cell: list | None = None

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "table":
            self.depth += 1
        elif tag in ("script", "style"):
            self.muted += 1
        elif self.depth == 1 and tag == "tr":
            self.cell = None
            self.rows.append([])
        elif self.depth == 1 and tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            found = dict(attrs)
            span = [min(max(int(v), 1), 100) if (v := found.get(k) or "").isdigit() else 1 for k in ("rowspan", "colspan")]
            self.cell = ["", *span]
            self.rows[-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
            self.done = self.done or self.depth == 0
        elif tag in ("script", "style"):
            self.muted = max(self.muted - 1, 0)
        elif self.depth == 1 and tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None and not self.muted and not self.done:
            self.cell[0] += data


def html_cells(html: str | None) -> list[dict]:
    """Cells of the first top-level table; copies made by spans are derived. Empty if there is no table."""
    parser = _Tables()
    parser.feed(html or "")
    taken: dict[tuple[int, int], tuple[str, bool]] = {}
    for r, row in enumerate(parser.rows):
        c = 0
        for text, down, across in row:
            while (r, c) in taken:
                c += 1
            for i in range(down):
                for j in range(across):
                    taken.setdefault((r + i, c + j), (" ".join(text.split()), bool(i or j)))
            c += across
    return [{"row": r, "col": c, "text": t, "derived": d} for (r, c), (t, d) in sorted(taken.items())]


def markdown_cells(text: str | None) -> list[dict]:
    """Cells of the first pipe table: its header stands in the first 20 lines; it ends at a line without a pipe."""
    lines = (text or "").splitlines()
    for at in range(min(len(lines) - 1, 20)):
        rule = lines[at + 1].strip().strip("|")
        if "|" in lines[at] and rule and set(rule) <= set("-:| ") and "-" in rule:
            body = []
            for line in [lines[at], *lines[at + 2 :]]:
                if "|" not in line:
                    break
                body.append([c.strip() for c in line.strip().strip("|").split("|")])
            return [{"row": r, "col": c, "text": t, "derived": False} for r, row in enumerate(body) for c, t in enumerate(row)]
    return []


@F.pandas_udf(CELLS)
def _html(html: pd.Series) -> pd.Series:
    return html.map(html_cells)


@F.pandas_udf(CELLS)
def _markdown(text: pd.Series) -> pd.Series:
    return text.map(markdown_cells)


def cells(df: DataFrame, key: str, column: str, markdown: bool = False) -> DataFrame:
    """key, row, col, text, derived, value (decimal or null), percent."""
    found: Column = (_markdown if markdown else _html)(F.col(column))
    flat = df.select(key, F.explode(found).alias("c")).select(key, "c.row", "c.col", "c.text", "c.derived")
    return flat.withColumn("value", number(F.col("text"))).withColumn("percent", is_percent(F.col("text")))


def columns(table_cells: DataFrame, key: str) -> DataFrame:
    """key, col, header, unit, year, data_start, kind of every column.

    Data start at the first row with enough numbers: at least one and two
    fifths of its width, rounded up as (2 w + 4) // 5; years and copies of
    spans do not count. The header is made of the distinct texts above (the
    first row itself if it has numbers already). A table without such a row
    has no columns. Kinds: text (no number), mixed (numbers and text, or
    numbers and percents), percent, number; missing cells count for none.
    """
    year = F.col("text").rlike(r"^\s*(?:19|20)\d{2}\s*年?\s*$")
    scored = table_cells.groupBy(key, "row").agg(F.count("*").alias("w"), F.count_if(~F.col("derived") & F.col("value").isNotNull() & ~(year & ~F.col("percent"))).alias("s"))
    start = scored.where(F.col("s") >= F.greatest(F.lit(1), F.floor((2 * F.col("w") + 4) / 5))).groupBy(key).agg(F.min("row").alias("data_start"))
    told = table_cells.join(start, key)
    head, body = F.col("row") < F.greatest(F.col("data_start"), F.lit(1)), F.col("row") >= F.col("data_start")
    known = body & F.col("value").isNotNull()
    found = told.groupBy(key, "col").agg(
        F.first("data_start").alias("data_start"), F.array_sort(F.collect_list(F.when(head & (F.trim("text") != ""), F.struct("row", "text")))).alias("h"),
        F.count_if(known & ~F.col("percent")).alias("n"), F.count_if(known & F.col("percent")).alias("p"), F.count_if(body & F.col("value").isNull() & ~is_missing(F.col("text"))).alias("t"),
    )
    header = F.array_join(F.array_distinct(F.transform("h", lambda x: x["text"])), " ")
    kind = F.when(F.col("n") + F.col("p") == 0, "text").when((F.col("t") > 0) | ((F.col("n") > 0) & (F.col("p") > 0)), "mixed").when(F.col("p") > 0, "percent").otherwise("number")
    return found.select(key, "col", header.alias("header"), header_unit(header).alias("unit"), header_year(header).alias("year"), "data_start", kind.alias("kind"))
