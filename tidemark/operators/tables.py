"""Exact table operations on DataFrames of decimals, with a row number for order."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

ROW_CAP, GROUP_CAP = 200, 200
_COMPARE = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


class TableError(ValueError):
    """A request that the table can't answer."""


def label(text: Column) -> Column:
    """A label as it is compared: no-break spaces as spaces, runs of space made one, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"[\s\u00a0]+", " ")))


def _flat(text: str) -> str:
    return " ".join(text.replace("\u00a0", " ").split()).lower()


def resolve(df: DataFrame, wanted: list[str | int], index: str = "row") -> list[str]:
    """Column names of references: 0-based places or labels; repeats collapse, an unclear label is an error."""
    names, found = [c for c in df.columns if c != index], []
    for ref in wanted:
        if isinstance(ref, int):
            if not 0 <= ref < len(names):
                raise TableError(f"no column {ref}")
            found.append(names[ref])
            continue
        same = [n for n in names if _flat(n) == _flat(ref)]
        if len(same) != 1:
            raise TableError(f"{'no' if not same else 'several'} columns {ref!r}")
        found.append(same[0])
    return list(dict.fromkeys(found))


def select(df: DataFrame, columns: list[str | int] | None = None, rows: list[int | str] | None = None, index: str = "row", labels: str | None = None) -> DataFrame:
    """Columns (none: all) and rows by index or by the label in column ``labels``, in the order asked for, repeats kept."""
    names = resolve(df, columns, index) if columns else [c for c in df.columns if c != index]
    if rows is None:
        return df.select(index, *names)
    asked = [(i, r if isinstance(r, int) else None, _flat(r) if isinstance(r, str) else None) for i, r in enumerate(rows)]
    if labels is None and any(x[2] is not None for x in asked):
        raise TableError("the table has no row labels")
    wanted = df.sparkSession.createDataFrame(asked, "request long, _at long, _label string")
    match = F.col(index) == F.col("_at")
    if labels is not None:
        match = match | (label(F.col(labels)) == F.col("_label"))
    return df.join(F.broadcast(wanted), match).select("request", index, *names)  # the request is a short list


def capped(df: DataFrame, order: list, most: int = ROW_CAP) -> tuple[DataFrame, bool]:
    """The first rows, and whether there were more."""
    return df.orderBy(*order).limit(most), df.limit(most + 1).count() > most


def filter_number(df: DataFrame, column: str, operator: str, value: Decimal) -> DataFrame:
    """Comparison over decimals; missing values never pass, not for ne either."""
    if operator not in _COMPARE:
        raise TableError(f"{operator} is not for numbers")
    return df.where(_COMPARE[operator](F.col(column), F.lit(value)))


def filter_text(df: DataFrame, column: Column, operator: str, value: str) -> DataFrame:
    """eq, ne and contains on normalised text; a missing cell is an empty text."""
    text, value = label(F.coalesce(column, F.lit(""))), _flat(value)
    if operator == "contains":
        return df.where(F.contains(text, F.lit(value)))
    if operator not in ("eq", "ne"):
        raise TableError(f"{operator} is not for text")
    return df.where(_COMPARE[operator](text, F.lit(value)))


def sort(df: DataFrame, column: str, descending: bool = False, limit: int = 50, index: str = "row", text: bool = False) -> DataFrame:
    """Numbers: missing last either way, ties in row order. Text: descending turns ties round as well."""
    c = F.col(column)
    if text:
        c = label(F.coalesce(c, F.lit("")))
        order = [c.desc(), F.desc(index)] if descending else [c.asc(), F.asc(index)]
    else:
        order = [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.asc(index)]
    return df.orderBy(*order).limit(min(limit, ROW_CAP))


def aggregate(df: DataFrame, column: str, functions: list[str], group_by: str | None = None, index: str = "row") -> DataFrame:
    """sum, avg, min, max of decimals by the stripped text of a group, in order of first appearance; an empty group is null."""
    known = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    if bad := [f for f in functions if f not in known]:
        raise TableError(f"no function {bad}")
    aggs = [known[f](column).alias(f) for f in dict.fromkeys(functions)]
    if group_by is None:
        return df.agg(*aggs)
    found = df.groupBy(F.nullif(F.trim(group_by), F.lit("")).alias(group_by)).agg(*aggs, F.min(index).alias("first_row"))
    if found.limit(GROUP_CAP + 1).count() > GROUP_CAP:
        raise TableError("too many groups")
    return found.orderBy("first_row")


def growth(df: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """Period over period: delta, and relative percent with 4 decimals, half up; null where the base is 0 or missing."""
    v = F.col(value).cast("decimal(18,6)")
    base = F.lag(v).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("base", base).withColumn("delta", v - base).withColumn("relative", F.round(F.try_divide(v - base, base) * 100, 4))


def growth_across(df: DataFrame, base: str, target: str, percent: bool = False) -> DataFrame:
    """From one column to another of the same kind in each row: delta (percentage points if ``percent``), relative with 4 decimals, half up; null where the base is 0 or missing."""
    x, y = F.col(base).cast("decimal(18,6)"), F.col(target).cast("decimal(18,6)")
    return df.withColumn("delta", y - x).withColumn("relative", F.round(F.try_divide(y - x, x) * 100, 4)).withColumn("unit", F.lit("percentage points" if percent else None).cast("string"))


def compare(a: DataFrame, b: DataFrame, key: str, value: str, index: str = "row") -> DataFrame:
    """Equi-join of two tables on a key; rows without a number do not count; a key twice is an error; relative is null for B = 0."""
    sides = []
    for name, df in (("a", a), ("b", b)):
        own = df.where(F.col(value).isNotNull())
        if own.groupBy(key).count().where("count > 1").limit(1).count():
            raise TableError(f"a key occurs twice in table {name}")
        sides.append(own.select(key, F.col(value).cast("decimal(18,6)").alias(name), *([F.col(index)] if name == "a" else [])))
    joined = sides[0].join(sides[1], key)
    return joined.select(index, key, "a", "b", (F.col("a") - F.col("b")).alias("difference"), F.round(F.try_divide(F.col("a") - F.col("b"), F.col("b")) * 100, 4).alias("relative"))
