"""Whether two statements mean the same: by Spark's optimised plans, by keys and by results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def closure(keys: set[str], dependencies: list[tuple[set[str], set[str]]]) -> set[str]:
    """All columns that ``keys`` determine by (determinant, dependent) pairs."""
    known, grew = set(keys), True
    while grew:
        grew = False
        for left, right in dependencies:
            if left <= known and not right <= known:
                known |= right
                grew = True
    return known


def same_grouping(a: set[str], b: set[str], dependencies: list[tuple[set[str], set[str]]]) -> bool:
    """Whether two sets of GROUP BY columns make the same groups."""
    return b <= closure(a, dependencies) and a <= closure(b, dependencies)


def join_is_redundant(foreign: tuple[str, str, str, str], foreign_keys: set[tuple[str, str, str, str]], not_null: set[tuple[str, str]], used: set[str]) -> bool:
    """Whether an inner join (table, column, parent, key) can go: a foreign key that is never null, to a parent of which nothing but the key is used."""
    table, column, parent, key = foreign
    return foreign in foreign_keys and (table, column) in not_null and used <= {f"{parent}.{key}"}


def compare_plans(spark: SparkSession, a: str, b: str) -> str:
    """``equal`` if the optimised plans give the same result, ``different`` if their columns' types differ in number or kind, else ``unknown``."""
    x, y = spark.sql(a), spark.sql(b)
    if [f.dataType for f in x.schema] != [f.dataType for f in y.schema]:
        return "different"
    plan = lambda df: df._jdf.queryExecution().optimizedPlan()
    return "equal" if plan(x).sameResult(plan(y)) else "unknown"


def leaf_columns(spark: SparkSession, sql: str) -> list[int]:
    """The number of columns of every SELECT that a statement's set operations put together."""
    found: list[int] = []

    def walk(node) -> None:
        if node.getClass().getSimpleName() in ("Union", "Intersect", "Except"):
            for i in range(node.children().size()):
                walk(node.children().apply(i))
        elif node.getClass().getSimpleName() in ("Distinct", "GlobalLimit", "LocalLimit", "Sort") and _is_set(node):
            walk(node.children().apply(0))
        else:
            found.append(node.output().size())

    walk(spark.sql(sql)._jdf.queryExecution().analyzed())
    return found


def _is_set(node) -> bool:
    child = node.children().apply(0)
    return child.getClass().getSimpleName() in ("Union", "Intersect", "Except", "Distinct", "GlobalLimit", "LocalLimit", "Sort")


def same_results(a: DataFrame, b: DataFrame, order: list[str] | None = None, relative: float = 1e-9, absolute: float = 1e-6) -> DataFrame:
    """One row: equal, rows_a, rows_b, differing. Columns by position; numbers within max(absolute, relative x scale).

    With ``order`` (columns of a) rows are paired place by place in it, else as
    bags: by the exact columns, then by rank of the numbers in them.
    """
    from pyspark.sql import Window

    b = b.toDF(*a.columns)
    numeric = [f.name for f in a.schema if f.dataType.simpleString() in ("double", "float") or f.dataType.simpleString().startswith("decimal")]
    exact = [c for c in a.columns if c not in numeric]
    if order:  # the whole result has one order; it is a bounded result set
        place = lambda df: df.withColumn("_at", F.row_number().over(Window.orderBy(*order)))
        keys = ["_at"]
    else:
        place = lambda df: df.withColumn("_at", F.row_number().over(Window.partitionBy(*exact).orderBy(*(numeric or exact or [F.lit(1)]))))
        keys = [*exact, "_at"]
    left = place(a).select(*[F.col(c).alias(f"a_{c}") for c in [*a.columns, "_at"]])
    right = place(b).select(*[F.col(c).alias(f"b_{c}") for c in [*a.columns, "_at"]])
    cond = [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys]
    both = left.join(right, cond, "full_outer")
    ok = F.col("a__at").isNotNull() & F.col("b__at").isNotNull()
    for c in a.columns:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        if c in numeric:
            x, y = x.cast("double"), y.cast("double")
            near = F.abs(x - y) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(x), F.abs(y)))
            ok = ok & F.coalesce(near, x.isNull() & y.isNull())
        else:
            ok = ok & x.eqNullSafe(y)
    return both.agg((F.count_if(~ok) == 0).alias("equal"), F.count("a__at").alias("rows_a"), F.count("b__at").alias("rows_b"), F.count_if(~ok).alias("differing"))


def infer_chart(columns: list[str], rows: list[list], most: int = 24) -> dict | None:
    """The chart for a small result: first text column against first number column; null if there is none, too many rows, or labels repeat."""
    import re

    if not rows or len(rows) > most:
        return None
    number = lambda i: all(isinstance(r[i], (int, float)) and not isinstance(r[i], bool) for r in rows)
    label = next((i for i in range(len(columns)) if not number(i)), None)
    value = next((i for i in range((label or 0) + 1, len(columns)) if number(i)), None) if label is not None else None
    if label is None or value is None or len({r[label] for r in rows}) < len(rows):
        return None
    timely = all(re.fullmatch(r"\d{4}(?:[-/年]\d{1,2}.*|年?)", str(r[label])) for r in rows)
    kind = "line" if timely else "pie" if len(rows) <= 6 and all(r[value] >= 0 for r in rows) else "bar"
    return {"kind": kind, "label": columns[label], "value": columns[value]}
