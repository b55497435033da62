"""Which chart the rows of a small result can be drawn as."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Rows a chart may have, slices a pie may have, and names that speak of time.
MOST_ROWS, MOST_SLICES, TIME_NAMES = 24, 6, "(?i)date|time|timestamp|日期|时间"
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
_LABELS = ("string", "date", "timestamp", "timestamp_ntz", "char", "varchar")


def infer_charts(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, kind, category, value, points): one row for each result, that is for each ``key``.

    Columns besides ``key`` and ``order`` are the result's, in their order: the
    first that is no number is the category, the first number the value. kind
    is line where the category speaks of time, pie for up to 6 values of 0 or
    more, else bar. It is null, and points too, if a column is lacking, the
    result has over 24 rows, a label is null, repeated or no text or date, or a
    value null or not finite. Only 25 rows of a result are ever gathered, so a
    result that holds most of all rows does no harm; no rows give no results.
    """
    own = [(n, t.split("(")[0]) for n, t in rows.dtypes if n not in {*key, order}]
    category = next(((n, t) for n, t in own if t not in _NUMBERS), None)
    value = next((n for n, t in own if t in _NUMBERS), None)
    drawn = category is not None and value is not None and category[1] in _LABELS
    label = F.col(category[0]).cast("string") if drawn else F.lit(None).cast("string")
    number = F.col(value).cast("double") if drawn else F.lit(None).cast("double")
    first = Window.partitionBy(*key).orderBy(order)
    few = rows.select(*key, order, label.alias("label"), number.alias("number")).withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= MOST_ROWS + 1)
    fit = F.col("label").isNotNull() & F.col("number").isNotNull() & ~F.isnan("number") & (F.abs("number") < float("inf"))
    found = few.groupBy(*key).agg(
        F.count("*").alias("n"), F.count_if(fit).alias("fit"), F.count_distinct("label").alias("labels"), F.min("number").alias("least"),
        F.transform(F.array_sort(F.collect_list(F.struct("_nth", "label", F.col("number").alias("value")))), lambda p: F.struct(p["label"].alias("label"), p["value"].alias("value"))).alias("points"),
    )
    good = F.lit(drawn) & (F.col("n") <= MOST_ROWS) & (F.col("fit") == F.col("n")) & (F.col("labels") == F.col("n"))
    timed = F.lit(drawn and category[1] in ("date", "timestamp", "timestamp_ntz")) | F.lit(category[0] if category else "").rlike(TIME_NAMES)
    kind = F.when(timed, "line").when((F.col("n") <= MOST_SLICES) & (F.col("least") >= 0), "pie").otherwise("bar")
    return found.select(*key, F.when(good, kind).alias("kind"), F.when(good, F.lit(category[0] if category else None)).alias("category"), F.when(good, F.lit(value)).alias("value"), F.when(good, F.col("points")).alias("points"))
