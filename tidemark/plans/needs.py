"""Queries over what questions ask evidence for, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import requirements as R
from tidemark.plans.catalog import query
from tidemark.sources.tables import table

_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_TOKENS = tuple(R.METRICS)

# Questions of orders and what their lines say, of every kind.
_ASKED = f"""pr AS (SELECT o_orderkey AS k, {_list(R.OBJECTS)}[o_orderkey % 31 + 1] AS a, {_list(R.OBJECTS)}[(o_orderkey // 31) % 31 + 1] AS b, {_list(_TOKENS)}[o_orderkey % 20 + 1] AS m, 1990 + o_orderkey % 40 AS y, 1990 + o_orderkey % 40 + o_orderkey % 7 - 2 AS z FROM orders),
qs AS (SELECT k AS query_id, CASE k % 8 WHEN 0 THEN y || '年' || a || '的' || m || '是多少' WHEN 1 THEN y || ' - ' || z || '年' || a || '和' || b || '的' || m || '对比' WHEN 2 THEN '请解释' || m || '与教育水平的统计关系' WHEN 3 THEN '图片中的' || a || '数据'
  WHEN 4 THEN '曲线的趋势如何变化' WHEN 5 THEN 'What is the ' || upper(m) || ' of ' || a || ' in ' || y WHEN 6 THEN 'hello there' ELSE a || '、' || b || '的' || m || '变化趋势图' END AS q FROM pr),
cd AS (SELECT k AS query_id, CAST(l_linenumber AS INTEGER) AS pos, CASE l_linenumber % 4 WHEN 0 THEN y || ' 年 ' || a || ' ' || m WHEN 1 THEN b || ' ' || m || ' 亿元' WHEN 2 THEN '教育 水平 ' || y ELSE a || ' 2001 吨' END AS text, CASE WHEN l_quantity > 25 THEN [b] ELSE [] END AS rws, ['text', 'table', 'image'][l_partkey % 3 + 1] AS modality, l_suppkey % 2 = 0 AS tool FROM lineitem JOIN pr ON l_orderkey = k WHERE k % 9 <> 4)"""

_strip = "".join(R.RELATION_EDGES)


def _replaced(text: str, words: tuple[str, ...]) -> str:
    for w in words:
        text = f"replace({text}, '{w}', ' ')"
    return text


_NEEDS = f"""{_ASKED}, n0 AS (SELECT *, list_filter({_list(R.OBJECTS)}, lambda o: contains(q, o)) AS objects, list_sort(list_distinct(list_transform(regexp_extract_all(q, '(?:19|20)\\d{{2}}'), lambda y: CAST(y AS INTEGER))))[1:4] AS years,
  TRY_CAST(regexp_extract(q, '{R.YEAR_RANGE}', 1) AS INTEGER) AS lo, TRY_CAST(regexp_extract(q, '{R.YEAR_RANGE}', 2) AS INTEGER) AS hi,
  list_transform(list_filter([{", ".join(f"{{'t': '{t}', 'm': '{m}'}}" for t, m in R.METRICS.items())}], lambda x: contains(lower(q), x.t)), lambda x: x.m) AS ms,
  regexp_matches(q, '{R.SCANNED}') AS scanned_table, CASE WHEN contains(q, '关系') THEN list_transform(regexp_split_to_array({_replaced("lower(" + _replaced("q", R.RELATION_FILLERS) + ")", _TOKENS)}, '{R.RELATION_SPLIT}'), lambda p: trim(regexp_replace(p, '[^\\x{{4e00}}-\\x{{9fff}}A-Za-z0-9]', '', 'g'), '{_strip}')) ELSE [] END AS parts FROM qs),
n1 AS (SELECT *, list_filter(ms, lambda m, i: list_position(ms, m) = i) AS metrics, list_filter(parts, lambda p: length(p) >= 2 AND p <> 'gdp' AND len(list_filter({_list(R.OBJECTS)}, lambda o: contains(p, o))) = 0) AS terms FROM n0),
nd AS (SELECT query_id, objects, years, CASE WHEN lo <= hi THEN lo END AS first_year, CASE WHEN lo <= hi THEN hi END AS last_year, metrics, scanned_table OR regexp_matches(q, '{R.IMAGE}') AS needs_image, scanned_table OR regexp_matches(q, '{R.IMAGE}') AND regexp_matches(q, '{R.IMAGE_FEATURE}') AS needs_feature,
  regexp_matches(q, '{R.TABLE}') OR len(metrics) > 0 AND len(objects) >= 2 AS needs_table, len(objects) >= 2 AS comparison, scanned_table, list_filter(terms, lambda p, i: list_position(terms, p) = i)[1:2] AS relation_terms FROM n1)"""


def _asked(spark, sf_dir):
    k = F.col("o_orderkey")
    of = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    rows = table(spark, sf_dir, "orders").select(k.alias("query_id"), of(R.OBJECTS, k % 31).alias("a"), of(R.OBJECTS, F.floor(k / 31) % 31).alias("b"), of(_TOKENS, k % 20).alias("m"), (1990 + k % 40).cast("string").alias("y"), (1988 + k % 40 + k % 7).cast("string").alias("z"))
    a, b, m, y, z, at = (F.col(c) for c in ("a", "b", "m", "y", "z", "query_id"))
    kinds = [F.concat(y, F.lit("年"), a, F.lit("的"), m, F.lit("是多少")), F.concat(y, F.lit(" - "), z, F.lit("年"), a, F.lit("和"), b, F.lit("的"), m, F.lit("对比")), F.concat(F.lit("请解释"), m, F.lit("与教育水平的统计关系")), F.concat(F.lit("图片中的"), a, F.lit("数据")),
             F.lit("曲线的趋势如何变化"), F.concat(F.lit("What is the "), F.upper(m), F.lit(" of "), a, F.lit(" in "), y), F.lit("hello there"), F.concat(a, F.lit("、"), b, F.lit("的"), m, F.lit("变化趋势图"))]
    return rows.withColumn("question", F.get(F.array(*kinds), (at % 8).cast("int")))


@query(f"WITH {_NEEDS} SELECT * FROM nd")
def evidence_requirements(spark, sf_dir):
    return R.requirements(_asked(spark, sf_dir))


def _says(metric: str, text: str) -> str:
    return f"(contains({text}, lower({metric}))" + "".join(f" OR {metric} = '{m}' AND ({' OR '.join(f'contains({text}, {chr(39)}{w}{chr(39)})' for w in words)})" for m, words in R.METRIC_ALIASES.items()) + ")"


@query(f"""WITH {_NEEDS}, c1 AS (SELECT *, lower(regexp_replace(concat_ws(' ', text, array_to_string(rws, ' ')), '\\s+', '', 'g')) AS t FROM cd),
c2 AS (SELECT n.*, c.pos, c.modality, c.tool, c.t, list_filter(objects, lambda o: list_contains(rws, o) OR contains(t, o)) AS ho, list_filter(years, lambda y: contains(t, CAST(y AS VARCHAR))) AS hy, list_filter(metrics, lambda m: {_says('m', 't')}) AS hm, list_filter(relation_terms, lambda r: contains(t, r)) AS hr FROM nd n JOIN c1 c USING (query_id)),
c3 AS (SELECT *, (len(relation_terms) = 0 OR len(hr) > 0) AND CASE WHEN len(ho) > 0 THEN (len(years) = 0 OR len(hy) > 0) AND (len(metrics) = 0 OR len(hm) > 0) ELSE len(years) > 0 AND len(metrics) > 0 AND len(hy) > 0 AND len(hm) > 0 END AS bound FROM c2),
ag AS (SELECT query_id, count(*) AS n, coalesce(list_sort(list(pos) FILTER (WHERE bound)), []) AS bound, coalesce(flatten(list(ho) FILTER (WHERE bound)), []) AS wo, coalesce(flatten(list(hm) FILTER (WHERE bound)), []) AS wm, flatten(list(hy)) AS wy, flatten(list(hr)) AS wr, bool_or(modality = 'image' AND tool) AS images, bool_or(modality = 'table' AND tool) AS tables,
  bool_or(modality = 'image' AND len(hr) > 0) AS ri, bool_or(modality = 'image' AND len(ho) > 0) AS oi, len(list_distinct(coalesce(flatten(list(regexp_extract_all(t, '{R.UNIT}')) FILTER (WHERE modality = 'table')), []))) AS units FROM c3 GROUP BY 1),
j AS (SELECT n.*, coalesce(g.n, 0) AS cn, coalesce(bound, []) AS bound, coalesce(wo, []) AS wo, coalesce(wm, []) AS wm, coalesce(wy, []) AS wy, coalesce(wr, []) AS wr, coalesce(images, false) AS images, coalesce(tables, false) AS tables, coalesce(ri, false) AS ri, coalesce(oi, false) AS oi, coalesce(units, 0) AS units FROM nd n LEFT JOIN ag g USING (query_id)),
d AS (SELECT *, needs_feature AND images AND len(objects) = 0 AND NOT needs_table OR scanned_table AND images AS driven FROM j),
ms AS (SELECT query_id, bound, CASE WHEN len(objects) + len(years) + len(metrics) + len(relation_terms) = 0 AND NOT needs_image AND NOT needs_table THEN [] WHEN cn = 0 THEN ['nothing'] ELSE list_sort(list_filter(flatten([
  CASE WHEN driven AND len(years) + len(metrics) > 0 THEN [] ELSE list_transform(list_filter(objects, lambda o: NOT list_contains(wo, o)), lambda o: 'object:' || o) END,
  list_transform(list_filter(relation_terms, lambda r: NOT list_contains(wr, r)), lambda r: 'relation:' || r), [CASE WHEN len(list_filter(years, lambda y: NOT list_contains(wy, y))) > 0 THEN 'years' END],
  CASE WHEN driven THEN [] ELSE list_transform(list_filter(metrics, lambda m: NOT list_contains(wm, m)), lambda m: 'metric:' || m) END, [CASE WHEN needs_feature AND NOT images AND NOT driven THEN 'image' END,
  CASE WHEN needs_feature AND images AND NOT scanned_table AND len(relation_terms) > 0 AND NOT ri THEN 'related_image' END, CASE WHEN needs_feature AND images AND NOT scanned_table AND len(relation_terms) = 0 AND len(objects) > 0 AND NOT oi THEN 'object_image' END,
  CASE WHEN needs_table AND NOT tables AND comparison THEN 'table' END, CASE WHEN comparison AND len(list_distinct(wo)) < 2 AND len(list_filter(objects, lambda o: len(list_filter(wo, lambda x: x = o)) >= 2)) = 0 THEN 'comparison' END, CASE WHEN comparison AND units >= 2 THEN 'units' END]]), lambda x: x IS NOT NULL)) END AS missing FROM d)
SELECT query_id, len(missing) = 0 AS satisfied, missing, bound FROM ms""")
def evidence_assessment(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey % 9 <> 4").join(asked, F.col("l_orderkey") == F.col("query_id"))
    a, b, m, y, n = (F.col(c) for c in ("a", "b", "m", "y", "l_linenumber"))
    text = F.when(n % 4 == 0, F.concat(y, F.lit(" 年 "), a, F.lit(" "), m)).when(n % 4 == 1, F.concat(b, F.lit(" "), m, F.lit(" 亿元"))).when(n % 4 == 2, F.concat(F.lit("教育 水平 "), y)).otherwise(F.concat(a, F.lit(" 2001 吨")))
    kind = F.get(F.array(F.lit("text"), F.lit("table"), F.lit("image")), (F.col("l_partkey") % 3).cast("int"))
    found = lines.select("query_id", n.cast("int").alias("at"), text.alias("text"), F.when(F.col("l_quantity") > 25, F.array(b)).alias("rows"), kind.alias("modality"), (F.col("l_suppkey") % 2 == 0).alias("tool"))
    return R.assess(R.requirements(asked), found)
