"""What a question asks evidence for, and whether candidates give it: one bound item for each thing asked.

A requirement is a row of lists; candidates (query_id, at, text, rows, modality,
tool) of a question are a top-k. All of it is expressions over the rows, so a table
of questions of any size is one scan and one join by question.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# The things, measures and phrases that questions are searched for, in their order.
OBJECTS = ("越南", "泰国", "中国", "美国", "日本", "印度", "德国", "法国", "英国", "俄罗斯", "巴西", "加拿大", "澳大利亚", "韩国", "新加坡", "马来西亚", "印度尼西亚", "菲律宾", "文莱", "柬埔寨", "老挝", "缅甸", "墨西哥", "意大利", "西班牙", "荷兰", "沙特阿拉伯", "南非", "埃及", "土耳其", "阿根廷")
METRICS = {"gdp": "GDP", "国内生产总值": "GDP", "人均gdp": "人均GDP", "人口": "人口", "增长率": "增长率", "增长速度": "增长率", "销售额": "销售额", "销量": "销量", "收入": "收入", "产量": "产量", "出口": "出口", "进口": "进口", "碳排放": "碳排放", "二氧化碳": "碳排放", "温度": "温度", "降水": "降水", "准确率": "准确率", "识别率": "识别率", "精度": "精度", "召回率": "召回率"}
METRIC_ALIASES = {"GDP": ("gdp", "国内生产总值"), "人均GDP": ("人均gdp", "人均国内生产总值"), "增长率": ("增长", "增速"), "碳排放": ("碳排放", "二氧化碳")}
IMAGE = "图|图表|图片|示意图|流程图|结构图|曲线|柱状|折线|饼图|散点|地图|照片|示意图|趋势图"
IMAGE_FEATURE = "趋势|走势|峰值|低谷|变化|波动|上升|下降|增长趋势|最高|最低|关系|结构|步骤|流程|分布|颜色|位置|形状|对比图|示意图|曲线|柱状|折线|饼图|散点"
TABLE = "表|表格|数据|统计|数值|指标|对比|比较|增长|汇总|合计|平均"
SCANNED = r"图片\s*表格|图像\s*表格|扫描\s*(?:表|件|图片)|扫描表|图片中"
UNIT = "亿美元|万元|亿元|万美元|亿吨|万吨|万吨标准煤|摄氏度|℃|％|%|人|美元|吨|公里|千米"
YEAR, YEAR_RANGE = r"(?:19|20)\d{2}", r"((?:19|20)\d{2})\s*[-—–至到]\s*((?:19|20)\d{2})"
RELATION = "关系"
RELATION_FILLERS = ("请解释", "解释", "请说明", "说明", "统计关系", "关系", "之间", "的", "请分析", "分析", "请说明")
RELATION_SPLIT, RELATION_EDGES = "与|和|、|,|，|对比|比较|相比|差异|关系", "的了和与及统计指标数据"
MOST_YEARS, MOST_TERMS = 4, 2


def _those(values: tuple[str, ...], text: Column) -> Column:
    return F.filter(F.array(*map(F.lit, values)), lambda v: F.contains(text, v))


def _without(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda t, w: F.replace(t, F.lit(w), F.lit(" ")), words, text)


def relation_terms(text: Column) -> Column:
    """The first two things whose relation is asked about: what fillers, measures and joining words leave, without objects."""
    lowered = _without(F.lower(_without(text, RELATION_FILLERS)), tuple(METRICS))
    parts = F.transform(F.split(lowered, RELATION_SPLIT), lambda p: F.btrim(F.regexp_replace(p, r"[^一-鿿A-Za-z0-9]", ""), F.lit(RELATION_EDGES)))
    told = F.filter(parts, lambda p: (F.char_length(p) >= 2) & (p != "gdp") & (F.size(_those(OBJECTS, p)) == 0))
    return F.when(F.contains(text, F.lit(RELATION)), F.slice(F.array_distinct(told), 1, MOST_TERMS)).otherwise(F.array().cast("array<string>"))


def requirements(questions: DataFrame) -> DataFrame:
    """query_id, objects, years, first_year, last_year (of a range), metrics, needs_image, needs_feature, needs_table, comparison, scanned_table, relation_terms of (query_id, question). Null questions ask for nothing."""
    q = F.trim(F.coalesce(F.col("question"), F.lit("")))
    years = F.slice(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(q, F.lit(YEAR), F.lit(0)), lambda y: y.cast("int")))), 1, MOST_YEARS)
    low, high = (F.regexp_extract(q, YEAR_RANGE, k).try_cast("int") for k in (1, 2))
    tokens = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).alias("m")) for t, m in METRICS.items()])
    metrics = F.array_distinct(F.transform(F.filter(tokens, lambda x: F.contains(F.lower(q), x["t"])), lambda x: x["m"]))
    scanned = q.rlike(SCANNED)
    told = questions.select("query_id", q.alias("_q"), _those(OBJECTS, q).alias("objects"), years.alias("years"), F.when(low <= high, low).alias("first_year"), F.when(low <= high, high).alias("last_year"), metrics.alias("metrics"), scanned.alias("scanned_table"), relation_terms(q).alias("relation_terms"))
    several = F.size("objects") >= 2
    picture = F.col("scanned_table") | F.col("_q").rlike(IMAGE)
    return told.select(
        "query_id", "objects", "years", "first_year", "last_year", "metrics", picture.alias("needs_image"), (F.col("scanned_table") | (F.col("_q").rlike(IMAGE) & F.col("_q").rlike(IMAGE_FEATURE))).alias("needs_feature"),
        (F.col("_q").rlike(TABLE) | ((F.size("metrics") > 0) & several)).alias("needs_table"), several.alias("comparison"), "scanned_table", "relation_terms")


def _says(metric: Column, text: Column) -> Column:
    """Whether a normalised text names a measure, by its name or another of its names."""
    named = reduce(lambda e, kv: e | ((metric == kv[0]) & reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in kv[1]])), METRIC_ALIASES.items(), F.contains(text, F.lower(metric)))
    return named


def assess(needs: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, satisfied, missing (sorted codes), bound (candidates that bind what is asked, by place).

    A candidate is bound if it has an object that is asked for, with a year and a measure where any are
    asked for (without objects: a year and a measure), and a related thing where a relation is asked about.
    Codes: nothing, object:x, relation:x, years, metric:x, image, related_image, object_image, table, comparison, units.
    """
    flat = lambda t: F.lower(F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)\s+", ""))
    names = F.coalesce("rows", F.array().cast("array<string>"))
    own = candidates.select("query_id", "at", "modality", F.coalesce("tool", F.lit(False)).alias("tool"), names.alias("_rows"), flat(F.concat_ws(" ", "text", F.array_join(names, " "))).alias("_t"))
    both = needs.join(own, "query_id", "left")
    t = F.col("_t")
    has = {
        "o": F.filter("objects", lambda o: F.array_contains(F.col("_rows"), o) | F.contains(t, o)), "y": F.filter("years", lambda y: F.contains(t, y.cast("string"))),
        "m": F.filter("metrics", lambda m: _says(m, t)), "r": F.filter("relation_terms", lambda r: F.contains(t, r)),
    }
    both = both.withColumns({f"_{k}": F.when(t.isNotNull(), v).otherwise(F.array()) for k, v in has.items()})
    some = lambda c: F.size(c) > 0
    by_object = (~some("years") | some("_y")) & (~some("metrics") | some("_m"))
    bound = t.isNotNull() & (~some("relation_terms") | some("_r")) & F.when(some("_o"), by_object).otherwise(some("years") & some("metrics") & some("_y") & some("_m"))
    both = both.withColumn("_bound", bound).withColumn("_image", F.coalesce((F.col("modality") == "image") & F.col("tool"), F.lit(False))).withColumn("_table", F.coalesce((F.col("modality") == "table") & F.col("tool"), F.lit(False)))
    every = lambda c, when=None: F.array_distinct(F.flatten(F.collect_list(F.col(c) if when is None else F.when(when, F.col(c)))))
    keys = ["objects", "years", "metrics", "needs_image", "needs_feature", "needs_table", "comparison", "scanned_table", "relation_terms"]
    units = F.regexp_extract_all(t, F.lit(UNIT), F.lit(0))
    told = both.groupBy("query_id", *keys).agg(
        F.count("_t").alias("n"), F.sort_array(F.collect_list(F.when(F.col("_bound"), F.col("at")))).alias("bound"), every("_o", F.col("_bound")).alias("with_object"), every("_m", F.col("_bound")).alias("with_metric"), every("_y").alias("any_year"), every("_r").alias("any_relation"),
        F.flatten(F.collect_list(F.when(F.col("_bound"), F.col("_o")))).alias("object_hits"), F.bool_or("_image").alias("images"), F.bool_or("_table").alias("tables"), F.bool_or((F.col("modality") == "image") & some("_r")).alias("related_image"), F.bool_or((F.col("modality") == "image") & some("_o")).alias("object_image"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("modality") == "table", units))))).alias("units"))
    lacks = lambda c, found, code: F.transform(F.array_except(c, found), lambda x: F.concat(F.lit(code), x))
    flag = lambda cond, code: F.when(F.coalesce(cond, F.lit(False)), F.array(F.lit(code))).otherwise(F.array().cast("array<string>"))
    # a question that the picture itself answers needs no words of measure or year around it
    driven = (F.col("needs_feature") & F.col("images") & ~some("objects") & ~F.col("needs_table")) | (F.col("scanned_table") & F.col("images"))
    unless = lambda codes: F.when(F.coalesce(driven, F.lit(False)), F.array().cast("array<string>")).otherwise(codes)
    dated = some("years") | some("metrics")  # an object that lacks years or measures is told with them, and goes with them
    asked = some("objects") | some("years") | some("metrics") | F.col("needs_image") | F.col("needs_table") | some("relation_terms")
    picture = F.col("needs_feature") & F.col("images") & ~F.col("scanned_table")
    twice = F.exists("objects", lambda o: F.size(F.filter("object_hits", lambda x: x == o)) >= 2)
    codes = F.concat(
        F.when(dated, unless(lacks("objects", "with_object", "object:"))).otherwise(lacks("objects", "with_object", "object:")), lacks("relation_terms", "any_relation", "relation:"), flag(F.size(F.array_except("years", "any_year")) > 0, "years"),
        unless(lacks("metrics", "with_metric", "metric:")), unless(flag(F.col("needs_feature") & ~F.col("images"), "image")),
        flag(picture & some("relation_terms") & ~F.col("related_image"), "related_image"), flag(picture & ~some("relation_terms") & some("objects") & ~F.col("object_image"), "object_image"),
        flag(F.col("needs_table") & ~F.col("tables") & F.col("comparison"), "table"), flag(F.col("comparison") & (F.size("with_object") < 2) & ~twice, "comparison"), flag(F.col("comparison") & (F.col("units") >= 2), "units"))
    missing = F.when(~asked, F.array().cast("array<string>")).when(F.col("n") == 0, F.array(F.lit("nothing"))).otherwise(F.array_sort(codes))
    return told.select("query_id", missing.alias("missing"), "bound").select("query_id", (F.size("missing") == 0).alias("satisfied"), "missing", "bound")
