"""Rules over questions and answers: routing, coverage, intent, numeric claims, memories. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Words and patterns that the rules look for, and their limits.
COMPLEX = (
    "对比", "比较", "区别", "差异", "异同", "关系", "联系", "为什么", "原因", "影响", "作用", "流程", "步骤", "过程", "总结", "概括", "梳理", "归纳", "汇总", "统计", "有哪些", "哪些", "分别", "各自", "以及", "同时", "全文", "整篇", "整个", "所有", "时间线",
    "演变", "发展", "优缺点", "评价", "列举", "表格", "图表", "图片", "数据", "跨文档", "compare", "difference", "relationship", "summarise", "summarize", "overview", "list", "steps", "process", "across",
)
FACT = (
    "是多少", "多少", "多少个", "几种", "几个", "多久", "多长时间", "什么时候", "何时", "哪一年", "几年", "哪里", "在哪", "哪个部门", "谁负责", "谁", "是否", "能不能", "多大", "多高", "多长", "几米", "几度", "what is", "how many", "how long", "when", "where", "who", "which",
)
STOP = (
    "为什么", "是什么", "什么是", "怎么样", "怎么办", "怎么", "怎样", "如何", "哪些", "哪个", "多少", "什么", "这份", "这份资料", "该资料", "资料中", "文档中", "里面", "中的", "资料", "文档", "报告", "文件", "内容", "部分", "情况", "方面", "关于", "根据", "有关", "以及", "还有",
    "资料里", "文档里", "报告里", "文中", "提到", "说到", "该文档", "该报告", "请说明", "请介绍", "请", "说明", "介绍", "告诉", "一下", "里", "我们", "你们", "他们", "可以", "需要", "是否", "的话", "的", "了", "是", "在", "和", "与", "及", "或", "对", "中", "上", "下", "有", "呢", "吗", "吧", "啊", "呀",
)
FOLLOW_UP = (
    "它", "他", "她", "这个", "那个", "这些", "那些", "上述", "上面", "刚才", "之前", "前面", "上一条", "继续", "接着", "再", "进一步", "展开", "详细", "具体", "为什么", "呢", "this", "that", "these", "those", "it", "they", "above", "previous", "more", "why",
)
SEPARATORS, PARTICLES = "，,;；、", "呢吗吧啊呀哦哈嘛"
LEADING = r"^(?:(?:你好|您好|哈喽|哈罗|嗨|喂|在吗|在么|hello|hi|hey|请问一下|请问|麻烦问一下|麻烦|劳驾|想问一下|想问|我想问)[，,。.!！?？~～、\s]*)+"
TRAILING = r"(?:请问|谢谢|多谢|麻烦了|一下|一下下|的话)*[?？！!。．\s]*$"
SIMPLE_CHARS, FACT_CHARS, FOLLOW_UP_CHARS, LEAST_COVERAGE = 24, 40, 8, 0.5
ANALYTIC = "多少|具体|精确|准确|百分|百分之|增长|下降|降幅|增幅|最低|最高|最大|最小|排名|合计|总和|总计|平均|占比|比例|差值|相差|金额|总量|总额"
VISUAL = "图|图表|图片|示意图|曲线|柱状|折线|饼图|扫描|照片|图形|海报"
NUMBER = r"(?<![0-9A-Za-z_.])[-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?%?|(?<![0-9A-Za-z_.])[-+]?\d+(?:\.\d+)?%?"
YEAR_ONLY = r"^(?:19|20)\d{2}$"
WRITES = (
    r"(?i)^(?:请帮我|请|帮我|麻烦)?\s*(?:删除|删掉|更新|修改|插入|新增|写入|清空|创建|建表|改变|更改|重命名)",
    r"(?:把|将)\s*[^。！？\n]{0,160}(?:改成|修改为|更新为|设置为|设为|写入|删除)",
    r"(?i)^\s*(?:please\s+)?(?:delete|update|insert|alter|drop|truncate|create)\b",
    r"(?i)\b(?:change|set|remove)\s+(?:the\s+)?(?:value|name|record|records|row|rows|data|table|column|schema)\b",
)
VISUAL_DETAIL = r"图|表|示意|流程|趋势|统计|柱状|折线|曲线|饼图|散点|地图|结构|示意|关系|分布|对比|比较"
GENERIC_CAPTION = r"^(图|表)\s*[\d一二三四五六七八九十]+[\s.、:：-]*$"
CAPTION_CHARS, CONTEXT_CHARS, LARGE_PIXELS = 15, 80, 600_000
QUOTAS = {"explicit": 4, "ambiguous": 1, "plain": 0}


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def stripped(question: Column) -> Column:
    """A question without greetings in front and particles behind; lower case."""
    plain = F.regexp_replace(F.trim(F.lower(F.coalesce(question, F.lit("")))), LEADING, "")
    edge = lambda c: F.regexp_replace(c, f"^[{PARTICLES}]+|[{PARTICLES}]+$", "")
    short = edge(F.regexp_replace(edge(plain), TRAILING, ""))
    return F.when(short == "", edge(plain)).otherwise(short)


def content_terms(question: Column) -> Column:
    """The distinct words of two characters or more that say what a question is about, in its order."""
    text = stripped(question)
    for word in STOP:
        text = F.replace(text, F.lit(word), F.lit(" "))
    return F.array_distinct(F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda t: F.char_length(t) >= 2))


def _covered(term: Column, text: Column) -> Column:
    return F.contains(text, term) | ((F.char_length(term) >= 3) & F.contains(text, F.substring(term, 1, 2)))


def flat(text: Column) -> Column:
    """A text as terms are looked for in it: lower case, runs of space made one."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def coverage(terms: Column, text: Column) -> Column:
    """The share of content terms that a flat text has; 1 if there are none. Both are best columns worked out before: each is read more than once."""
    return F.when(F.size(terms) == 0, 1.0).otherwise(F.size(F.filter(terms, lambda t: _covered(t, text))) / F.size(terms))


def escalates(terms: Column, text: Column) -> Column:
    """Whether a dense result, as a flat text, is too thin: empty, its subject missing, or under half of the terms covered."""
    return (F.trim(text) == "") | F.coalesce(~_covered(F.get(terms, 0), text), F.lit(False)) | (coverage(terms, text) < LEAST_COVERAGE)


def simple(question: Column) -> Column:
    """Whether one lookup will do: one clause without marks of complexity, short, or a longer question for a fact."""
    q = stripped(question)
    n = F.char_length(q)
    return (q != "") & ~q.rlike(f"[{SEPARATORS}]") & ~_any(q, COMPLEX) & ((n <= SIMPLE_CHARS) | ((n <= FACT_CHARS) & _any(q, FACT)))


def follows_up(question: Column, has_history: Column) -> Column:
    q = stripped(question)
    return has_history & (q != "") & ((F.char_length(q) <= FOLLOW_UP_CHARS) | _any(q, FOLLOW_UP))


def route(question: Column) -> Column:
    """direct for a greeting alone, dense for one lookup, else unified."""
    return F.when(F.trim(question).rlike(LEADING) & (stripped(question) == ""), "direct").when(simple(question), "dense").otherwise("unified")


def writes(question: Column) -> Column:
    """Whether a question asks for a change."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.trim(question).rlike(p), F.lit(False)) for p in WRITES])


def grounded(mention: Column, text: Column) -> Column:
    """Whether a mention occurs in a text, cases and runs of space aside."""
    flat = lambda c: F.trim(F.lower(F.regexp_replace(c, r"\s+", " ")))
    return F.coalesce(F.contains(flat(text), flat(mention)), F.lit(False))


def visual_intent(question: Column) -> Column:
    """explicit (names a picture), ambiguous (asks for exact numbers) or plain."""
    q = F.regexp_replace(F.coalesce(question, F.lit("")), r"\[C[1-9][0-9]*\]", " ")
    return F.when(q.rlike(VISUAL), "explicit").when(q.rlike(ANALYTIC), "ambiguous").otherwise("plain")


def visual_policy(caption: Column, context: Column, pixels: Column, images: Column, has_table: Column) -> Column:
    """struct(mode, reason): whether a picture needs an index of its own; the first rule that holds decides."""
    cap, ctx = F.trim(F.coalesce(caption, F.lit(""))), F.trim(F.coalesce(context, F.lit("")))
    large = pixels.isNull() | (pixels > LARGE_PIXELS)
    enough = (F.char_length(ctx) >= 100) & F.coalesce(images == 1, F.lit(False)) & ~has_table & (pixels.isNull() | (pixels <= LARGE_PIXELS)) & ~ctx.rlike(VISUAL_DETAIL)
    reason = (
        F.when((cap == "") & enough, "no_caption_but_context").when(cap == "", "no_caption").when(cap.rlike(GENERIC_CAPTION), "generic_caption").when(F.char_length(cap) < CAPTION_CHARS, "short_caption")
        .when(F.char_length(ctx) < CONTEXT_CHARS, "short_context").when(has_table, "table_on_page").when(images.isNull() | (images > 1), "several_images").when(large, "large_image")
        .when(cap.rlike(VISUAL_DETAIL), "caption_detail").when(ctx.rlike(VISUAL_DETAIL), "context_detail").otherwise("text_suffices")
    )
    return F.struct(F.when(reason.isin("no_caption_but_context", "text_suffices"), "text_only").otherwise("text_and_visual").alias("mode"), reason.alias("reason"))


def numeric_claims(text: Column) -> Column:
    """The numbers of a text that are no years, in order."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda n: ~n.rlike(YEAR_ONLY))


def without_claims(text: Column, mark: str = "[unverified]") -> Column:
    """The text with its numeric claims masked; years stay."""
    not_year = r"(?!(?:19|20)\d{2}(?!\d|%|[.,]\d))"  # a year may end a clause
    return F.regexp_replace(text, rf"(?<![0-9A-Za-z_.]){not_year}[-+]?(?:\d{{1,3}}(?:,\d{{3}})+|\d+)(?:\.\d+)?%?", mark)


def memory_key(text: Column) -> Column:
    """Letters and digits alone, lower case: what two notes are compared by."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def cache_key(kb: Column, document: Column, mode: Column, question: Column, version: str = "v2") -> Column:
    """The key of a request: SHA-256 of its scope, mode and question as JSON, cases and runs of space aside."""
    flat = F.replace(F.lower(F.trim(F.regexp_replace(question, r"\s+", " "))), F.lit("ß"), F.lit("ss"))
    request = F.struct(document.cast("string").alias("document_id"), kb.cast("string").alias("knowledge_base_id"), flat.alias("query"), mode.alias("retrieval_mode"), F.lit(version).alias("version"))
    return F.concat(F.lit(f"rag:context:{version}:"), F.sha2(F.to_json(request, {"ignoreNullFields": "false"}), 256))


def rerank_text(text: Column, section: Column, kinds: Column) -> Column:
    """What a reranker reads of a chunk: its text, or its section and types where it has none."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.concat_ws(" ", section, F.concat(F.lit("["), F.array_join(F.array_sort(kinds), ", "), F.lit("]"))))


def safe_name(name: Column, most: int = 80) -> Column:
    """A file name: control characters and separators out, spaces made one; ``untitled`` if nothing is left."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r'[\x00-\x1f\x7f\\/:*?"<>|]+', " "), r"\s+", " "))
    return F.coalesce(F.nullif(F.rtrim(F.substring(flat, 1, most)), F.lit("")), F.lit("untitled"))
