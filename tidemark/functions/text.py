"""Text functions: tokens, labels, numbers, similarities."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

ASCII_TOKEN = r"[a-z0-9]+(?:[._-][a-z0-9]+)*"
_CJK = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0002fa1f"
_RUN = re.compile(rf"[{_CJK}]+|(?:(?![{_CJK}])[^\W_])+(?:[._-](?:(?![{_CJK}])[^\W_])+)*")
# Cells that mean "no number".
MISSING = ("", "-", "--", "---", "—", "–", "－", "/", "\\", "n/a", "na", "nan", "null", "none", "无", "暂无", "缺失", "不详")


def ascii_tokens(text: Column) -> Column:
    """Lower-case ASCII tokens; inner ``.``, ``-`` and ``_`` stay. Stays in the JVM."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({ASCII_TOKEN})"), F.lit(1))


def tokenize(text: str | None) -> list[str]:
    """NFKC and casefold; CJK runs give all single characters, then all pairs; other runs stay whole."""
    out: list[str] = []
    for run in _RUN.findall(unicodedata.normalize("NFKC", text or "").casefold()):
        if re.match(f"[{_CJK}]", run):
            out += [*run, *(run[i : i + 2] for i in range(len(run) - 1))]
        else:
            out.append(run)
    return out


@F.pandas_udf(ArrayType(StringType()))
def tokens(text: pd.Series) -> pd.Series:
    return text.map(tokenize)


@F.pandas_udf(StringType())
def linking_label(text: pd.Series) -> pd.Series:
    """NFKC, trimmed, casefolded, runs of space made one."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


@F.pandas_udf(StringType())
def table_label(text: pd.Series) -> pd.Series:
    """As linking_label, but without NFKC."""
    return text.map(lambda t: None if t is None else " ".join(t.replace(" ", " ").casefold().split()))


def number(text: Column) -> Column:
    """A cell as DECIMAL(28,10): thousands commas, percent, minus signs and (x) for negatives; null if it is none."""
    compact = F.regexp_replace(F.translate(F.trim(text), "\u00a0，−％", " ,-%"), "[, ]", "")
    bare = F.regexp_replace(compact, "%$", "")
    negative = bare.rlike(r"^\(.*\)$")
    digits = F.when(negative, F.regexp_extract(bare, r"^\((.*)\)$", 1)).otherwise(bare)
    value = F.when(digits.rlike(r"^[+-]?(\d+(\.\d+)?|\.\d+)$"), digits.try_cast("decimal(28,10)"))
    return F.when(is_missing(text), None).otherwise(F.when(negative, -value).otherwise(value))


def is_missing(text: Column) -> Column:
    """Whether a cell says that there is no value."""
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).isin(*MISSING)


def is_percent(text: Column) -> Column:
    return F.trim(text).rlike("[%％]$")


# Years, units in brackets, unit words; characters that make a bracket a formula.
YEAR = r"(?<!\d)((?:19|20)\d{2})(?!\d)"
IN_BRACKETS = r"[（(]([^()（）]{1,32})[)）]"
UNITS = ("元", "美元", "欧元", "日元", "英镑", "港元", "亿元", "万元", "亿", "万", "吨", "千克", "公斤", "克", "米", "千米", "公里", "公顷", "平方米", "立方米", "升", "毫升", "人", "人次", "户", "辆", "台", "件", "个", "百分点", "%")
ENGLISH_UNIT = r"^[A-Za-z][A-Za-z0-9 .,/%_\-]{0,39}$"
FORMULA = r"[\^=+*/\\<>]"


def header_year(header: Column) -> Column:
    """The first year of a header, or null."""
    return F.nullif(F.regexp_extract(header, YEAR, 1), F.lit("")).cast("int")


def header_unit(header: Column) -> Column:
    """The first bracket of a header that names a unit; ``%`` where the header ends with it; else null."""
    inner = F.transform(F.regexp_extract_all(header, F.lit(IN_BRACKETS), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, r"[\s\u00a0]+", " ")))
    known = lambda c: F.exists(F.array(*[F.lit(u) for u in UNITS]), lambda u: F.contains(c, u)) | c.rlike(ENGLISH_UNIT)
    units = F.filter(inner, lambda c: (c != "") & ~c.rlike(r"^(?:19|20)\d{2}\s*年?$") & ~c.rlike(FORMULA) & known(c))
    return F.coalesce(F.get(units, 0), F.when(F.rtrim(header).rlike("[%％]$"), F.lit("%")))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of a label."""
    size = F.greatest(F.char_length(text) - (n - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(text, i, F.lit(n))))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def contains_term(text: Column, term: str) -> Column:
    """Substring; an ASCII identifier needs ASCII word boundaries."""
    if re.fullmatch(r"[A-Za-z0-9_.\-]+", term):
        return text.rlike(rf"(?i)(?<![A-Za-z0-9_]){re.escape(term)}(?![A-Za-z0-9_])")
    return F.contains(F.lower(text), F.lit(term.lower()))


def contains_column(text: Column, term: Column) -> Column:
    """As contains_term, for a term of the same row and texts in one case already."""
    bounded = F.regexp_like(text, F.concat(F.lit("(?<![A-Za-z0-9_])"), term, F.lit("(?![A-Za-z0-9_])")))
    return F.contains(text, term) & F.when(term.rlike("^[A-Za-z0-9_]+$"), bounded).otherwise(True)
