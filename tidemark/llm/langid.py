"""Language identification by compression.

Each language has a zstandard raw-content dictionary, cut from labelled
documents. A text is compressed with every dictionary, block by block, and the
language whose dictionary makes it smallest is chosen; a narrow margin rejects.
"""

from __future__ import annotations

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidemark.llm.common import small_batches

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}").search


def learn_dictionaries(spark: SparkSession, docs: DataFrame, usable: Column, dictionary_bytes: int = 110 << 10, sample_docs: int = 300) -> dict[str, bytes]:
    """A dictionary for each language among the rows for which ``usable`` holds.

    The sample is bounded and documented: of each language the ``sample_docs``
    ids of smallest hash whose texts have at most an eighth of
    ``dictionary_bytes``, whole texts in that order until the dictionary is
    full. Null text, lang or doc_id: not used; repeated rows count once, and of
    several texts of one doc_id and language the least is taken.
    """
    small_batches(spark)
    of_lang = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.octet_length("text") <= dictionary_bytes // 8))
    # The least ids of a language come from those of its groups of partitions: no task sees more than a share of a common language.
    share = (F.spark_partition_id() % 16).alias("share")
    of_share = Window.partitionBy("lang", "share").orderBy(F.xxhash64("doc_id"), "doc_id")
    least = rows.select("lang", "doc_id", share).withColumn("nth", F.dense_rank().over(of_share)).where(F.col("nth") <= sample_docs).select("lang", "doc_id").distinct()
    picked = least.withColumn("nth", F.row_number().over(of_lang)).where(F.col("nth") <= sample_docs)
    ids = {(r.lang, r.doc_id): r.nth for r in picked.collect()}  # sample_docs ids a language at most
    found: dict[str, list] = {}
    wanted = rows.where(F.col("doc_id").isin([d for _, d in ids])).select("lang", "doc_id", "text")
    for r in wanted.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect():
        if (r.lang, r.doc_id) in ids:
            found.setdefault(r.lang, []).append((ids[r.lang, r.doc_id], r.text.lower().encode("utf-8", "replace")))
    dictionaries = {}
    for lang, texts in sorted(found.items()):
        held, size = [], 0
        for _, raw in sorted(texts):
            if size + len(raw) + 1 <= dictionary_bytes:
                held.append(raw)
                size += len(raw) + 1
        dictionaries[lang] = b"\n".join(held)
    return dictionaries


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = 5, block: int = 2048, short: int = 256):
        self.block, self.short = block, short
        self.by_lang = {}
        for lang, content in sorted(dictionaries.items()):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by_lang[lang] = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def sizes(self, text: str) -> dict[str, int]:
        """Compressed bytes of the whole text under each dictionary; blocks bound memory and keep the dictionary in play."""
        raw = text.lower().encode("utf-8", "replace")
        blocks = [raw[at : at + self.block] for at in range(0, len(raw), self.block)]
        if len(raw) < self.short:  # whole bytes are a coarse measure of a short text: its tails are measured too
            blocks += [raw[len(raw) * k // 4 :] for k in (1, 2, 3) if len(raw) * k // 4]
        return {lang: sum(len(c.compress(b)) for b in blocks) for lang, c in self.by_lang.items()}

    def predict(self, text: str | None, min_margin: float = 0.0) -> tuple[str, float]:
        """(language, score). The score is the share by which the best dictionary beats the second.

        A margin under ``min_margin`` is narrow, and the text rejected, only if
        it is long enough to show one: from ``short`` bytes on.
        """
        if not text or not _LETTER(text) or not self.by_lang:
            return UNDETERMINED, 0.0
        ranked = sorted((n, lang) for lang, n in self.sizes(text).items())
        margin = 1.0 - ranked[0][0] / ranked[1][0] if len(ranked) > 1 else 1.0
        narrow = margin < min_margin and len(text.encode("utf-8", "replace")) >= self.short
        return (UNDETERMINED if narrow else ranked[0][1]), margin


def identify(spark: SparkSession, docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.0) -> DataFrame:
    """``docs`` with lang_pred and score. Only the text is looked at.

    A text that is null, empty or without a letter, or long enough and of a
    margin under ``min_margin``, gets ``und``. Very long texts are measured in
    blocks; repeated rows get equal results; an empty table stays empty. Ties go to the language that sorts first.
    Columns of ``docs`` by the two new names give way to the new ones.
    """
    small_batches(spark)
    kept = docs.drop("lang_pred", "score")
    names = kept.columns
    text_at = names.index("text")
    models: list[Classifier] = []

    def predict(batches):
        if not models:
            models.append(Classifier(dictionaries))
        for batch in batches:
            found = [models[0].predict(t.as_py(), min_margin) for t in batch.column(text_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*names, "lang_pred", "score"])

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(predict, schema)


def held_out(column: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has that remainder; a null id is held out."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus == remainder, F.lit(True))
