"""The corpus pipeline: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm import langid, mixing, packing, pii, simhash
from tidemark.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A margin under this share of the compressed size is a tie between languages.
MIN_MARGIN = 0.002
#: Near-duplicates: sets of five-word shingles of this Jaccard similarity or more.
SHINGLE, SIMILAR = 5, 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told; fills in a lang that is null.

    Null texts and those without a letter go. Repeated rows all stay or all go.
    """
    dictionaries = langid.learn_dictionaries(spark, docs, F.lit(True))
    found = langid.identify(spark, docs.select(*COLUMNS), dictionaries, MIN_MARGIN).where(F.col("lang_pred") != langid.UNDETERMINED)
    return found.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of smallest doc_id (null last; among equal ones by digest of the text); of rows equal in doc_id and text one.

    Null and empty texts have no words and form one group.
    """
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.when(F.col("text").isNull(), "n").otherwise("t"), F.coalesce("text", F.lit(""))))
    rows = docs.select(*COLUMNS, digest.alias("_row"))
    ids = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_row"))
    groups = simhash.similar_groups(spark, rows.select(ids.alias("doc_id"), "text"), SHINGLE, SIMILAR)
    keepers = written(spark, groups.where("doc_id = component_id").select("doc_id._row").distinct(), "keepers")
    once = Window.partitionBy("_row").orderBy("source", "lang", "n_chars")
    return rows.join(keepers, "_row", "left_semi").withColumn("_nth", F.row_number().over(once)).where("_nth = 1").select(*COLUMNS)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to pseudonyms of their format; null texts stay null, repeated rows stay."""
    found = pii.pseudonymise(docs.select(*COLUMNS), pii.key_of(spark))
    return found.select("doc_id", "text", "lang", "source", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.char_length("text").cast("long"), F.lit(0))).cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, none to three times; a null text has size 0 and is not taken; null sources are a source of their own."""
    mixed = mixing.mix(spark, docs.select(*COLUMNS)).where("copies > 0")
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place; a null text is an empty one, repeated rows are packed each."""
    return packing.pack_documents(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii", pseudonymise), ("mix_sources", mix_sources), ("pack", pack)]

#: Neither compression, fingerprints nor tokens can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
