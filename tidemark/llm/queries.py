"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import ann, langid, merkle, mixing, packing, pii, quality, runs, simhash, substrings, token_planes, warc, weighted_sampling
from tidemark.llm.common import shared_dir, table, written


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as byte planes and read back."""
    manifest = token_planes.write_planes(spark, table(spark, sf_dir, "documents"), shared_dir(spark, "planes"), public_tokenizers.path("word_bpe_49k.json"), spaced=False, end_id=1)
    return token_planes.read_planes(spark, manifest, with_ids=False)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 2048 ids."""
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text; dictionaries come from the other two folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.held_out(F.col("doc_id"), 3, 1)
    dictionaries = langid.learn_dictionaries(spark, docs, ~out)
    return langid.identify(spark, docs.select("doc_id", "text"), dictionaries).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return ann.search(spark, table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = simhash.near_duplicates(spark, table(spark, sf_dir, "documents"), shingle=3, tau=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return weighted_sampling.fingerprint_edits(spark, table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes."""
    docs = table(spark, sf_dir, "documents")
    sized = written(spark, docs.select("doc_id", "source", mixing.words(F.col("text")).alias("words")), "sizes")
    return mixing.mix(spark, sized, size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data pseudonymised."""
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.key_of(spark))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to zstandard WARC archives and read back."""
    archives = warc.write_archives(spark, table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    return warc.read_archives(spark, archives)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text; labels come from the other three folds."""
    out = langid.held_out(F.col("doc_id"), 4, 2)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(spark, docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), ~out)
    return quality.classify(spark, docs, model, 0.7).select("doc_id", out.alias("held_out"), "score", "predicted")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, checked against a copy in which every seventh document is tampered with."""
    seventh = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(spark, table(spark, sf_dir, "documents"), seventh).drop("proof")


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of repeated words in every whole text, a tenth of them with a planted one."""
    docs = table(spark, sf_dir, "documents")
    return runs.report(runs.find_runs(spark, docs.select("doc_id", runs.planted(F.col("doc_id"), F.col("text")).alias("text"))))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text without the bytes of 100-byte strings that stand earlier in the corpus."""
    return substrings.report(substrings.remove_repeats(spark, table(spark, sf_dir, "documents"), 100))


QUERIES = {"op12_suffix_dedup": op12_suffix_dedup, "op13_runs": op13_runs, "op11_merkle": op11_merkle, "op8_warc": op8_warc, "op9_quality": op9_quality, "op7_mixing": op7_mixing, "op10_pii": op10_pii, "op6_fingerprints": op6_fingerprints, "op5_simhash": op5_simhash, "op3_langid": op3_langid, "op4_ann": op4_ann, "op2_packing": op2_packing, "op1_token_planes": op1_token_planes}
ORACLE_SQL: dict[str, str] = {"op7_mixing": mixing.oracle(), "op8_warc": warc.ORACLE, "op11_merkle": merkle.ORACLE}


def queries() -> dict:
    import corpus_pipeline

    return dict(QUERIES) | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
