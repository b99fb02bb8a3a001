"""The corpus pipeline: five stages over documents, each applying one operator to all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemill.llm import jaccard, langid, packing, quality, substrings
from tonguemill.llm.common import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def languages(docs: DataFrame) -> DataFrame:
    """docs with lang_pred, score, the flag ambiguous, and kept: documents with a letter, also when nothing could be learned."""
    named = langid.identify(docs.select(*COLUMNS), langid.fit(docs))
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return named.withColumn("kept", (F.col("lang_pred") != "und") | letter)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; only those without a letter go, null and empty texts among them. languages() flags the ambiguous ones,
    which stay. lang becomes what was predicted, unless that is ambiguous and a language was given; later stages carry it to the
    packed pieces. Repeated rows are judged each, very long texts whole; an empty table gives none."""
    learned = F.when(F.col("lang_pred") != "und", F.col("lang_pred"))
    lang = F.when(F.col("ambiguous"), F.coalesce("lang", learned)).otherwise(learned)
    return languages(docs).where("kept").withColumn("lang", lang).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps. Null and empty texts have too few words and go; repeated rows are judged each, very long
    texts whole; an empty table gives none."""
    return quality.apply_policy(quality.ledger(docs.select(*COLUMNS))).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id, those without one last, then row key; rows without words stay.

    Only copies collapse: rows that share a doc_id but not their text are told apart, and rows without doc_id are candidates too. Null
    and empty texts stay as they are, repeated or not; an empty table gives none.
    """
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]).alias("row_key"))
    groups = jaccard.link_documents(rows, row_col="row_key").where("component is not null")
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first"))
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # what is left of a group are repetitions of one whole row
    stay = rows.where(has_words).join(first.select("first.row_key"), "row_key", "left_semi").select(*COLUMNS).distinct()
    return stay.union(docs.where(~has_words).select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words of long passages that stand elsewhere too. Null and empty texts stay as they are; repeated rows
    repeat each other and lose their long passages, so copies should be gone before; an empty table gives none."""
    cut = substrings.remove_repeats(docs, keep=["doc_id", "lang", "source"])
    return cut.select("doc_id", F.col("cleaned").alias("text"), "lang", "source", F.length("cleaned").cast("long").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of at most 1024 tokens, and its language. Null and empty texts are an end
    mark alone; repeated rows are packed each; an empty table gives none."""
    named = docs.select(F.struct("doc_id", "lang").alias("document"), "text")
    packed = packing.pack_documents(named, public_tokenizers.path("byte_bpe_50k.json"), id_col="document")
    return packed.select("document.doc_id", "document.lang", *[c for c in packed.columns if c != "document"])


STAGES = [
    ("language", language),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: SQL can't express the language classifier, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's are written as Parquet to the shared folder and read again as the next one's docs."""
    scratch, docs, before = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
