"""From documents to token files: toxic documents go, one of each near-duplicate group stays, benchmark passages go, sources are mixed, ids are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import contamination, mixing, near, token_files, toxicity
from skein.llm.shared import staged, table

#: Stages that SQL can't express: a trained classifier and a tokenizer.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Null and empty texts are scored as texts without evidence; repeated rows go or stay together; an empty table stays empty."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates at similarity 0.8 stays, that of the smallest doc_id. Rows without words, null or empty, all stay; unlike texts of one doc_id are documents of their own; of rows equal in id and text one stays."""
    return near.without_duplicates(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which ten consecutive words of a benchmark item, or a shorter item whole, occur go. Null and empty texts stay, as do repeated rows."""
    return contamination.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them: none, once, or up to three times. Rows without words are not taken; a null source is a source; ties go by hash of id and text."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the documents' ids to token files in doc_id order, null first, and gives doc_id, start, n_tokens and ids_crc32 of each as read back. A null or empty text would hold the end id alone; an empty table gives no rows."""
    return token_files.token_table(spark, docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet and read again as the next one's."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name, clean=True)
    return STAGES[-1][1](spark, docs, sf_dir)
