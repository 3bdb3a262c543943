"""A training corpus from raw documents, stage by stage.

language ID -> MinHash near-dedup -> benchmark decontamination -> PII -> best-fit packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet and reads again for the next one.  All but the last return the columns of
``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontaminate, lang_id, near_dedup, packing, pii
from leafmill.llm.common import materialize, table
from leafmill.llm.token_counts import VOCABULARY

#: Near copies from this many hundredths of similarity on; op7's query has a figure of its own.
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that the network has learned, go.

    Null and empty texts go; ids play no part in what stays, repeated rows fare alike, and
    without any labelled row, as in an empty table, nothing stays.
    """
    return lang_id.keep_known(docs, lang_id.train(docs, F.lit(True)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id; copies share ``NEAR_PERCENT`` of their 5-word shingles.

    Texts without words are no copies and stay; of repeated rows, and of equal smallest
    ids, one row stays; of a group's rows without an id one stays beside that with an id.
    """
    return near_dedup.keep_one(docs, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; single benchmark passages are cut out of the others.

    Null and word-less texts stay as they are, repeated rows fare alike, and without
    benchmark items all stay.
    """
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; all documents stay, null texts null, and repeated rows fare alike."""
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes, by its tokens.

    Null and empty texts have one row without a bin; repeated rows are packed as often as
    they occur, with or without ids.
    """
    return packing.pack(docs, vocabulary=VOCABULARY)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("pii", pii_masking),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the trained stages; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
