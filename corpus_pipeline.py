"""A corpus from raw documents to token ids: each stage works on all that the one before it kept.

Every stage takes documents with any further columns, which stay as they are (the last one returns its own). Null
doc_ids, texts, languages and sources, empty and very long texts, ties and repeated rows are rows like any other but
for what is said below; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratakit.llm import language, mixing, secrets, sentencepieces
from stratakit.llm.common import forget, stored_at, table
from stratakit.llm.jaccard import near_dedup


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found stay; null texts and those without a letter go (see ``keep_identified``).

    The model is fitted on a bounded sample of the stage's own input. Repeated rows share one verdict.
    """
    return language.keep_identified(docs, language.fit(docs, held_out=None))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard 0.8 of five words) stays: the one with the smallest doc_id.

    Candidates are all pairs of SimHash fingerprints at 4 bits or fewer, from vantage-point trees, and, since most
    pairs at this similarity differ in more bits than such trees can prune (README), pairs that meet in MinHash
    bands. Exact shingle sets verify. Of rows that share that doc_id one stays, by a hash
    of its text; rows without doc_id stay.
    """
    return near_dedup(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark, and n_chars follows. A null text stays null."""
    return secrets.redact(docs, secrets.fit(docs))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or are left out, as the mix of sources asks; null is a source. Repeated rows share what they get."""
    return mixing.mix_rows(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids): what a trainer reads, a row for each row. A null text has null ids."""
    return sentencepieces.encode(docs, sentencepieces.load(sentencepieces.model_of(spark)), keep=("doc_id", "lang", "source"))


STAGES = [
    ("language_id", identified),
    ("near_dedup", near_duplicates),
    ("secret_scan", without_secrets),
    ("source_mixing", mixed_sources),
    ("sentencepiece", tokenised),
]

#: Trained models and token ids are beyond SQL; tests/llm holds run() against plain stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one keeps is stored for the next and removed when that one is stored."""
    docs, held = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, now = stored_at(docs)
            if held:
                forget(spark, held)
            held = now
    return docs
