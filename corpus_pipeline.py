"""A corpus pipeline: documents in, packed token sequences out.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; all but the last return the
columns of ``docs``. What holds for all of them: other columns than doc_id, text, lang and
n_chars are carried along, whatever their names; null and repeated ids are ids like others;
texts of any length are worked off whole; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import decontamination, language_id, ngram_join, packing, pii
from lodestrata.llm.queries import language_pieces, packing_tokenizer, table
from lodestrata.llm.scratch import Scratch

#: Below this posterior the language counts as undecided.
LEAST_CERTAINTY = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no clear language, go.

    So do null and empty texts; repeated rows stay or go together. A tie of two
    languages is no clear language. Where no row is labelled, no language is known and all go.
    """
    return language_id.certain(docs, language_pieces(), LEAST_CERTAINTY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram join stays, that with the smallest id, null ids last.

    Of repeated rows, and of rows that tie for the smallest id, one stays. Null and blank texts
    resemble nothing and stay.
    """
    return ngram_join.one_of_each(docs)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one with other figures or names, go.

    Null and empty texts stay; repeated rows stay or go together; without items all stay.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All spans of personal data are replaced by their kind; n_chars follows the text.

    No row goes. Null texts stay null; of overlapping spans the first kind is written.
    """
    return pii.redacted(docs, pii.fit(docs), {"n_chars": len})


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids, one row per piece of a document.

    Null and empty texts are the end id alone; repeated rows are packed each on its own.
    """
    return packing.pack_documents(docs, packing_tokenizer)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark_items),
    ("personal_data", personal_data),
    ("packed", packed),
]

#: SQL can't express the trained stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs)
            if before is not None:
                scratch.drop(before)
            before = docs
    return docs
