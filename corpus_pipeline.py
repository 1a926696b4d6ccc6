"""The corpus pipeline: quality rules, quality classifier, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of documents; the last returns packed pieces. Repeated passages are removed in all of their
places, as the operator defines; a text that loses everything stays as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colsieve.llm import bpe, neardup, packing, quality, rules, suffix_dedup
from colsieve.llm.common import table
from colsieve.session import materialize

#: A passage is what repeats over more than 50 words. Words have 6 to 7 bytes with their space here, and 51 words had 253 bytes at
#: least, so repeated strings are looked for from PASSAGE_BYTES on and runs of fewer words than PASSAGE_WORDS stay.
PASSAGE_BYTES, PASSAGE_WINDOW, PASSAGE_WORDS = 200, 96, 51

#: The classifier's decision isn't expressible in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the full policy."""
    return rules.passing(docs, rules.FULL)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade suffices; the model is fitted on the rated documents of the whole table."""
    model = quality.train(table(spark, sf_dir, "documents"), quality.grades_of(table(spark, sf_dir, "labels")))
    return quality.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return neardup.without_near_duplicates(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of more than 50 words that stand elsewhere too."""
    return suffix_dedup.stripped(docs, length_col="n_chars", length=PASSAGE_BYTES, window=PASSAGE_WINDOW, min_words=PASSAGE_WORDS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of at most 4096."""
    return packing.pack(docs, bpe.vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the others' are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
