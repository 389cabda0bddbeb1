"""The corpus pipeline: STAGES of text operators, each reading what the one before kept.

Every stage takes (spark, docs, sf_dir) and works on all of docs; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontaminate, langid, lines, neardup, packing
from corvane.llm.common import aside, is_training, store, table
from corvane.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose best language has no more than half the probability, go.

    Null and empty texts have no letter. Rows are judged one by one, repeated ones alike;
    columns of the caller's own named lang_pred or score are kept as they are.
    """
    model = langid.fit_language_model(docs, is_training(F.col("doc_id")))
    own, columns = aside(docs, "lang_pred", "score")
    found = langid.identify_language(own, model)
    return found.filter("lang_pred <> 'und' and score > 0.5").select(*columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; documents of which no word is left go with them.

    Null texts, and others without a recurring line, stay as they are; n_chars follows a text that is
    changed. Repeated rows share their decisions; own columns named n_lines or n_dropped are kept.
    """
    own, columns = aside(docs, "n_lines", "n_dropped")
    found = lines.dedup_lines(own).filter("n_dropped = 0 or trim(replace(text, '\n', '')) <> ''")
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates stays.

    Null and blank texts are one group. Rows with one id stay or go together, and so do all without an id, which stay.
    """
    groups = neardup.near_duplicate_groups(docs, words_each=5, similarity=0.8)
    gone = store(groups.filter("id <> component_id").select(F.col("id").alias("doc_id")), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of any benchmark item go.

    Null and empty texts have none. Repeated rows are judged alike; own columns with names of the operator's are kept.
    """
    own, columns = aside(docs, "n_words", "n_hit", "n_items", "items", "contaminated")
    found = decontaminate.decontaminate(own, table(spark, sf_dir, "benchmark"), min_items=1)
    return found.filter(~F.col("contaminated")).select(*columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their ids and their places in sequences of 2048 tokens.

    A null or empty text is one piece, the end id; repeated rows are packed each; other columns are left out.
    """
    numbers = ("task", "nth")
    pieces = packing.tokenize(docs, tokenizer_path(), capacity=2048, end_id=0, numbered=numbers)
    return packing.pack(pieces, capacity=2048, numbered=numbers)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: SQL can't express the trained network, SimHash groups or the packing; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = store(docs, name)
    return docs
