"""A corpus pipeline over ``documents``: each stage reads what the one before it wrote.

A document is a row; rows may repeat an id or lack one.  Every stage gives an empty result for an empty table, leaves further
columns of its input unread, and treats rows that repeat as it says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewise.llm import language, lines, pieces, simhash, templates
from planewise.llm.common import delete_at_exit, read, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without letters go, null and empty texts among them.

    Each row is judged by its text alone, so repeated rows stay or go together, and ids do not matter.
    """
    found = language.identify(docs, language.learn(docs))
    return found.where(F.col("lang_pred") != language.UNDETERMINED).select("row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut; documents of which nothing is left go.

    The first occurrence is that of the smallest id, then of the earlier line.  A null text stays null.  Rows that repeat an id
    count as one document, and each keeps what its own windows leave; a row without an id counts as earliest and is never cut.
    """
    cut = lines.cut_lines(docs)
    kept = {c: F.col("row")[c] for c in COLUMNS} | {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)}
    return cut.where("kept is null or kept <> '' or n_removed = 0").select(*(kept[c].alias(c) for c in COLUMNS))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; rows without an id stand in no group and stay.

    A document is an id here: the rows that repeat the smallest id of a group all stay.  Null and empty texts are copies of each other.
    """
    groups = simhash.near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias("first")).distinct()
    kept = docs.join(groups, F.col("doc_id") == F.col("first"), "left_semi")
    return kept.unionByName(docs.where("doc_id is null"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no template window with a benchmark item; rows without an id are told apart by their text.

    Rows that repeat an id stay or go together; null and empty texts share nothing and stay.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2("text", 256)))
    return templates.without_contaminated(docs.withColumn("key", key), read(spark, sf_dir, "benchmark"), id_col="key").drop("key")


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with digests of the ids and of the decoded text; a row for each row, null texts as empty ones."""
    return pieces.round_trip(docs, with_ids=True)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("sentencepiece", as_pieces),
]

#: Cross-parsing, fingerprints and pieces are not SQL.  Tests hold all stages together, on a small table with null and
#: repeated ids, against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    delete_at_exit(spark, folder)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
