"""A training-corpus pipeline: five stages, each an operator over all that the stage before kept.

Stages take (spark, docs, sf_dir). All but the last return the columns of documents. A null doc_id is an
id like others, null texts count as empty, and columns other than those of documents are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingmill.functions.storage import materialise
from pingmill.llm import chosen_path, exact_dedup, packing, quality, suffix_dedup
from pingmill.llm.queries import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id, null or not, is in ``ids``."""
    return docs.alias("d").join(ids.alias("k"), F.expr("d.doc_id <=> k.doc_id"), "left_semi").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects. Rows of one id stay if one of them does."""
    return _of(docs, quality.score(docs, table(spark, sf_dir, "labels")).where("kept").select("doc_id").distinct())


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of equal texts. Null counts as empty. Rows of one id with different texts stay."""
    kept = exact_dedup.exact_copies(docs).where("kept").select("doc_id", "text_sha256").distinct()
    rows = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return rows.alias("d").join(kept.alias("k"), F.expr("d.doc_id <=> k.doc_id AND d.text_sha256 = k.text_sha256"), "left_semi").dropDuplicates(["doc_id", "text_sha256"]).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each near-duplicate class. Texts without words are in no class and stay.

    Rows of one id stay if one of them does.
    """
    return _of(docs, chosen_path.jaccard_classes(docs).where("doc_id <=> class_id").select("doc_id"))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document holds; n_chars follows the text. Texts of which nothing is left go.

    Rows of one id take the least language of theirs and the least source beside it.
    """
    cut = suffix_dedup.remove_repeats(docs, with_text=True).select("doc_id", F.col("kept_text").alias("text"))
    kept = cut.where(F.trim("text") != "").withColumn("n_chars", F.length("text").cast("long"))
    beside = docs.groupBy("doc_id").agg(F.min(F.struct("lang", "source")).alias("own"))
    return kept.alias("k").join(beside.alias("b"), F.expr("k.doc_id <=> b.doc_id")).select("k.doc_id", "text", "own.*", "n_chars").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens: a row a piece. An empty table gives no rows."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard_join", near_stage),
    ("suffix_array_dedup", repeats_stage),
    ("best_fit_packing", packing_stage),
]

#: The classifier is trained and the joins are repeated until a recall, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each result is written and read again. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
