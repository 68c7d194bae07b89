"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

Each text is cut into chunks at places that its own characters decide, so equal passages give equal
chunks wherever they stand. Chunks are deduplicated; each gets a 64-bit identifier, and identifiers
that two different chunks share are found by comparing the chunks themselves. A text then is its
recipe, the ordered list of verified identifiers, and texts are equal exactly when their recipes are.
Only recipes, not texts, are compared and moved after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pingmill.llm.copies import SALTS, dealt, groups

#: A chunk ends after 64 to 2048 characters where a word of certain last and next letters meets, or
#: after CJK punctuation; else at 2048 characters or the end of the text.
CHUNK = r"(?s).{64,2048}?(?:(?<=[dglmy]\s[aeo])|(?<=[、-〿！-￮]))|.{1,2048}"
#: Shared identifiers up to this number are written into the plan; beyond it recipes hold the chunks.
MAX_LISTED = 1000


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CHUNK), F.lit(0))


def shared_ids(docs: DataFrame, text: str = "text", limit: int = MAX_LISTED + 1) -> list[int]:
    """Identifiers that different chunks share (nearly always none), at most ``limit`` of them."""
    distinct = docs.select(F.explode(chunks(F.col(text))).alias("chunk")).select(F.xxhash64("chunk").alias("id"), "chunk").distinct()
    return [r.id for r in distinct.groupBy("id").count().where("count > 1").select("id").limit(limit).collect()]


def recipe(text: Column, ambiguous: list[int]) -> Column:
    """The ordered list of a text's chunk identifiers; an ambiguous identifier is told apart by its chunk."""
    if not ambiguous:
        return F.transform(chunks(text), lambda c: F.xxhash64(c))
    if len(ambiguous) > MAX_LISTED:
        return chunks(text)
    return F.transform(
        chunks(text),
        lambda c: F.struct(F.xxhash64(c).alias("id"), F.when(F.xxhash64(c).isin(ambiguous), c).otherwise(F.lit("")).alias("own")),
    )


def exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the largest ``doc_id`` stays. A null text counts as empty, and empty texts are equal.
    Rows repeated under one id share its decision and each counts in ``group_size``. A null id never
    stays beside another id. An empty table gives no rows; other columns of ``docs`` are not read.
    """
    ambiguous = shared_ids(docs, text)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        recipe(F.col(text), ambiguous).alias("recipe"),
        F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_sha256"),
    )
    whole = groups(rows, ["recipe"], "doc_id", F.max("doc_id"), salts)
    return dealt(rows, whole, ["recipe"], "doc_id", salts).select(
        "doc_id", "keep_id", F.col("group_size").cast("long"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
