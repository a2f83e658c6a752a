"""Exact duplicates, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same(text: Column) -> Column:
    """The normalisation that changes nothing."""
    return text


def content_hash(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    normalise: Callable[[Column], Column] = same,
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms have the same bytes; null counts as empty. Rows are
    grouped by a 128-bit content hash together with the text itself, so the aggregation's own key
    comparison is the byte check inside each hash group: a collision makes two groups, never one. Copies
    are combined before the shuffle, so a text that holds a third of all rows arrives as one row a task.
    The way back to the rows joins digests only, and being an equi-join of two shuffles Spark may split it
    where one text is hot.

    keep: "largest" or "smallest" id stays. Null ids never stay while the group has another; in a group
    with null ids only, keep_id is null and none is kept. Rows that repeat the kept id with the same
    text are all marked kept. An empty table gives an empty table; other columns of docs are ignored.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep: {keep!r}")
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    best = F.max("_id") if keep == "largest" else F.min("_id")
    groups = (
        rows.groupBy(hash_of(F.col("_text")).alias("_hash"), "_text")
        .agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_hash", F.sha2("_text", 256).alias("_sha"), "keep_id", "group_size")
    )
    digests = rows.select("_id", hash_of(F.col("_text")).alias("_hash"), F.sha2("_text", 256).alias("_sha"))
    return digests.join(groups, ["_hash", "_sha"]).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from veilsift.llm.common import documents

    return exact_groups(documents(spark, sf_dir))


OP4_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       coalesce(doc_id = max(doc_id) OVER (PARTITION BY t), false) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
