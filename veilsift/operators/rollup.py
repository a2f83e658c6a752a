"""Roll-ups over boards, benchmark cases and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilsift.operators.reduce import THRESHOLD

BOARD = ("company", "ats", "board")


def board_rollup(scanned: DataFrame, targets: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """A row per board: jobs_scanned, n_hits, n_confirmed, error. Boards that are targets but gave nothing count too."""
    hit = F.col("label").isNotNull()
    out = scanned.groupBy(*BOARD).agg(F.count(F.lit(1)).alias("jobs_scanned"), F.count_if(hit).alias("n_hits"), F.count_if(F.col("label") == "CONFIRMED").alias("n_confirmed"))
    if errors is not None:
        out = out.join(errors.groupBy(*BOARD).agg(F.min("error").alias("error")), [*BOARD], "full")
    else:
        out = out.withColumn("error", F.lit(None).cast("string"))
    if targets is not None:
        out = targets.select(*BOARD).distinct().join(out, [*BOARD], "left")
    return out.na.fill(0, ["jobs_scanned", "n_hits", "n_confirmed"])


def sweep_summary(boards: DataFrame) -> DataFrame:
    """One row: boards targeted, reachable, with hits and confirmed, jobs scanned, names of confirmed companies in order."""
    confirmed = F.col("n_confirmed") > 0
    return boards.agg(
        F.count(F.lit(1)).alias("companies_targeted"),
        F.count_if(F.col("jobs_scanned") > 0).alias("companies_reachable"),
        F.coalesce(F.sum("jobs_scanned"), F.lit(0)).alias("total_jobs_scanned"),
        F.count_if(F.col("n_hits") > 0).alias("companies_with_hits"),
        F.count_if(confirmed).alias("companies_confirmed"),
        F.array_sort(F.collect_list(F.when(confirmed, F.col("company")))).alias("confirmed_companies"),
    )


def sweep_order(boards: DataFrame) -> DataFrame:
    return boards.orderBy(F.col("n_hits").desc(), "company", "ats", "board")


def first_per_board(postings: DataFrame, most: int, *order: str) -> DataFrame:
    """The first `most` postings of each board, by their place in the capture."""
    w = W.partitionBy("ats", "board").orderBy(*order)
    return postings.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def hits(scanned: DataFrame) -> DataFrame:
    """Labelled postings, best first: one flat row each."""
    top = F.col("top_finding")
    rows = scanned.where(F.col("label").isNotNull()).select(
        "company", "ats", "label", "score", "title", top["vector"].alias("vector"), top["confidence"].alias("confidence"), F.left(top["evidence"], F.lit(300)).alias("evidence"), "url"
    )
    return rows.orderBy(F.col("score").desc(), "company", "url", "title")


def is_positive(label: Column, score: Column) -> Column:
    return label.isNotNull() | (score >= THRESHOLD)


def confusion(cases: DataFrame) -> DataFrame:
    """One row of quality metrics for cases with malicious, expected_label, label and score."""
    bad, said = F.col("malicious"), is_positive(F.col("label"), F.col("score"))
    counts = cases.agg(
        F.count_if(said & bad).alias("tp"), F.count_if(said & ~bad).alias("fp"), F.count_if(~said & bad).alias("fn"), F.count_if(~said & ~bad).alias("tn"),
        F.count_if(F.col("label").eqNullSafe(F.col("expected_label"))).alias("exact"), F.count(F.lit(1)).alias("n"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    out = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    p, r = F.col("precision"), F.col("recall")
    out = out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))
    return out.withColumn("label_accuracy", F.col("exact") / F.greatest(F.col("n"), F.lit(1))).drop("exact")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one but not the other, with side: left or right."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
