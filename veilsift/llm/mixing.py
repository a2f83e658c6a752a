"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilsift.llm.common import documents, others, shared_dir, tick, unused, word_count

#: Beyond this many sources their rates are joined by shuffle, not broadcast. A row takes about 50 bytes.
MOST_BROADCAST_SOURCES = 20_000


#: Columns that a plan adds.
PLAN = ("_size", "_source_size", "_target", "_copies")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Targets of sources. sizes: a row per source with source and source_size.

    Sources by code point, null last, take the weights in turn; together they share the sum of all
    sizes. A target stops at `most` times its source's size and what is left over is shared by weight
    among the others until no target is above its bound. That fixed point has a closed form: in order of
    bound per weight, the sources that stop are a prefix, and the first prefix after which the common level
    reaches no further bound is the right one. A row per source is all that the two running sums read.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    every = W.partitionBy(F.lit(0))
    order = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    levels = (
        weighed.withColumn("_left", F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_weights"))
    )
    fits = F.col("_level") * F.col("_w") <= F.col("_cap")
    level = F.min(F.when(fits, F.struct(F.col("_cap") / F.col("_w"), F.col("_level")))).over(every)["_level"]
    return levels.withColumn("_final", level).select(
        "source", "source_size", F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least(F.col("_final") * F.col("_w"), F.col("_cap"))).alias("target")
    )


def uniform(id_col: Column, seed: str) -> Column:
    """A number in [0, 1) from the id alone: 52 bits of a hash, so that reruns and retries agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    most: float = 3.0,
    seed: str = "mix-1",
) -> DataFrame:
    """docs with _size, _source_size, _target and _copies: how often the mix repeats each row.

    The rate of a source is its target over its size. A row is repeated floor(rate) times, plus once
    more where a number hashed from its id falls below the rate's fraction. Sizes are summed before the
    shuffle, so a source with a third of all rows is one row a task. The rates, a row per source, are
    checkpointed and counted; up to MOST_BROADCAST_SOURCES they are broadcast, and beyond that joined by a
    shuffle that Spark may split where a source is hot.

    Null text has size 0, null source is a source of its own, rows of size 0 follow the rate like
    others (0 if the whole source is empty). Rows with equal ids share one draw, so repeated rows are
    repeated alike. Columns of docs named like the four, whatever the case, are replaced.
    """
    kept = [f.name for f in others(docs, *PLAN)]
    sized = docs.select(*[F.col(tick(c)) for c in kept], word_count(F.col(tick(text_col))).alias("_size"))
    sizes = sized.groupBy(F.col(tick(source_col)).alias("source")).agg(F.sum("_size").alias("source_size"))
    shared_dir(docs.sparkSession)
    rates = source_targets(sizes, weights, most).checkpoint()
    if rates.count() <= MOST_BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    (source,) = unused(sized.columns, "_source")
    rates = rates.select(F.col("source").alias(source), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    joined = sized.join(rates, sized[tick(source_col)].eqNullSafe(rates[source])).drop(source)
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (uniform(F.col(id_col), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("_copies", copies)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: the rows of docs, each as often as mix_plan says, with all columns, whatever their names."""
    hidden = {c: unused([*docs.columns, *PLAN], c)[0] for c in docs.columns if c.lower() in PLAN}
    planned = mix_plan(docs.withColumnsRenamed(hidden), **options)
    (copy,) = unused(planned.columns, "_copy")
    copied = planned.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))))
    return copied.select(*[F.col(tick(hidden.get(c, c))).alias(c) for c in docs.columns])


def op3_mix(spark, sf_dir: str) -> DataFrame:
    planned = mix_plan(documents(spark, sf_dir))
    return planned.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
    )


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sized GROUP BY source
), bounds AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap FROM sources
), steps AS (
  SELECT a.source, any_value(a.cap / a.w) AS ratio,
         ((SELECT sum(source_size) FROM bounds)::DOUBLE - coalesce(sum(b.cap), 0)) / ((SELECT sum(w) FROM bounds) - coalesce(sum(b.w), 0)) AS level,
         any_value(a.w) AS w, any_value(a.cap) AS cap
  FROM bounds a LEFT JOIN bounds b ON b.cap / b.w < a.cap / a.w OR (b.cap / b.w = a.cap / a.w AND b.source < a.source)
  GROUP BY a.source
), chosen AS (
  SELECT level FROM steps WHERE level * w <= cap ORDER BY ratio, level LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN (SELECT count(*) FROM chosen) = 0 THEN cap ELSE least((SELECT level FROM chosen) * w, cap) END AS target FROM bounds
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""
