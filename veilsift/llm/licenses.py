"""Licence scans by canonical digest, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilsift.llm.common import documents
from veilsift.llm.license_texts import DECLARATIONS, DIGESTS, NAMES, TEXTS

# Spellings that count as one. They are replaced wherever they stand.
EQUIVALENT = [
    ("licence", "license"), ("licencing", "licensing"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("honour", "honor"),
    ("judgement", "judgment"), ("organisation", "organization"), ("authorisation", "authorization"), ("recognise", "recognize"),
    ("whilst", "while"), ("wilful", "willful"), ("fulfil ", "fulfill "), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"),
    ("sub license", "sublicense"), ("copyright owner", "copyright holder"), ("per cent", "percent"), ("http www", "https www"), ("v2 0", "version 2 0"),
]

#: A line that says whose a work is: after comment marks, a copyright word or sign before a year, a sign or a placeholder.
COPYRIGHT_LINE = r"(?m)^[\s*#/;!-]*(?:(?:copyright|copr\.)[ \t]*(?:\(c\)|©|[0-9<\[{])|\(c\)[ \t]|©|all rights reserved).*$"

#: What is neither letter nor digit.
BETWEEN_WORDS = r"[^\p{L}\p{N}]+"


#: Every known canonical form holds one of these (a test looks). Lower-casing makes none of their letters out of another
#: that stays in the word, and spellings are replaced only around them, so a text without any has no known digest.
HINT = r"(?i)licen|permission|permitted|released|distributed"


def canonical(text: Column) -> Column:
    """A text in lower case, without copyright lines, with single spaces for all that lies between words, and one
    spelling for equivalent ones."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), BETWEEN_WORDS, " "), F.lit(" "))
    spelt = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), EQUIVALENT, words)
    return F.trim(F.regexp_replace(spelt, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_texts() -> list[tuple[str, str]]:
    return TEXTS + [(spdx, d.format(name)) for spdx, name in NAMES for d in DECLARATIONS]


def known_digests(spark: SparkSession) -> DataFrame:
    """license and digest of every known text: as many rows as this package lists, whatever the input."""
    rows = F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("text")) for a, b in known_texts()])
    long = F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("_digest")) for a, b in DIGESTS])
    known = spark.range(1).select(F.inline(rows)).select("license", digest(F.col("text")).alias("_digest")).unionByName(spark.range(1).select(F.inline(long)))
    return known.groupBy("_digest").agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, license (of the entire text, else null), notices (licences that entire lines
    declare, in order of name) and n_notices (such lines).

    Texts and lines are brought to one canonical form and joined by its digest to those of known licence texts
    and declarations, a fixed table that is broadcast. Those without a word that some known form must hold are not
    brought there, as they can't match. Lines are looked up before anything is shuffled, so
    only lines that match, and a key for each row, travel.

    Null counts as empty and matches nothing. Rows equal in id and text share their notices, so repeated rows
    are repeated results; null ids stay null. An empty table stays empty; other columns of docs are ignored.
    """
    known = F.broadcast(known_digests(docs.sparkSession))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_tag"))
    told = rows.where(F.col("_text").rlike(HINT)).select("_id", "_tag", F.posexplode(F.split("_text", "\n")).alias("_at", "_line"))
    hits = told.where(F.col("_line").rlike(HINT)).select("_id", "_tag", "_at", digest(F.col("_line")).alias("_digest"))
    hits = hits.join(known, "_digest").groupBy("_id", "_tag").agg(F.count_distinct("_at").alias("n"), F.array_sort(F.collect_set("license")).alias("notices"))
    hits = hits.select(F.col("_id").alias("_i"), F.col("_tag").alias("_t"), "n", "notices")
    whole = rows.select("_id", "_tag", F.when(F.col("_text").rlike(HINT), digest(F.col("_text"))).alias("_digest")).join(known, "_digest", "left").select("_id", "_tag", "license")
    joined = whole.join(hits, whole["_id"].eqNullSafe(hits["_i"]) & (whole["_tag"] == hits["_t"]), "left")
    return joined.select(
        F.col("_id").alias(id_col),
        "license",
        F.coalesce("notices", F.array().cast("array<string>")).alias("notices"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"),
    )


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).withColumn("notices", F.array_join("notices", ","))


def _sql_canonical(text: str) -> str:
    spaced = rf"' ' || regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT_LINE}', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' '"
    spelt = reduce(lambda t, e: f"replace({t}, '{e[0]}', '{e[1]}')", EQUIVALENT, spaced)
    return f"sha256(trim(regexp_replace({spelt}, ' +', ' ', 'g')))"


def _sql_known() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in known_texts())


OP7_SQL = f"""
WITH texts(license, t) AS (VALUES {_sql_known()}),
known AS (SELECT {_sql_canonical("t")} AS d, min(license) AS license FROM texts GROUP BY d),
docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT doc_id, {_sql_canonical("l")} AS d FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM docs)),
hits AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM lines JOIN known USING (d) GROUP BY doc_id)
SELECT docs.doc_id, known.license, coalesce(hits.notices, '') AS notices, coalesce(hits.n, 0)::BIGINT AS n_notices
FROM docs LEFT JOIN known ON known.d = {_sql_canonical("docs.t")} LEFT JOIN hits USING (doc_id)
"""
