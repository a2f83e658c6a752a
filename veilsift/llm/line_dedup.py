"""Repeated runs of lines, by suffix ranks that double in length, and their removal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilsift.llm.common import ddl, discard, documents, materialize, numbered, others, tick, tidy
from veilsift.llm.quality import slices

#: A run of fewer words is no passage; it may come again in any text.
MIN_WORDS = 50

LINES = "_id {id}, _tag long, pos int, line binary, lengths array<int>"


def least_runs(words: np.ndarray, least: int) -> list[list[int]]:
    """For each line of a text, the lengths of the runs that begin there and are the shortest from a line, or up to a
    line, to hold `least` words."""
    total = np.concatenate(([0], np.cumsum(words)))
    n = len(words)
    at = np.arange(n)
    end = np.searchsorted(total, total[:-1] + least)
    begin = np.searchsorted(total, total[1:] - least, "right") - 1
    out: list[set[int]] = [set() for _ in range(n)]
    for i in at[end <= n].tolist():
        out[i].add(int(end[i]) - i)
    for i in at[total[1:] >= least].tolist():
        out[int(begin[i])].add(i + 1 - int(begin[i]))
    return [sorted(x) for x in out]


def _sequence(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                row, pos, line, lengths = [], [], [], []
                for i, text in enumerate(batch.column(2).to_pylist()):
                    if not text or len(text) < 2 * least - 1:
                        continue
                    parts = text.encode("utf-8", "surrogatepass").split(b"\n")
                    counts = [len(p.split()) for p in parts]
                    kept = [k for k, c in enumerate(counts) if c]
                    words = np.array([counts[k] for k in kept], np.int64)
                    if words.sum() < least:
                        continue
                    row += [i] * len(kept)
                    pos += range(len(kept))
                    line += [xxhash.xxh3_128_digest(parts[k]) for k in kept]
                    lengths += least_runs(words, least)
                if row:
                    at = pa.array(row, pa.int64())
                    arrays = [batch.column(0).take(at), batch.column(1).take(at), pa.array(pos, pa.int32()), pa.array(line, pa.binary()), pa.array(lengths, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["_id", "_tag", "pos", "line", "lengths"])

    return run


def repeated_runs(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Later copies of runs of lines: _id, _tag, pos, n (lines). rows: _id, _tag, _text.

    A text is the sequence of its lines that hold words. A place's suffix has, at length h, the rank of its
    first h lines among all; the rank at length 2h is that of the pair of ranks h apart. Each doubling is one
    aggregation to the distinct pairs, a range-partitioned sort of those to number them in order, and a join back. Only
    places whose first h lines come elsewhere too stay, so the tables shrink from the first step on.

    The suffixes that share their first n lines form the LCP interval of depth n. For a run of n lines,
    2^j <= n < 2^(j+1), its interval is told by two ranks of length 2^j that overlap. Looked at are, for
    each line, the shortest run from it, and up to it, that holds min_words words. Their intervals cover every maximal
    repeated run of at least min_words words: a line of such a run lies in a shortest run ahead or behind that
    is inside it. The first occurrence in an interval, by id and place, stays; the others are the result.
    """
    kind = rows.schema["_id"].dataType.simpleString()
    lines = rows.select("_id", "_tag", "_text").mapInArrow(tidy(_sequence(min_words)), LINES.format(id=kind))
    used = [lines := materialize(lines, "lines")]
    alive = lines.select("_id", "_tag", "pos", F.col("line").alias("x"), F.lit(None).cast("long").alias("y"), "lengths")
    later: DataFrame | None = None
    h = 1
    while True:
        pairs = alive.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        ranks = materialize(pairs.orderBy("x", "y").withColumn("rank", F.monotonically_increasing_id()), f"ranks{h}")
        same = (alive["x"] == ranks["x"]) & alive["y"].eqNullSafe(ranks["y"])
        ranked = alive.join(ranks, same).select("_id", "_tag", "pos", "rank", "lengths")
        ranked = materialize(ranked.distinct() if h == 1 else ranked, f"alive{h}")

        # Runs whose interval ranks of this length tell.
        first = ranked.select("_id", "_tag", "pos", F.col("rank").alias("r"), F.explode("lengths").alias("n")).where(F.col("n").between(h, 2 * h - 1))
        last = ranked.select("_id", "_tag", (F.col("pos") + h).alias("end"), F.col("rank").alias("s"))
        both = first.join(last, first["_id"].eqNullSafe(last["_id"]) & (first["_tag"] == last["_tag"]) & (first["pos"] + first["n"] == last["end"]))
        both = both.select(first["_id"], first["_tag"], "pos", "n", "r", "s")
        place = F.struct(F.col("_id").alias("a"), F.col("_tag").alias("b"), F.col("pos").alias("c"))
        intervals = both.groupBy("n", "r", "s").agg(F.min(place).alias("keep"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")
        # A table of its own, so that the join reads two shuffles, of which Spark may split a hot interval's.
        intervals = materialize(intervals, f"intervals{h}")
        copies = materialize(both.join(intervals, ["n", "r", "s"]).where(~place.eqNullSafe(F.col("keep"))).select("_id", "_tag", "pos", "n"), f"copies{h}")
        later = copies if later is None else later.unionByName(copies)
        discard(*used, ranks, intervals)
        used = [ranked]

        longest = ranked.agg(F.max(F.array_max("lengths"))).first()[0]
        if longest is None or longest < 2 * h:
            discard(ranked)
            return later
        ahead = ranked.select(F.col("_id").alias("i"), F.col("_tag").alias("t"), (F.col("pos") - h).alias("p"), F.col("rank").alias("y"))
        alive = ranked.join(ahead, ranked["_id"].eqNullSafe(ahead["i"]) & (ranked["_tag"] == ahead["t"]) & (ranked["pos"] == ahead["p"]))
        alive = alive.select("_id", "_tag", "pos", F.col("rank").alias("x"), "y", "lengths")
        h *= 2


def without_runs(text: str, runs: list[tuple[int, int]]) -> tuple[str, int, int, list[tuple[int, int]]]:
    """A text without runs of its lines: what is left, its lines with words, how many of those went, and the stretches
    of lines (begin, end) that went. Blank lines inside a run go with it."""
    lines = text.split("\n")
    worded = [k for k, line in enumerate(lines) if line.encode("utf-8", "surrogatepass").split()]
    gone = np.zeros(len(lines) + 1, np.int64)
    for pos, n in runs:
        gone[worded[pos]] += 1
        gone[worded[pos + n - 1] + 1] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    stretches = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
    return "\n".join(line for line, g in zip(lines, gone, strict=True) if not g), len(worded), int(gone[worded].sum()) if worded else 0, stretches


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of repeated runs of lines taken out of the text, and n_lines, n_deleted and
    deleted (stretches of lines begin:end of the old text, comma-joined).

    Repeated are runs of whole lines with at least min_words words that come again, in another text or the
    same; the occurrence with the smallest id, and in it the first, stays. Runs may overlap. Lines without
    words are no part of the sequence. Lines are equal if their bytes are; they are told apart by 128-bit hashes.

    Null texts stay null, with no lines. Null ids come before others. Rows equal in id and text are one document
    here and get equal results. An empty table stays empty; columns named like the results, whatever the case, are replaced.
    """
    added = ["n_lines", "n_deleted", "deleted"]
    rest = others(docs, text_col, *added)
    names = [f.name for f in rest]
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_tag"), F.col(text_col).alias("_text"))
    found = repeated_runs(rows, min_words).groupBy("_id", "_tag").agg(F.collect_set(F.struct("pos", "n")).alias("_runs"))
    keyed = docs.select(*numbered(rest), F.col(tick(id_col)).alias("_key"), F.col(tick(text_col)).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    joined = keyed.join(found, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_tag")), "left").drop("_key", "_hash", "_id", "_tag")
    schema = ddl(rest, f"{tick(text_col)} string", "n_lines long", "n_deleted long", "deleted string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                out: list[tuple] = []
                for text, runs in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                    if text is None:
                        out.append((None, 0, 0, ""))
                        continue
                    left, n, gone, stretches = without_runs(text, [(r["pos"], r["n"]) for r in runs or ()])
                    out.append((left, n, gone, ",".join(f"{a}:{b}" for a, b in stretches)))
                arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + arrays, names=[*names, text_col, *added])

    return joined.mapInArrow(tidy(run), schema)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_deleted", "deleted", F.sha2("text", 256).alias("text_sha256"), "text")


OP1_SQL = rf"""
WITH l AS (
  SELECT doc_id, i - 1 AS line, ls[i] AS t, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS u(i)
), s AS (
  SELECT *, row_number() OVER d AS pos, sum(w) OVER d AS total FROM l WHERE w > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY line)
), a AS (
  SELECT doc_id, list(t ORDER BY pos) AS ts, list(total ORDER BY pos) AS cs, list(w ORDER BY pos) AS ws FROM s GROUP BY doc_id
), r AS (
  SELECT doc_id, ts, i AS p, len(list_filter(cs, lambda c: c < cs[i] - ws[i] + {MIN_WORDS})) + 1 AS e FROM a, unnest(range(1, len(ts) + 1)) AS u(i)
  UNION
  SELECT doc_id, ts, len(list_filter(cs, lambda c: c <= cs[i] - {MIN_WORDS})) + 1 AS p, i AS e FROM a, unnest(range(1, len(ts) + 1)) AS u(i) WHERE cs[i] >= {MIN_WORDS}
), k AS (
  SELECT doc_id, p, e, row_number() OVER (PARTITION BY e - p, array_to_string(ts[p:e], chr(10)) ORDER BY doc_id, p) AS turn FROM r WHERE e <= len(ts)
), g AS (
  SELECT DISTINCT k.doc_id, x.line AS first, y.line AS last FROM k JOIN s x ON x.doc_id = k.doc_id AND x.pos = k.p JOIN s y ON y.doc_id = k.doc_id AND y.pos = k.e WHERE turn > 1
), f AS (
  SELECT l.*, EXISTS (SELECT 1 FROM g WHERE g.doc_id = l.doc_id AND l.line BETWEEN g.first AND g.last) AS gone FROM l
), z AS (
  SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island FROM f WHERE gone
), i AS (
  SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS deleted FROM (SELECT doc_id, min(line) AS a, max(line) + 1 AS b FROM z GROUP BY doc_id, island) GROUP BY doc_id
), o AS (
  SELECT doc_id, count(*) FILTER (WHERE w > 0) AS n_lines, count(*) FILTER (WHERE w > 0 AND gone) AS n_deleted, coalesce(string_agg(t, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '') AS text FROM f GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(deleted, '') AS deleted, sha256(o.text) AS text_sha256, o.text
FROM documents d LEFT JOIN o USING (doc_id) LEFT JOIN i USING (doc_id)
"""
