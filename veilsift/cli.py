"""Command line: file, url, live, board, sweep, render, image, pdf, docx, sanitize and legacy."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilsift.operators import legacy, media, report, rewrite, rollup
from veilsift.operators.reduce import reduced, scan, scan_records
from veilsift.sources import boards, files, http, live

FAILED = 3


def code_of(labels: list[str | None]) -> int:
    """2 where something is confirmed, 1 where something should be looked at, else 0."""
    worst = {"CONFIRMED": 2, "TRIPWIRE": 2, "REVIEW": 1, "HIDDEN_TEXT": 1}
    return max([0, *(worst.get(x, 0) for x in labels)])


def _say(scanned: DataFrame, source: str, fmt: str) -> int:
    rows = scanned.collect()
    if fmt == "text":
        print(report.text_report(rows, source))
    else:
        print(report.dumps(scanned.select(F.lit(0).alias("item"), F.lit(source).alias("source"), "findings"), fmt))
    return code_of([r["label"] for r in rows])


def _pages(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    if getattr(a, "url", None):
        asked = spark.createDataFrame([("GET", a.url, None)], http.REQUEST)
        answers = live.ask(asked.withColumn("key", http.key_column()), a.cache, a.rate) if a.cache else http.fetch(asked, rate=a.rate)
        answer = answers.first() or {"status": 0, "text": ""}
        if answer["status"] != 200 or not answer["text"]:
            print(f"{a.url}\n  fetch failed (status={answer['status']})")
            return None
        return spark.createDataFrame([(a.url, answer["text"])], "path string, html string")
    return files.pages(spark, a.path)


def _board(captures: DataFrame, a: argparse.Namespace) -> int:
    if a.ats not in boards.CONNECTORS:
        print(f"board {a.ats}:{a.token}  error: unknown board system")
        return FAILED
    scanned = scan_records(boards.postings(captures, a.ats, a.max_jobs)).persist()
    n, error = scanned.count(), boards.errors(captures).first()
    if error and not n:
        print(f"board {a.ats}:{a.token}  error: {error['error']}")
        return FAILED
    rows = rollup.hits(scanned).collect()
    if a.format == "text":
        print(f"board {a.ats}:{a.token}  jobs_scanned={n}  flagged={len(rows)}")
        for r in rows:
            print(f"  [{r['label']:9} score={r['score']:3}] {r['title'][:60]}", f"      {r['vector']}: {r['evidence'][:120]!r}", *([f"      {r['url']}"] if r["url"] else []), sep="\n")
    else:
        named = F.coalesce(F.nullif("url", F.lit("")), F.nullif("title", F.lit("")), "job_id")
        items = scanned.where("label IS NOT NULL").select(F.struct(-F.col("score"), "job_id").alias("item"), named.alias("source"), F.array("top_finding").alias("findings"))
        print(report.dumps(items, a.format))
    return code_of([r["label"] for r in rows])


def run(spark: SparkSession, argv: list[str]) -> int:
    a = parser().parse_args(argv)
    if a.cmd in ("file", "url"):
        pages = _pages(spark, a)
        return FAILED if pages is None else _say(scan(pages), a.path or a.url, a.format)
    if a.cmd == "sanitize":
        pages = _pages(spark, a)
        if pages is None:
            return FAILED
        row = rewrite.sanitize(pages).first()
        print(f"{a.path or a.url}\n  verdict={row['label'] or 'CLEAN'}  score={row['score']}  removed={len(row['removed'])}")
        print(*(f"    - [{r['reason']}] {r['text'][:120]!r}" for r in row["removed"]), "", row["safe_prompt"], sep="\n")
        return code_of([row["label"]])
    if a.cmd in ("image", "pdf", "docx"):
        if a.cmd == "pdf":
            found = media.scan_pdfs(spark.read.schema(f"path string, runs array<{media.PDF_RUN}>, info map<string,string>, error string").json(a.path))
        else:
            found = media.scan_images(files.images(spark, a.path)) if a.cmd == "image" else media.scan_docx(files.documents(spark, a.path))
        return _say(reduced(found), f"{a.path} [{a.cmd}]", a.format)
    if a.cmd == "render":
        seen = media.rendered(spark.read.text(a.path), "value").withColumn("verdict", media.hidden_verdict(F.col("hidden"), F.col("pseudo")))
        rows = seen.collect()
        print(*(f"{a.path}\n  verdict={r['verdict']}  hidden_nodes={len(r['hidden'] or [])}  pseudo={len(r['pseudo'] or [])}" for r in rows), sep="\n")
        return FAILED if not rows or not all(r["ok"] for r in rows) else code_of([r["verdict"] for r in rows])
    if a.cmd == "legacy":
        row = legacy.legacy_scan(files.responses(spark, a.path)).first()
        print(f"{a.path}\n  risk_score={row['risk_score']}  verdict={row['verdict']}  findings={len(row['findings'])}")
        return 0
    if a.cmd == "live":
        found = live.captures(files.targets(spark, a.targets), a.folder, a.max_jobs, a.rate)
        found.write.mode("overwrite").parquet(f"{a.folder}/captures")
        print(f"{a.folder}/captures  rows={spark.read.parquet(f'{a.folder}/captures').count()}")
        return 0
    captures = spark.read.parquet(a.captures)
    if a.cmd == "board":
        return _board(captures.where((F.col("ats") == a.ats) & (F.col("board") == a.token)), a)
    targets = files.targets(spark, a.targets)
    wanted = captures.join(targets.select("ats", "board"), ["ats", "board"], "left_semi")
    scanned = scan_records(boards.all_postings(wanted, a.max_jobs))
    summary = rollup.board_rollup(scanned, targets, boards.errors(wanted))
    report.write_hits(rollup.hits(scanned), f"{a.out}.csv")
    report.write_sweep(rollup.sweep_order(summary), f"{a.out}.json")
    print(rollup.sweep_summary(summary).first().asDict())
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilsift", description="Hidden instructions in untrusted documents.")
    sub = p.add_subparsers(dest="cmd", required=True)

    def command(name: str, *names: str, fmt: bool = False, rate: float | None = None) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for n in names:
            c.add_argument(n)
        if fmt:
            c.add_argument("--format", choices=("text", *report.FORMATS), default="text")
        if rate:
            c.add_argument("--rate", type=float, default=rate)
        return c

    command("file", "path", fmt=True).set_defaults(url=None)
    url = command("url", "url", fmt=True, rate=2.0)
    url.set_defaults(path=None)
    url.add_argument("--cache")
    lively = command("live", "targets", "folder", rate=1.0)
    lively.add_argument("--max-jobs", type=int, default=boards.DEFAULT_MOST)
    board = command("board", "captures", "ats", "token", fmt=True)
    board.add_argument("--max-jobs", type=int)
    sweep = command("sweep", "captures", "targets")
    sweep.add_argument("--out", required=True)
    sweep.add_argument("--max-jobs", type=int)
    command("render", "path")
    for kind in ("image", "pdf", "docx"):
        command(kind, "path", fmt=True)
    clean = command("sanitize", rate=2.0)
    one = clean.add_mutually_exclusive_group(required=True)
    one.add_argument("--file", dest="path")
    one.add_argument("--url")
    clean.add_argument("--cache")
    command("legacy", "path")
    return p


def main() -> None:
    spark = SparkSession.builder.appName("veilsift").getOrCreate()
    sys.exit(run(spark, sys.argv[1:]))


if __name__ == "__main__":
    main()
