"""Reports: flat JSON, SARIF 2.1.0, CSV of hits, text and markdown."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilsift.operators.detectors import exploded

TOOL, VERSION = "veilsift", "0.1.0"

# The standard's schema, levels by severity, and the category that all rules are of.
SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "informational": "note"}
CATEGORY = {"owasp": "LLM01:2025", "category": "prompt-injection"}
HELP = "https://genai.owasp.org/llmrisk/llm01-prompt-injection/"

FORMATS = ("json", "sarif")


def level(severity: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), severity), F.lit("warning"))


def result_rows(items: DataFrame) -> DataFrame:
    """A SARIF result per finding, as JSON, in order: item, ord, vector, result. items: item (a number that orders
    them), source and findings."""
    rows = exploded(items, "item", "source").select("item", "source", "ord", F.struct("vector", "evidence", "severity", "confidence").alias("f"))
    place = F.array(F.struct(F.struct(F.struct(F.col("source").alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    result = F.struct(
        F.concat(F.lit(f"{TOOL}/"), F.col("f.vector")).alias("ruleId"),
        level(F.col("f.severity")).alias("level"),
        F.struct(F.concat(F.col("f.vector"), F.lit(": "), F.col("f.evidence")).alias("text")).alias("message"),
        place.alias("locations"),
        F.struct(F.col("f.severity").alias("severity"), F.coalesce("f.confidence", F.lit("n/a")).alias("confidence")).alias("properties"),
    )
    return rows.select("item", "ord", F.col("f.vector").alias("vector"), F.to_json(result).alias("result"))


def rules(items: DataFrame) -> DataFrame:
    """Each vector once, by where it first comes, with how many findings it has."""
    first = result_rows(items).groupBy("vector").agg(F.min(F.struct("item", "ord")).alias("first"), F.count(F.lit(1)).alias("n_results"))
    return first.select("vector", F.concat(F.lit(f"{TOOL}/"), "vector").alias("rule_id"), "first", "n_results")


def to_sarif(items: DataFrame) -> str:
    """A SARIF document of a report's items."""
    listed = [
        {"id": r["rule_id"], "name": r["vector"], "shortDescription": {"text": f"Hidden-instruction vector: {r['vector']}"}, "helpUri": HELP, "properties": {**CATEGORY, "vector": r["vector"]}}
        for r in rules(items).orderBy("first").collect()
    ]
    results = [json.loads(r["result"]) for r in result_rows(items).orderBy("item", "ord").toLocalIterator()]
    run = {"tool": {"driver": {"name": TOOL, "version": VERSION, "rules": listed}}, "results": results}
    return json.dumps({"$schema": SCHEMA, "version": "2.1.0", "runs": [run]}, indent=2, ensure_ascii=False)


def item_rows(items: DataFrame) -> DataFrame:
    """Each item as JSON: source and its findings."""
    plain = F.transform("findings", lambda f: F.struct(f["vector"].alias("vector"), f["evidence"].alias("evidence"), f["severity"].alias("severity"), f["confidence"].alias("confidence")))
    return items.select("item", F.to_json(F.struct("source", plain.alias("findings")), {"ignoreNullFields": "false"}).alias("json"))


def to_json(items: DataFrame) -> str:
    rows = [json.loads(r["json"]) for r in item_rows(items).orderBy("item").toLocalIterator()]
    return json.dumps({"tool": TOOL, "version": VERSION, "items": rows}, indent=2, ensure_ascii=False)


def dumps(items: DataFrame, fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    return to_sarif(items) if fmt == "sarif" else to_json(items)


def write_hits(hits: DataFrame, path: str) -> None:
    hits.write.mode("overwrite").option("header", True).csv(path)


def write_sweep(boards: DataFrame, path: str) -> None:
    boards.write.mode("overwrite").json(path)


def text_report(rows: list, source: str) -> str:
    """What a terminal shows for one scanned document, given its reduced row."""
    r = rows[0]
    out = [source, f"  score={r['score']}  label={r['label'] or 'CLEAN'}  findings={r['n_findings']}"]
    if top := r["top_finding"]:
        out += [f"  top: vector={top['vector']} severity={top['severity']} confidence={top['confidence']}", f"       evidence={top['evidence'][:160]!r}"]
    return "\n".join(out)


def markdown(metrics: dict, cases: list[dict]) -> str:
    """Quality metrics and a table of cases."""
    m = metrics
    head = [f"- **{n.title()}:** {m[n]:.3f}" for n in ("precision", "recall", "f1")]
    head += [f"- Confusion: TP={m['tp']} FP={m['fp']} FN={m['fn']} TN={m['tn']} (n={m['n']})", f"- **Label exactness:** {m['label_accuracy']:.3f}"]
    table = ["| id | vector | malicious | expected | label | score |", "|---|---|---|---|---|---:|"]
    table += [f"| {c['id']} | {c['vector']} | {c['malicious']} | {c['expected_label']} | {c['label']} | {c['score']} |" for c in cases]
    return "\n".join(["# Benchmark results", "", *head, "", *table, ""])
