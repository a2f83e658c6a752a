"""From findings to a score, a label and a top finding: per page, without shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilsift.functions import patterns as P
from veilsift.operators.detectors import FINDING, detect, let

# Points by severity; anything else counts as UNKNOWN.
POINTS = {"informational": 5, "low": 15, "medium": 45, "high": 80, "critical": 95}
UNKNOWN = 30
BONUS, LEGACY_BONUS = 10, 15

# Vectors that confirm at high or critical, that are worth a review, and that are if they read like instructions.
STRONG = (
    "hidden_ai_instruction", "css_pseudo_content", "base64_payload", "hex_payload", "unicode_tag_block", "zero_width", "json_ld", "css_hidden_text",
    "image_ai_instruction", "pdf_hidden_instruction", "docx_hidden_instruction", "variation_selector",
)
REVIEW = ("image_stego", "ingestion_diff")
SEMANTIC = ("semantic_instruction", "meta_tag", "homoglyph_keyword")

#: The score from which a page counts as detected, labelled or not, and those of the older verdict.
THRESHOLD = 40
LEGACY_BLOCK, LEGACY_REVIEW = 80, 40


#: Columns that a reduction gives.
REDUCED = ("findings", "score", "top_finding", "label", "n_findings")


def points(severity: Column, scale: dict[str, int] = POINTS) -> Column:
    out = F.when(severity.isNull(), UNKNOWN)
    for name, value in scale.items():
        out = out.when(severity == name, value)
    return out.otherwise(UNKNOWN)


def _score(findings: Column, scale: dict[str, int], weighty: tuple[str, ...], bonus: int, least: int) -> Column:
    top = F.array_max(F.transform(findings, lambda f: points(f["severity"], scale)))
    kinds = F.array_distinct(F.transform(F.filter(findings, lambda f: f["severity"].isin(*weighty)), lambda f: F.left(f["evidence"], F.lit(40))))
    more = (F.size(kinds) > 1) & (F.size(findings) >= least)
    return F.when(F.size(findings) > 0, F.least(F.lit(100), top + F.when(more, bonus).otherwise(0))).otherwise(0)


def score(findings: Column) -> Column:
    """The highest severity's points, and a bonus where findings of weight differ in evidence."""
    return _score(findings, POINTS, ("medium", "high", "critical"), BONUS, 1)


def legacy_score(findings: Column) -> Column:
    return _score(findings, {k: v for k, v in POINTS.items() if k != "critical"}, ("medium", "high"), LEGACY_BONUS, 2)


def legacy_verdict(risk: Column) -> Column:
    return F.when(risk >= LEGACY_BLOCK, "BLOCK").when(risk >= LEGACY_REVIEW, "REVIEW").otherwise("OK")


def _first(findings: Column, test) -> Column:
    return F.try_element_at(F.filter(findings, test), F.lit(1))


def top_finding(findings: Column) -> Column:
    """The finding that decides the label; null where there is none."""
    confirmed = _first(findings, lambda f: f["vector"].isin(*STRONG) & f["severity"].isin("high", "critical"))
    review = _first(findings, lambda f: f["vector"].isin(*REVIEW))
    worded = _first(findings, lambda f: f["vector"].isin(*SEMANTIC) & f["evidence"].rlike(P.jvm(P.REVIEWABLE)))
    return F.coalesce(confirmed, review, worded)


def label(top: Column) -> Column:
    confirmed = top["vector"].isin(*STRONG) & top["severity"].isin("high", "critical")
    return F.when(top.isNull(), F.lit(None).cast("string")).when(confirmed, "CONFIRMED").otherwise("REVIEW")


def exit_code(label_: Column) -> Column:
    return F.when(label_.isin("CONFIRMED", "TRIPWIRE"), 2).when(label_.isin("REVIEW", "HIDDEN_TEXT"), 1).otherwise(0)


def reduced(df: DataFrame, findings: Column | None = None) -> DataFrame:
    """df with score, label, top_finding and n_findings for its findings: those of its column, or others that
    become it. They are bound once, as every use of an expression is a copy of it."""
    bound = let(lambda x: F.struct(x["f"].alias("findings"), score(x["f"]).alias("score"), top_finding(x["f"]).alias("top_finding"), F.size(x["f"]).alias("n_findings")), f=F.col("findings") if findings is None else findings)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in REDUCED]
    out = df.select(*kept, let(lambda x: F.struct(x["r"], label(x["r"]["top_finding"]).alias("label")), r=bound).alias("_reduced"))
    return out.select(*kept, "_reduced.r.findings", "_reduced.r.score", "_reduced.r.top_finding", "_reduced.label", "_reduced.r.n_findings")


def scan(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Pages with findings, score, label, top_finding and n_findings."""
    return reduced(detect(df, html_col))


def scan_records(postings: DataFrame) -> DataFrame:
    """Postings without their bodies, with what scanning these gave."""
    return scan(postings, "jd_html").drop("jd_html", "findings")


def regrouped(rows: DataFrame, *keys: str) -> DataFrame:
    """A row per key with its findings in order, from a row per finding with stage and ord."""
    fields = [f.split(":")[0] for f in FINDING[len("struct<") : -1].split(",")]
    each = F.struct("stage", "ord", *[f for f in fields if f != "stage"])
    listed = F.transform(F.array_sort(F.collect_list(each)), lambda f: F.struct(*[f[x].alias(x) for x in fields]))
    return rows.groupBy(*keys).agg(listed.alias("findings"))
