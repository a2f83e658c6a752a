"""The older scan: three-part findings, a sweep over three channels, and a verdict by risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilsift.functions import patterns as P
from veilsift.functions import unicode_ops as U
from veilsift.operators import detectors as D
from veilsift.operators.reduce import legacy_score, legacy_verdict

# The order of severities in a report.
RANK = {"high": 0, "medium": 1, "low": 2, "informational": 3}


def keyword_sweep(text: Column, channel: str) -> Column:
    return D.phrases(3, f"keyword_{channel}", text, P.KEYWORD_JVM, 30, 30, 200, "medium", "n/a")


def _tokens(tokens: Column) -> Column:
    """Token findings as they are before any upgrade: what hides and instructs is high, not critical."""

    def of(t: Column) -> Column:
        kind, text = t["kind"], t["text"]
        hit = P.is_keyword(text)
        vector = (
            F.when(kind == "comment", "html_comment").when(kind == "form", "hidden_form_field").when(kind == "attribute", F.concat(F.lit("attr_"), t["name"]))
            .when(kind == "linked", "json_ld").when(t["sr"], "sr_only_text").otherwise("css_hidden_text")
        )
        evidence = F.when(kind == "form", F.left(F.concat(t["name"], F.lit("="), text), F.lit(200))).when(kind == "attribute", F.left(text, F.lit(200))).otherwise(F.left(text, F.lit(300)))
        severity = F.when(kind == "attribute", "medium").when((kind != "hidden") | hit, "high").when(t["sr"], "informational").otherwise("medium")
        return F.struct(((kind == "hidden") | hit).alias("counts"), D.finding(1, vector, evidence, severity, "n/a").alias("f"))

    return F.transform(F.filter(F.transform(tokens, of), lambda t: t["counts"]), lambda t: t["f"])


def absent_in_render(source: Column, rendered: Column) -> Column:
    """Instructing segments of what a page says that its rendering doesn't show."""
    shown = F.lower(F.regexp_replace(rendered, rf"[{P._SPACE}]+", " "))
    parts = F.transform(F.split(source, r"[.\n]"), D.strip)
    gone = F.filter(parts, lambda s: (F.length(s) > 20) & ~shown.contains(F.lower(s)) & P.is_keyword(s))
    return F.when(rendered.isNull(), D.nothing()).otherwise(F.transform(gone, lambda s: D.finding(5, "present_in_source_absent_in_render", F.left(s, F.lit(200)), "high", "n/a")))


def linked_pdfs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)href=["']([^"']+\.pdf)["']"""), 1)


def _without_dots(path: Column) -> Column:
    """A path whose . and .. segments are carried out; .. beyond the root is dropped."""
    none = F.array().cast("array<string>")
    step = lambda done, s: F.when(s == ".", done).when((s == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.size(done) - 1)).when(s == "..", done).otherwise(F.concat(done, F.array(s)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(F.substr(path, F.lit(2)), "/", -1), none, step), "/"))


def resolved(url: Column, href: Column) -> Column:
    """Where a link in the page at url leads."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:"
    base = F.regexp_replace(url, r"(?s)[?#].*\z", "")
    origin = F.regexp_extract(base, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*", 0)
    path = F.substr(base, F.length(origin) + 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)^.*/", 0), F.lit("")), F.lit("/"))
    head = F.regexp_extract(href, r"(?s)^[^?#]*", 0)
    tail = F.substr(href, F.length(head) + 1)
    return (
        F.when(href.rlike(scheme), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, scheme, 0), href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(url, r"(?s)#.*\z", ""), href))
        .when(head == "", F.concat(base, href))
        .otherwise(F.concat(origin, _without_dots(F.when(head.startswith("/"), head).otherwise(F.concat(folder, head))), tail))
    )


def pdf_links(pages: DataFrame, *keys: str, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per link to a PDF: the keys, ord (its place in the page) and pdf_url. Pages without url have none."""
    links = pages.select(*keys, F.col(url_col).alias("_url"), F.posexplode(linked_pdfs(F.col(html_col))).alias("ord", "_href"))
    return links.select(*keys, "ord", resolved(F.col("_url"), F.col("_href")).alias("pdf_url")).where("pdf_url IS NOT NULL")


def with_linked_texts(pages: DataFrame, texts: DataFrame, *keys: str, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with pdf_texts: what is captured (pdf_url, text) of the PDF files that each links to, in order; a link that
    comes twice counts twice. keys tell pages apart. Only pages with links meet the captures."""
    found = pdf_links(pages, *keys, url_col=url_col, html_col=html_col).join(texts.select("pdf_url", "text").where("text IS NOT NULL"), "pdf_url")
    listed = found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("pdf_texts"))
    return pages.join(listed, [*keys], "left")


def legacy_scan(df: DataFrame, html_col: str = "html", rendered_col: str | None = None, pdfs_col: str | None = None) -> DataFrame:
    """df with findings in order of severity, risk_score and verdict. Evidence isn't cut a second time here.
    rendered_col: the text of the rendered page; pdfs_col: an array of the texts of linked PDF files. Null is none."""
    page, html = F.col("_page"), F.col("_html")
    folded = U.fold_look_alikes(page["normal"])
    tokens = _tokens(page["tokens"])
    rendered = F.col(rendered_col) if rendered_col else F.lit(None).cast("string")
    pdfs = F.coalesce(F.col(pdfs_col), F.array().cast("array<string>")) if pdfs_col else F.array().cast("array<string>")
    said = F.concat(U.strip_invisible(page["visible"]), F.lit(" "), F.array_join(F.transform(tokens, lambda f: f["evidence"]), " "))
    every = F.concat(
        tokens,
        D.invisible(html),
        keyword_sweep(page["visible"], "visible_text"),
        F.when(folded != page["normal"], keyword_sweep(folded, "homoglyph_folded")).otherwise(D.nothing()),
        absent_in_render(said, rendered),
        F.flatten(F.transform(pdfs, lambda text: keyword_sweep(text, "pdf"))),
    )
    rank = lambda s: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), s), F.lit(4))
    placed = F.transform(every, lambda f, i: F.struct(rank(f["severity"]).alias("rank"), i.alias("i"), f.alias("f")))
    ordered = F.transform(F.array_sort(placed), lambda p: p["f"])
    out = D.with_parsed(df, html_col, ("tokens", "visible", "normal")).withColumn("findings", ordered).withColumn("risk_score", legacy_score(F.col("findings")))
    return out.withColumn("verdict", legacy_verdict(F.col("risk_score"))).drop("_html", "_page")
