"""Detectors for images, PDF, DOCX and rendered pages. What Spark and the standard library can't extract comes as
captured columns; where a capture is missing, a status finding says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilsift.functions import kernels
from veilsift.functions import patterns as P
from veilsift.operators.detectors import finding, let, nothing, only_if, strip

# File kinds by extension.
KINDS = {".png": "image", ".jpg": "image", ".jpeg": "image", ".bmp": "image", ".gif": "image", ".webp": "image", ".tiff": "image", ".pdf": "pdf", ".docx": "docx"}


def kind_of(path: Column) -> Column:
    """image, pdf or docx by extension; any other raises."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    lookup = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, ext), F.raise_error(F.concat(F.lit("unsupported file kind: "), path)).cast("string"))


def status(vector: str, text: Column) -> Column:
    return finding(0, vector, text, "informational", "low")


def _or_status(findings: Column, vector: str, text: Column) -> Column:
    return let(lambda x: F.when(F.size(x["f"]) > 0, x["f"]).otherwise(F.array(status(vector, text))), f=findings)


def _one_space(text: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{P._SPACE}]+", " "))


def image_text(plain: Column, contrast: Column) -> Column:
    """Findings from OCR text as is and after stretching contrast: what only the second shows is faint."""
    a, b = _one_space(plain), _one_space(contrast)
    seen, faint = P.is_instruction(a), P.is_instruction(b)
    return F.concat(
        only_if(seen, finding(1, "image_ai_instruction", F.concat(F.lit("[OCR] "), F.left(a, F.lit(200))), "high", "high")),
        only_if(~seen & faint, finding(1, "image_ai_instruction", F.concat(F.lit("[faint/low-contrast OCR] "), F.left(b, F.lit(200))), "critical", "high")),
    )


def image_stego(data: Column, channels: Column) -> Column:
    run = F.try_element_at(F.filter(kernels.low_bit_runs(data, channels), P.is_instruction), F.lit(1))
    return only_if(run.isNotNull(), finding(2, "image_stego", F.concat(F.lit("LSB-decoded printable run (best-effort): "), F.left(run, F.lit(160))), "medium", "low"))


def scan_images(images: DataFrame) -> DataFrame:
    """path and findings of rows of the image source (column image), with ocr_plain and ocr_contrast if captured."""
    has = {"ocr_plain", "ocr_contrast"} <= set(images.columns)
    ocr = [F.col(c) if has else F.lit(None).cast("string") for c in ("ocr_plain", "ocr_contrast")]
    missing = only_if(ocr[0].isNull(), status("dependency_missing", F.lit("no OCR capture: text in the picture was not read")))
    found = F.concat(missing, image_text(*ocr), image_stego(F.col("image.data"), F.col("image.nChannels")))
    clean = _or_status(found, "image_clean", F.concat(F.lit("OCR found no instruction text ("), F.length(_one_space(ocr[0])).cast("string"), F.lit(" chars)")))
    broken = F.col("image.nChannels").isNull() | (F.col("image.nChannels") <= 0)
    return images.select(F.col("image.origin").alias("path"), F.when(broken, F.array(status("image_unreadable", F.lit("not an image that can be decoded")))).otherwise(clean).alias("findings"))


PDF_RUN = "struct<text:string,brightness:double,size:double,x0:double,y0:double,x1:double,y1:double,width:double,height:double>"


def _hidden_run(why: Column, text: Column, kind: str) -> Column:
    evidence = F.concat(F.lit("["), why, F.lit("] "), F.left(text, F.lit(200)))
    said = lambda bad: finding(1, F.when(bad, f"{kind}_hidden_instruction").otherwise(f"{kind}_hidden_text"), evidence, F.when(bad, "critical").otherwise("medium"), F.when(bad, "high").otherwise("medium"))
    return let(lambda x: said(x["bad"]), bad=P.is_instruction(text))


def scan_pdfs(captures: DataFrame) -> DataFrame:
    """path and findings of captured PDFs: runs (PDF_RUN), info (map of strings), error. Without runs and error,
    the capture is missing."""

    def why(r: Column) -> Column:
        size = lambda c: F.coalesce(c, F.lit(0.0))
        w, h = size(r["width"]), size(r["height"])
        off = ((w != 0) & ((r["x1"] < 0) | (r["x0"] > w))) | ((h != 0) & ((r["y1"] < 0) | (r["y0"] > h)))
        tests = [(r["brightness"] >= 0.95, "white"), (F.coalesce(r["size"], F.lit(12.0)) <= 1.0, "tiny"), (off, "offpage")]
        return F.concat_ws(" ", *[F.when(c, F.lit(n)) for c, n in tests])

    # Most runs are seen: the others are told first, and only their texts are stripped.
    told = F.filter(F.transform("runs", lambda r: F.struct(why(r).alias("why"), r["text"].alias("text"))), lambda x: x["why"] != "")
    runs = F.filter(F.transform(told, lambda x: F.struct(x["why"].alias("why"), strip(x["text"]).alias("text"))), lambda x: x["text"] != "")
    entries = F.filter(F.map_entries("info"), lambda e: P.is_instruction(e["value"]))
    meta = F.transform(entries, lambda e: finding(2, "pdf_metadata", F.concat(e["key"], F.lit("="), F.left(e["value"], F.lit(160))), "high", "medium"))
    found = F.concat(F.transform(runs, lambda x: _hidden_run(x["why"], x["text"], "pdf")), F.coalesce(meta, nothing()))
    out = (
        F.when(F.col("error").isNotNull(), F.array(status("pdf_error", F.col("error"))))
        .when(F.col("runs").isNull(), F.array(status("dependency_missing", F.lit("no PDF capture: text was not extracted"))))
        .otherwise(_or_status(found, "pdf_clean", F.lit("no hidden/instruction text found")))
    )
    return captures.select("path", out.alias("findings"))


#: Half-points up to which a run is too small to read.
MOST_TINY = 2


def scan_docx(files: DataFrame) -> DataFrame:
    """path and findings of rows of the binaryFile source."""
    parts = files.select("path", kernels.docx_parts(F.col("content")).alias("d"))
    size = lambda r: F.when(r["size"].rlike(r"^[+-]?[0-9]+\z"), r["size"].cast("decimal(38,0)"))
    why = lambda r: F.when(r["vanish"], "vanish").when(F.lower(r["color"]).isin("ffffff", "white"), "white").when(size(r) <= MOST_TINY, "tiny")
    hidden = F.filter(F.transform("d.runs", lambda r: F.struct(why(r).alias("why"), strip(r["text"]).alias("text"))), lambda x: x["why"].isNotNull() & (x["text"] != ""))
    runs = F.transform(hidden, lambda x: _hidden_run(x["why"], x["text"], "docx"))
    meta = F.transform(F.filter("d.properties", lambda p: P.is_instruction(p["value"])), lambda p: finding(2, "docx_metadata", F.concat(p["name"], F.lit("="), F.left(p["value"], F.lit(160))), "high", "medium"))
    ok = _or_status(F.concat(runs, meta), "docx_clean", F.lit("no hidden/instruction text found"))
    return parts.select("path", F.when(F.col("d.error").isNotNull(), F.array(status("docx_error", F.col("d.error")))).otherwise(ok).alias("findings"))


# ---- rendered pages

RENDERED = "ok boolean, hidden array<struct<reason:string,text:string>>, pseudo array<struct<el:string,pe:string,text:string>>, visible_len int, error string"


def rendered(captures: DataFrame, json_col: str = "capture") -> DataFrame:
    """Render captures, one JSON line each, as columns."""
    return captures.withColumn("_r", F.from_json(json_col, RENDERED)).select(*[c for c in captures.columns if c != json_col], "_r.*")


def hidden_verdict(hidden: Column, pseudo: Column) -> Column:
    """TRIPWIRE where hidden text instructs, HIDDEN_TEXT where there is some, else CLEAN."""
    texts = F.concat(F.transform(F.coalesce(hidden, F.array().cast("array<struct<reason:string,text:string>>")), lambda h: h["text"]), F.transform(F.coalesce(pseudo, F.array().cast("array<struct<el:string,pe:string,text:string>>")), lambda p: p["text"]))
    return F.when(F.exists(texts, P.is_instruction), "TRIPWIRE").when(F.size(texts) > 0, "HIDDEN_TEXT").otherwise("CLEAN")


def _channel(v: Column) -> Column:
    s = v / 255
    return F.when(s <= 0.03928, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def luminance(rgb: Column) -> Column:
    return 0.2126 * _channel(rgb["r"]) + 0.7152 * _channel(rgb["g"]) + 0.0722 * _channel(rgb["b"])


def contrast(fg: Column, bg: Column) -> Column:
    """Contrast of two colours (structs r, g, b), 21 where one is unknown."""
    a, b = luminance(fg), luminance(bg)
    return F.when(fg.isNull() | bg.isNull(), 21.0).otherwise((F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05))


ELEMENT = "struct<tag:string,text:string,display:string,visibility:string,opacity:double,font_size:double,right:double,bottom:double,left:double,w:double,h:double,clipped:boolean,fg:struct<r:double,g:double,b:double,a:double>,backgrounds:array<struct<r:double,g:double,b:double,a:double>>>"


def hidden_reason(e: Column, page_width: Column) -> Column:
    """Why a captured element (ELEMENT) can't be seen; null if it can. backgrounds: its own and its ancestors', nearest first."""
    opaque = F.try_element_at(F.filter(e["backgrounds"], lambda b: b["a"] > 0.5), F.lit(1))
    white = F.struct(*[F.lit(255.0).alias(c) for c in "rgb"], F.lit(1.0).alias("a"))
    ratio = contrast(e["fg"], F.coalesce(opaque, white))
    boxed = (e["w"] > 0) & (e["h"] > 0)
    return (
        F.when(e["display"] == "none", "display:none")
        .when(e["visibility"].isin("hidden", "collapse"), "visibility:hidden")
        .when(e["opacity"] == 0, "opacity:0")
        .when(e["font_size"] == 0, "font-size:0")
        .when(boxed & ((e["right"] < -50) | (e["bottom"] < -50) | (e["left"] > page_width + 50)), "offscreen")
        .when(~boxed & e["clipped"], "clipped-zero")
        .when((e["fg"]["a"] > 0.3) & (ratio < 1.25), F.concat(F.lit("low-contrast("), F.round(ratio, 2).cast("string"), F.lit(")")))
    )


def hidden_elements(elements: Column, page_width: Column) -> Column:
    """(reason, text) of captured elements that can't be seen: texts of six characters or more, each reason and beginning once."""
    cut = F.transform(F.filter(elements, lambda e: ~F.upper(e["tag"]).isin("SCRIPT", "STYLE", "NOSCRIPT")), lambda e: F.struct(hidden_reason(e, page_width).alias("reason"), _one_space(e["text"]).alias("text")))
    kept = F.filter(cut, lambda x: x["reason"].isNotNull() & (F.length(x["text"]) >= 6))
    keys = F.transform(kept, lambda x: F.concat(x["reason"], F.lit("|"), F.left(x["text"], F.lit(120))))
    once = F.filter(kept, lambda x, i: F.array_position(keys, F.concat(x["reason"], F.lit("|"), F.left(x["text"], F.lit(120)))) == i + 1)
    return F.transform(once, lambda x: F.struct(x["reason"].alias("reason"), F.left(x["text"], F.lit(400)).alias("text")))


def pseudo_elements(pseudo: Column) -> Column:
    """(el, pe, text) of captured pseudo-elements (el, pe, content) with more than five characters, each beginning once."""
    bare = F.transform(F.filter(pseudo, lambda p: ~p["content"].isin("none", "normal", '""', "") & (F.length(p["content"]) > 3)), lambda p: F.struct(p["el"].alias("el"), p["pe"].alias("pe"), F.regexp_replace(p["content"], "^[\"']|[\"']$", "").alias("text")))
    kept = F.filter(bare, lambda p: F.length(p["text"]) > 5)
    keys = F.transform(kept, lambda p: F.left(p["text"], F.lit(120)))
    once = F.filter(kept, lambda p, i: F.array_position(keys, F.left(p["text"], F.lit(120))) == i + 1)
    return F.transform(once, lambda p: F.struct(p["el"].alias("el"), p["pe"].alias("pe"), F.left(p["text"], F.lit(400)).alias("text")))
