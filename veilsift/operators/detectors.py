"""Detectors. Each is a column: an array of findings of one page, in the order they count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilsift.functions import kernels
from veilsift.functions import patterns as P
from veilsift.functions import unicode_ops as U

FINDING = "struct<stage:int,vector:string,evidence:string,severity:string,confidence:string>"

#: Vectors that a page is known by in stage 1, when their text also addresses a machine.
_CONCEALED = ("css_hidden_text", "sr_only_text", "hidden_form_field")


def finding(stage: int, vector, evidence: Column, severity, confidence) -> Column:
    col = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(F.lit(stage).alias("stage"), col(vector).alias("vector"), evidence.alias("evidence"), col(severity).alias("severity"), col(confidence).alias("confidence"))


def nothing() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def only_if(condition: Column, one: Column) -> Column:
    return F.when(condition, F.array(one)).otherwise(nothing())


def strip(text: Column) -> Column:
    """Without white space at both ends, by Unicode."""
    return F.regexp_replace(text, rf"^[{P._SPACE}]+|[{P._SPACE}]+\z", "")


def let(use, **values: Column) -> Column:
    """use(x) where x holds the values by name, each computed once however often use reads it."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), use), F.lit(0))


def snippets(text: Column, pattern: str, before: int, after: int, most: int) -> Column:
    """What surrounds each match, on one line. There are no match offsets: matches and the gaps between them add up to them."""
    size = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda t, x: t + F.length(x))

    def cut(x: Column) -> Column:
        def one(match: Column, i: Column) -> Column:
            start = size(x["g"], i + 1) + size(x["m"], i)
            spot = let(lambda s: F.substring(x["t"], F.greatest(s["at"] - before, F.lit(0)) + 1, s["at"] + F.length(match) + after - F.greatest(s["at"] - before, F.lit(0))), at=start)
            return F.left(strip(F.replace(spot, F.lit("\n"), F.lit(" "))), F.lit(most))

        return F.transform(x["m"], one)

    # The gaps are asked for only where there are matches: each of the two takes a search of the whole text.
    none = F.array().cast("array<string>")
    gaps = lambda x: F.when(F.size(x["m"]) > 0, let(cut, t=x["t"], m=x["m"], g=F.split(x["t"], pattern, -1))).otherwise(none)
    tried = lambda x: let(lambda s: P.may_match(x["t"], s["small"], pattern), small=F.lower(x["t"])) if pattern in P.HELD else F.lit(True)
    return let(lambda x: let(gaps, t=x["t"], m=F.when(tried(x), F.regexp_extract_all(x["t"], F.lit(pattern), 0)).otherwise(none)), t=text)


def from_tokens(tokens: Column) -> Column:
    """Comments, form fields, attributes, linked data and hidden text."""

    def of(t: Column) -> Column:
        kind, text = t["kind"], t["text"]
        hit = P.is_keyword(text)
        vector = (
            F.when(kind == "comment", "html_comment")
            .when(kind == "form", "hidden_form_field")
            .when(kind == "attribute", F.concat(F.lit("attr_"), t["name"]))
            .when(kind == "linked", "json_ld")
            .when(t["sr"], "sr_only_text")
            .otherwise("css_hidden_text")
        )
        evidence = F.when(kind == "form", F.left(F.concat(t["name"], F.lit("="), text), F.lit(200))).when(kind == "attribute", F.left(text, F.lit(200))).otherwise(F.left(text, F.lit(300)))
        severity = F.when(kind == "attribute", "medium").when((kind != "hidden") | hit, "high").when(t["sr"], "informational").otherwise("medium")
        return F.struct(((kind == "hidden") | hit).alias("counts"), vector.alias("vector"), evidence.alias("evidence"), severity.alias("severity"))

    def judged(t: Column) -> Column:
        critical = t["vector"].isin(*_CONCEALED) & P.is_instruction(t["evidence"])
        confidence = F.when(critical | t["vector"].isin("css_hidden_text", "hidden_form_field"), "very_high").otherwise("high")
        return finding(1, F.when(critical, "hidden_ai_instruction").otherwise(t["vector"]), F.left(t["evidence"], F.lit(240)), F.when(critical, "critical").otherwise(t["severity"]), confidence)

    return F.transform(F.filter(F.transform(tokens, of), lambda t: t["counts"]), judged)


def _other_script() -> str:
    """A letter of the other scripts. There are many spans of them, and Latin letters aren't looked for in each."""
    return f"(?={U.BEYOND_LATIN}){U.class_of(*U._spans().values())}"


def mixed_lines(text: Column) -> Column:
    """Lines that hold Latin letters and some of another script; null where a text holds none of those. One class
    stands for all of the other scripts, and it is tried on lines only of texts that it is found in."""
    other = _other_script()
    held = F.when(text.rlike(U.BEYOND_LATIN), F.when(text.rlike(other), text))
    return F.filter(F.split(held, U.LINE_ENDS), lambda x: x.rlike(other) & x.rlike("[A-Za-z]"))


def invisible(html: Column) -> Column:
    """Zero-width, directional, tag and variation characters, and lines that mix scripts."""
    # All of these lie beyond the Latin letters; where only the number or the order counts, what lies there is enough.
    return let(lambda x: F.when(x["beyond"] != "", _invisible(html, x["beyond"])).otherwise(nothing()), beyond=F.regexp_replace(html, U.UP_TO_LATIN, ""))


def _invisible(html: Column, beyond: Column) -> Column:
    n_zero, n_bidi, n_tag, n_selector = (U.count_of(beyond, c) for c in (U.ZERO_WIDTH_CLASS, U.BIDI_CLASS, U.TAG_CLASS, U.SELECTOR_CLASS))
    bits, tags = F.when(n_zero > 0, U.decode_zero_width(html)), F.when(n_tag > 0, U.decode_tags(beyond))
    printable = F.regexp_replace(U.decode_selectors(F.when(n_selector >= 4, beyond)), r"[^\x20-\x7e]", "")
    high_if = lambda c: F.when(c, "high").otherwise("medium")
    quoted = lambda head, n, what, most: F.left(F.concat(n.cast("string") if n is not None else F.lit(""), F.lit(head), F.left(what, F.lit(most)), F.lit("'")), F.lit(200))
    mixed = F.when(beyond.rlike(_other_script()), mixed_lines(html))
    scripts = lambda line: F.array_join(F.transform(U.scripts_in(line), lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", ")
    return F.concat(
        only_if(n_zero > 0, finding(2, "zero_width", quoted(" zero-width chars; decoded='", n_zero, bits, 120), high_if(P.is_keyword(bits)), "very_high")),
        only_if(n_bidi > 0, finding(2, "bidi_control", F.concat(n_bidi.cast("string"), F.lit(" bidi control chars present")), "high", "high")),
        only_if(n_tag > 0, finding(2, "unicode_tag_block", quoted("decoded='", None, tags, 200), high_if(tags != ""), "very_high")),
        only_if(
            F.coalesce((n_selector >= 4) & (F.length(printable) >= 4), F.lit(False)),
            finding(2, "variation_selector", quoted(" variation selectors; decoded='", n_selector, printable, 160), high_if(P.is_keyword(printable)), "high"),
        ),
        F.coalesce(
            F.transform(
                F.slice(mixed, 1, 1),
                lambda line: finding(2, "mixed_script", F.left(F.concat(F.lit("scripts=["), scripts(line), F.lit("] line='"), F.left(strip(line), F.lit(80)), F.lit("'")), F.lit(200)), "medium", "high"),
            ),
            nothing(),
        ),
    )


def phrases(stage: int, vector: str, text: Column, pattern: str, before: int, after: int, most: int, severity: str, confidence: str) -> Column:
    return F.transform(snippets(text, pattern, before, after, most), lambda s: finding(stage, vector, s, severity, confidence))


STYLE_BLOCK = r"(?is)<style[^>]*>(.*?)</style>"
QUOTED_CONTENT = r"(?s)content[\s\x0B\x1C-\x1F\x85\p{Z}]*:[\s\x0B\x1C-\x1F\x85\p{Z}]*(['\"])(.*?)\1"


def pseudo_content(html: Column) -> Column:
    texts = F.flatten(F.transform(F.regexp_extract_all(html, F.lit(STYLE_BLOCK), 1), lambda s: F.regexp_extract_all(s, F.lit(QUOTED_CONTENT), 2)))
    hits = F.filter(texts, lambda t: (F.length(t) > 8) & P.is_instruction(t))
    return F.transform(hits, lambda t: finding(5, "css_pseudo_content", F.left(t, F.lit(200)), "high", "high"))


def listed(stage: int, vector: str, texts: Column, severity: str, confidence: str) -> Column:
    """Findings for those of an array of texts that instruct."""
    return F.transform(F.filter(texts, P.is_instruction), lambda t: finding(stage, vector, F.left(t, F.lit(200)), severity, confidence))


def _readable(raw: Column) -> Column:
    """Bytes as text if they are UTF-8, longer than six characters and over 85% printable."""
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    shown = U.count_of(text, r"[^\p{C}\p{Z}]|\x20")
    return F.when((F.length(text) > 6) & (shown / F.greatest(F.length(text), F.lit(1)) > 0.85), text)


def from_base64(text: Column) -> Column:
    body = F.regexp_replace(text, "=+$", "")
    whole = F.length(body) - F.when(F.length(body) % 4 == 1, F.length(body) + 1).otherwise(0)
    padded = F.rpad(body, ((F.length(body) + 3) / 4).cast("int") * 4, "=")
    return F.when(whole > 0, _readable(F.try_to_binary(padded, F.lit("base64"))))


def from_hex(text: Column) -> Column:
    return _readable(F.try_to_binary(text, F.lit("hex")))


def encoded(vector: str, text: Column, pattern: str, decode, run: str) -> Column:
    """run: what any match begins with; without a test for a word's bounds it is found sooner."""
    found = F.when(text.rlike(run), F.regexp_extract_all(text, F.lit(pattern), 1)).otherwise(F.array().cast("array<string>"))
    both = F.transform(found, lambda m: F.struct(m.alias("m"), decode(m).alias("d")))
    hits = F.filter(both, lambda b: F.coalesce(P.is_instruction(b["d"]), F.lit(False)))
    return F.transform(hits, lambda b: finding(7, vector, F.concat(F.left(b["m"], F.lit(24)), F.lit("... -> "), F.left(b["d"], F.lit(120))), "high", "high"))


#: What the detectors read of a page.
READ = ("tokens", "visible", "plain", "unescaped", "normal", "linked", "metas")


def with_parsed(df: DataFrame, html_col: str = "html", fields: tuple[str, ...] = READ) -> DataFrame:
    """df with _page: of what parsing, entities, normal form and JSON give, the fields, from one pass of the kernel."""
    return df.withColumn("_html", F.coalesce(F.col(html_col), F.lit(""))).withColumn("_page", kernels.parsed(F.col("_html"), *fields))


def stages(html: Column, page: Column) -> list[Column]:
    """All detectors of a page, in the order in which their findings count."""
    plain, visible = page["plain"], page["visible"]
    read = F.when(visible.rlike(f"[^{P._SPACE}]"), visible).otherwise(plain)
    folded = U.fold_look_alikes(page["normal"])
    return [
        from_tokens(page["tokens"]),
        invisible(html),
        phrases(3, "semantic_instruction", read, P.SEMANTIC_JVM, 50, 70, 240, "medium", "low"),
        phrases(4, "keyword", plain, P.KEYWORD_JVM, 30, 30, 200, "low", "low"),
        pseudo_content(html),
        listed(6, "meta_tag", page["metas"], "medium", "medium"),
        encoded("base64_payload", html, P.jvm(P.BASE64, ignore_case=False), from_base64, "[A-Za-z0-9+/]{24}"),
        encoded("hex_payload", plain, P.jvm(P.HEX_PAIRS, ignore_case=False), from_hex, "[0-9a-fA-F]{24}"),
        let(lambda x: F.when(x["f"] != page["unescaped"], phrases(8, "homoglyph_keyword", x["f"], P.KEYWORD_JVM, 30, 30, 200, "medium", "medium")).otherwise(nothing()), f=folded),
        listed(9, "json_ld", page["linked"], "high", "high"),
    ]


def detect(df: DataFrame, html_col: str = "html") -> DataFrame:
    """df with findings: an array of (stage, vector, evidence, severity, confidence) in the order in which they count.

    One scan, one kernel pass, no shuffle. Null pages have no findings.
    """
    drop = ["_html", "_page"]
    return with_parsed(df, html_col).withColumn("findings", F.concat(*stages(F.col("_html"), F.col("_page")))).drop(*drop)


def exploded(df: DataFrame, *keys: str) -> DataFrame:
    """A row per finding with its place among its page's."""
    # The outer form, as below the other one Spark puts a filter on the array, and so computes all detectors twice.
    return df.select(*keys, F.posexplode_outer("findings").alias("ord", "f")).where("ord IS NOT NULL").select(*keys, "ord", "f.*")

