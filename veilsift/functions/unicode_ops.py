"""Invisible and look-alike characters, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points by kind.
ZERO_WIDTH = [0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x180E]
BIDI = [0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069]
TAGS = (0xE0000, 0xE007F)
SELECTORS = [(0xFE00, 0xFE0F), (0xE0100, 0xE01EF)]

# Look-alikes and the letters they pass for.
LOOK_ALIKES = [
    ("аеорсхуіјѕԛԝԁɡһɩɪ", "aeopcxyijsqwdghii"),
    ("АВЕКМНОРСТУХІЈЅΗ", "ABEKMHOPCTYXIJSH"),
    ("ονραικυ", "ovpaiku"),
    ("ΑΒΕΖΙΚΜΝΟΡΤΥΧ", "ABEZIKMNOPTYX"),
    ("ａｏ", "ao"),
]

# Spans of the code points whose names hold the script's name, beside Latin letters of ASCII.
SCRIPTS = {"Arabic": "ARABIC", "Armenian": "ARMENIAN", "Cyrillic": "CYRILLIC", "Greek": "GREEK"}


def _points(spans) -> str:
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ((s, s) if isinstance(s, int) else s for s in spans))


def class_of(*groups) -> str:
    return "[" + "".join(_points(g) for g in groups) + "]"


ZERO_WIDTH_CLASS, BIDI_CLASS, TAG_CLASS, SELECTOR_CLASS = class_of(ZERO_WIDTH), class_of(BIDI), class_of([TAGS]), class_of(SELECTORS)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, class_of(ZERO_WIDTH, BIDI, [TAGS], SELECTORS), "")


def decode_tags(text: Column) -> Column:
    """ASCII smuggled as tag characters, in order, over the whole text."""
    printable = range(0x20, 0x7F)
    kept = F.regexp_replace(text, f"[^{_points([(0xE0020, 0xE007E)])}]", "")
    return F.translate(kept, "".join(chr(0xE0000 + b) for b in printable), "".join(map(chr, printable)))


def decode_selectors(text: Column) -> Column:
    """Bytes smuggled as variation selectors, read as UTF-8 with replacement."""
    kept = F.regexp_replace(text, f"[^{SELECTOR_CLASS[1:-1]}]", "")
    low = F.lit(0xFE00)
    value = lambda c: F.when(_code(c) < 0x10000, _code(c) - low).otherwise(_code(c) - 0xE0100 + 16)
    pairs = F.transform(F.regexp_extract_all(kept, F.lit("(?s)."), 0), lambda c: F.lpad(F.hex(value(c)), 2, "0"))
    return F.decode(F.encode(F.make_valid_utf8(F.unhex(F.array_join(pairs, "")).cast("string")), "UTF-8"), "UTF-8")


def _code(c: Column) -> Column:
    """The code point of a one-character string, from its bytes in UTF-32."""
    return F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int")


def decode_zero_width(text: Column) -> Column:
    """Printable bytes in runs of zero-width spaces (0) and non-joiners (1); anything else ends a run."""
    bits = F.translate(F.regexp_replace(text, "[^​‌]", " "), "​‌", "01")
    runs = F.filter(F.split(bits, " +"), lambda r: F.length(r) >= 8)
    groups = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit("[01]{8}"), 0)))
    codes = F.filter(F.transform(groups, lambda g: F.conv(g, 2, 10).cast("int")), lambda v: (v >= 0x20) & (v < 0x7F))
    return F.array_join(F.transform(codes, lambda v: F.char(v)), "")


def fold_look_alikes(normal: Column) -> Column:
    """Letters that pass for Latin ones, in NFKC text, to those."""
    return F.translate(normal, "".join(a for a, _ in LOOK_ALIKES), "".join(b for _, b in LOOK_ALIKES))


def script_spans() -> dict[str, list[tuple[int, int]]]:
    """Spans of code points by script, from their names."""
    import unicodedata

    out: dict[str, list[tuple[int, int]]] = {}
    for script, word in SCRIPTS.items():
        spans: list[tuple[int, int]] = []
        for p in range(0x80, 0x20000):
            if word in unicodedata.name(chr(p), ""):
                if spans and spans[-1][1] == p - 1:
                    spans[-1] = (spans[-1][0], p)
                else:
                    spans.append((p, p))
        out[script] = spans
    return out


#: From the first sign named Greek on; no invisible character and no letter of the other scripts lies before.
BEYOND_LATIN = r"[\x{342}-\x{10FFFF}]"
UP_TO_LATIN = r"[\x{0}-\x{341}]+"

LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"


def scripts_in(line: Column) -> Column:
    """Names of the scripts in a line, sorted."""
    spans = _spans()
    found = [F.when(line.rlike(class_of(spans[s])), F.lit(s)) for s in sorted(spans)]
    return F.array_compact(F.array(*found, F.when(line.rlike("[A-Za-z]"), F.lit("Latin"))))


def _spans(cache: dict = {}) -> dict[str, list[tuple[int, int]]]:  # noqa: B006
    if not cache:
        cache.update(script_spans())
    return cache
