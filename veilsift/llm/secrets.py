"""Secret scans: fixed patterns, and assignments read as source or configuration."""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilsift.llm.common import ddl, documents, numbered, others, tick
from veilsift.llm.quality import slices

# The base patterns and the length that a match needs.
KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

#: Words inside a target's name and what they add to a literal's score.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "apikey": 3, "token": 2, "credential": 2, "credentials": 2,
    "privatekey": 3, "accesskey": 3, "authkey": 3, "auth": 1, "bearer": 2, "key": 1, "private": 1, "api": 1, "access": 1, "signing": 1, "client": 0,
}
#: Values that stand for a secret without being one.
PLACEHOLDERS = {"changeme", "example", "placeholder", "password", "none", "null", "true", "false", "undefined", "redacted", "todo"}
NO_SECRET = (b"http://", b"https://", b"${", b"{{", b"<", b"%(")
#: Lower and upper case, digits, anything else.
KINDS_OF_BYTES = [range(97, 123), range(65, 91), range(48, 58), [b for b in range(256) if not chr(b).isalnum() or b > 127]]
#: The score from which a literal is reported.
LEAST_SCORE = 4.0

#: A document without any of these, in lower case and without what may part words of a name, holds no sensitive name.
HINTS = [w.encode() for w, n in SENSITIVE.items() if n and not any(v in w and v != w for v, m in SENSITIVE.items() if m)]
PARTING = b"_$. -"

#: First words of statements in which a colon ends no target: what follows is a statement or a value of its own.
CONTROL = {b"if", b"elif", b"else", b"while", b"for", b"case", b"default", b"with", b"try", b"except", b"finally", b"lambda"}
#: Words before the name of a type, and types that no literal is ever given to.
MODIFIERS = {b"mut", b"const", b"dyn", b"readonly", b"unsigned", b"typeof", b"keyof", b"static", b"final"}
PRIMITIVE = {b"string", b"str", b"String", b"char", b"bytes", b"object", b"any", b"Any"}

LEXEME = re.compile(
    rb"""(?P<lifetime>&'[a-z_][a-z0-9_]*\x20+(?:mut\x20+)?(?=str\b|String\b|\[))
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)
    |(?P<name>[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z_$][A-Za-z0-9_$]*)*)
    |(?P<number>[0-9][A-Za-z0-9+/_.=-]*)
    |(?P<assign>:=|=>|==|[=:])
    |(?P<plus>\+)
    |(?P<end>[\n;,{}()\[\]])
    |(?P<space>[\x20\t\r]+)
    |(?P<other>\\.|.)""",
    re.VERBOSE | re.DOTALL,
)
BARE = re.compile(rb"[A-Za-z0-9+/_.~!@$%^&*-]+={0,2}")


class Tokens:
    """The lexemes of a text but for white space, as (kind, start, end): 17 bytes each, however long the text."""

    NAMES = [None, *sorted(LEXEME.groupindex, key=LEXEME.groupindex.__getitem__)]

    def __init__(self, raw: bytes):
        self.kind, self.starts, self.ends = bytearray(), array("q"), array("q")
        space = LEXEME.groupindex["space"]
        for m in LEXEME.finditer(raw):
            if m.lastindex != space:
                self.kind.append(m.lastindex)
                self.starts.append(m.start())
                self.ends.append(m.end())

    def __len__(self) -> int:
        return len(self.kind)

    def __getitem__(self, i: int) -> tuple[str, int, int]:
        return self.NAMES[self.kind[i]], self.starts[i], self.ends[i]


class Value:
    """What a name stands for: one literal of the text, or pieces joined. Names share the pieces they have in common, so
    a text's values take as much room as its tokens, and a join of joins counts bytes without being written out."""

    __slots__ = ("span", "pieces", "facts")

    def __init__(self, span: tuple[int, int] | None, pieces: tuple[Value, ...] = ()):
        self.span, self.pieces, self.facts = span, pieces, None


#: As much of a value's beginning as tells a placeholder or an address.
HEAD = 16


def facts_of(value: Value, raw: bytes) -> tuple[Counter, bytes, bool]:
    """How often a value has each byte, how it begins and whether it holds white space; each piece is looked at once."""
    stack = [value]
    while stack:
        v = stack[-1]
        if v.facts is None and (waiting := [p for p in v.pieces if p.facts is None]):
            stack += waiting
            continue
        stack.pop()
        if v.facts is None and v.span:
            text = raw[v.span[0] : v.span[1]]
            v.facts = Counter(text), text[:HEAD], re.search(r"\s", text.decode("utf-8", "replace")) is not None
        elif v.facts is None:
            counts, head = Counter(), b""
            for p in v.pieces:
                counts.update(p.facts[0])
                head += p.facts[1] if len(head) < HEAD else b""
            v.facts = counts, head[:HEAD], any(p.facts[2] for p in v.pieces)
    return value.facts


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes. Every pattern and every match is ASCII."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(raw) if len(m[2]) >= LEAST_ASSIGN]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(raw)]
    return out


def name_score(name: bytes) -> int:
    """What the words of a target's name add up to: snake, kebab, dotted and camel case are told apart."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name.decode())]
    both = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return sum(SENSITIVE.get(p, 0) for p in parts) + sum(SENSITIVE.get(p, 0) for p in both)


def literal_score(counts: Counter, head: bytes, spaced: bool) -> float:
    """How much a value looks like a secret: length, kinds of characters, entropy a byte."""
    size = sum(counts.values())
    if size < 8 or size <= HEAD and head.decode("utf-8", "replace").lower() in PLACEHOLDERS or len(counts) < 5 or spaced or head.startswith(NO_SECRET):
        return -math.inf
    kinds = sum(any(b in counts for b in kind) for kind in KINDS_OF_BYTES)
    if kinds < 2:
        return -math.inf
    entropy = -sum(c / size * math.log2(c / size) for c in counts.values())
    return 0.5 * (size >= 16) + 0.5 * kinds + (entropy >= 3.0) * 0.5


def declared_value(raw: bytes, tokens: Tokens, j: int) -> int | None:
    """Where the value begins if a type expression and = stand from token j on, as in name: Optional[str] = "...".

    Types are names, joined by the marks of unions, references and paths, with anything in brackets but braces
    and colons. Each token is looked at once over all calls: no expression goes beyond a colon.
    """
    depth, before = 0, b""
    while j < len(tokens):
        kind, a, b = tokens[j]
        text = raw[a:b]
        if text == b":" and j + 2 < len(tokens) and raw[tokens[j + 1][1] : tokens[j + 1][2]] == b":" and before[:1].isalpha():
            j, before = j + 2, b"::"
            continue
        if text in (b":", b"{", b"}"):
            return None
        if text in (b"[", b"(", b"<"):
            depth += 1
        elif text in (b"]", b")", b">"):
            if not depth:
                return None
            depth -= 1
        elif not depth:
            if text == b"=":
                return j + 1 if before else None
            if kind == "name" and (before[:1].isalpha() or before[:1] in (b"_", b"$")) and before not in MODIFIERS:
                return None
            if kind not in ("name", "string", "lifetime") and text not in (b"|", b"&", b"?", b"!", b"*", b"=>"):
                return None
        j, before = j + 1, text
    return None


def lexed_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """Literals given to sensitive names, as (start, end, kind) in bytes, each literal once.

    The text is cut into strings, names, operators and ends of statements. A name followed by = or : (after
    an optional closing quote, as in JSON) and a literal is a pair; a name on the right stands for the
    literal it was last given, through any number of steps, and pieces joined by + for all of theirs. A
    string may be the name where : follows it. The work grows with the text, whatever it holds. Where : is followed by a type and =, the name before : is also
    the target of the quoted literal, number or known name after =.
    """
    tokens = Tokens(raw)
    known: dict[bytes, Value] = {}
    secret: list[Value] = []
    n = len(tokens)

    def value_at(j: int, bare: bool) -> Value | None:
        pieces: list[Value] = []
        while j < n:
            k, a, b = tokens[j]
            if k == "string":
                pieces.append(Value((a + 1, b - 1)))
            elif k == "name" and raw[a:b] in known:
                pieces.append(known[raw[a:b]])
            elif not pieces and (k == "number" or k == "name" and bare):
                m = BARE.match(raw, a)
                b = m.end() if m else b
                pieces.append(Value((a, b)))
                j = max(j, bisect_left(tokens.starts, b) - 1)
            else:
                break
            j += 1
            if j < n and tokens[j][0] == "plus":
                j += 1
                continue
            break
        return None if not pieces else pieces[0] if len(pieces) == 1 else Value(None, tuple(pieces))

    def give(name: bytes, value: Value) -> None:
        if name not in PRIMITIVE:
            known[name] = value
        weight = name_score(name) if re.fullmatch(rb"[A-Za-z0-9_$.\x20-]+", name) else 0
        if weight >= 2 and weight + literal_score(*facts_of(value, raw)) >= LEAST_SCORE:
            secret.append(value)

    control, begins = False, True
    for i in range(n - 2):
        kind, start, end = tokens[i]
        if kind == "end" and raw[start:end] in (b"\n", b";", b"{", b"}"):
            control, begins = False, True
        elif begins:
            control, begins = raw[start:end] in CONTROL, False
        operator = raw[tokens[i + 1][1] : tokens[i + 1][2]] if tokens[i + 1][0] == "assign" else b""
        if kind not in ("name", "string") or operator not in (b"=", b":", b":=", b"=>") or kind == "string" and operator == b"=":
            continue
        name = raw[start:end] if kind == "name" else raw[start + 1 : end - 1]
        if value := value_at(i + 2, True):
            give(name, value)
        if operator == b":" and not control and (j := declared_value(raw, tokens, i + 2)) is not None and (value := value_at(j, False)):
            give(name, value)
    found, seen = set(), set()
    while secret:
        value = secret.pop()
        if id(value) not in seen:
            seen.add(id(value))
            secret += value.pieces
            found.add(value.span)
    return [(*span, 3) for span in sorted(found - {None}) if span[1] > span[0]]


def may_hold(raw: bytes) -> bool:
    """Whether a text may hold a name with a sensitive word, or with two neighbours that make one (pass_word)."""
    low = raw.lower().translate(None, PARTING)
    return any(w in low for w in HINTS)


def scan(text: str) -> tuple[list[tuple[int, int, int]], int]:
    """All spans of a text in code points, sorted, and how many are base ones. Base spans come first in
    the check: a lexed span that one of them covers adds nothing and is left out."""
    raw = text.encode("utf-8", "surrogatepass")
    base = base_spans(raw)
    extra = lexed_spans(raw) if may_hold(raw) else []
    if extra and base:
        base.sort()
        starts, reach = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
        extra = [x for x in extra if not (k := bisect_right(starts, x[0])) or reach[k - 1] < x[1]]
    spans = base + extra
    if spans and len(raw) != len(text):
        places = sorted({p for a, b, _ in spans for p in (a, b)})
        at, seen, points = 0, 0, {}
        for p in places:
            seen += len(raw[at:p].decode("utf-8", "surrogatepass"))
            at, points[p] = p, seen
        spans = [(points[a], points[b], k) for a, b, k in spans]
    return sorted(spans, key=lambda s: (s[0], s[2], s[1])), len(base)


def secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without its text, with spans: an array of (kind, start, end) in code points, the end exclusive.

    Kinds are assign, access and hex (fixed patterns) and lexed (literals that assignments give to
    sensitive names). Texts are read whole and where they lie, without shuffle. Null counts as empty and has
    no spans; an empty table stays empty; repeated rows get equal results; a column named spans, whatever the case, is replaced.
    """
    rest = others(docs, text_col, "spans")
    names = [f.name for f in rest]
    schema = ddl(rest, "spans array<struct<kind:string,start:long,end:long>>")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in scan(t or "")[0]] for t in batch.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + [pa.array(rows, kind)], names=[*names, "spans"])

    return docs.select(*numbered(rest), F.col(tick(text_col)).alias("_text")).mapInArrow(run, schema)


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    found = secrets(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "lexed")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("lexed"))


def base_digest(text: str) -> str:
    """base_sha256 of one text, from the patterns alone."""
    spans, _ = scan(text)
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans if k < 3).encode()).hexdigest()
