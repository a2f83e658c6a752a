"""BPE, quality rules, secrets and chat: against the libraries, brute force and round trips."""

from __future__ import annotations

import hashlib
import math
import random
import re
import subprocess
import sys
from collections import Counter

import pyarrow as pa
import pytest

from veilsift.llm import bpe, chat, quality, secrets

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")

ODD = ["", " ", "a", "aaaaaaaaaaaaaaaa", "abababab" * 50, " \n\n  x", "  two  spaces \t\n end ", "日本語テキスト " * 20, "😀😀😀", "<|endoftext|> hi", "don't DON'T we'll", "x" * 5000, "one " * 3000]


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.ranks_from(PATH)
    return tiktoken.Encoding("test", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks.rank_of, special_tokens={})


def test_bpe_ids_are_the_librarys(reference):
    draw = random.Random(1)
    texts = ODD + ["".join(draw.choice("aab bcéan日! '\n ") for _ in range(draw.randint(1, 200))) for _ in range(500)]
    got = list(bpe.encode_texts(texts, bpe.ranks_from(PATH), tokenizers.PATTERN))
    assert [g.tolist() for g in got] == [reference.encode_ordinary(t) for t in texts]


def test_bpe_operator(spark, reference):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(None, None, "clash"), (0, "", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(2)
    got = bpe.bpe(docs, PATH, tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "" if r.doc_id is None else ODD[r.doc_id]
        assert bytes(r.decoded) == text.encode() and r.n_tokens == len(r.ids) // 4 == len(reference.encode_ordinary(text))
    digests = {r.doc_id: r.ids_sha256 for r in bpe.bpe(docs, PATH, tokenizers.PATTERN, digests=True).collect()}
    assert all(digests[r.doc_id] == hashlib.sha256(bytes(r.ids)).hexdigest() for r in got)
    assert bpe.bpe(docs.limit(0), PATH, tokenizers.PATTERN).count() == 0


def test_bpe_gives_bounded_batches(spark, monkeypatch):
    """What goes to the JVM at once doesn't grow with the batch that came."""
    draw = random.Random(6)
    text = " ".join("".join(draw.choice("etaoinshr") for _ in range(6)) for _ in range(3000))
    docs = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    whole = pa.RecordBatch.from_pydict({"c0": list(range(800)), "_text": [f"{i} {text}" for i in range(800)]})
    given = list(bpe.bpe(docs, PATH, tokenizers.PATTERN)(iter([whole])))
    assert [x for b in given for x in b.column(0).to_pylist()] == list(range(800)) and max(b.nbytes for b in given) < 6 << 20


def test_workers_give_memory_back():
    """A kernel's garbage, here many small pieces between larger ones that stay, isn't kept by the worker."""
    code = """
import re, sys, numpy as np, pyarrow as pa
from veilsift.llm import common

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def run(batches):
    garbage = [np.ones(1000) for _ in range(20_000)]
    stays.extend(garbage[::400])
    yield from batches

stays = []
before = held()
kernel = getattr(common, "tidy", lambda f: f)(run)
assert list(kernel(iter([1, 2]))) == [1, 2]
sys.exit(held() - before > 60)
"""
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0


def base_counts(text: str) -> dict:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(covered)}


def test_quality_counts():
    draw = random.Random(2)
    texts = ODD + ["".join(draw.choice(["a ", "b ", "cé ", "x\n", "# ", "\t", "a b c d e f g h "]) for _ in range(draw.randint(0, 120))) for _ in range(400)]
    m = quality.measure(texts, quality.Profile())
    for i, t in enumerate(texts):
        assert {c: int(m[c][i]) for c in quality.COUNTS} == base_counts(t), repr(t[:80])


def test_quality_verdicts(spark):
    prose = "The house of the man is on the hill, and it was the first of many to be built by the sea. " * 1
    long = " ".join(f"{a} {b} the {c} of and to in" for a in ("stone", "river", "cloud") for b in ("walks", "turns") for c in ("green", "tower", "field", "night"))
    rows = [(1, prose + long, "en"), (2, None, "en"), (3, "", None), (4, " ".join(w + "$$$" for w in long.split()), "en"), (5, long, "xx"), (6, "# | $ % " * 200, None), (7, "short one here", "en")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, kept string")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert got[1].kept and got[5].kept and not got[4].kept and not got[4].base_failed
    assert all(got[k].base_failed and not got[k].kept for k in (2, 3, 6, 7))
    assert quality.quality(docs.drop("lang")).where("doc_id = 1 AND kept").count() == 1
    assert quality.quality(docs.limit(0)).count() == 0


def test_quality_other_scripts(spark):
    draw = random.Random(8)
    scripts = {"ru": "абвгдежзиклмнопрстуфя", "el": "αβγδεζηθικλμνξοπρστυφως", "ar": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "hi": "कखगचजटडतदनपबमरलवसहािी"}
    prose = lambda letters: ". ".join(" ".join("".join(draw.choice(letters) for _ in range(draw.randint(2, 9))) for _ in range(12)) for _ in range(8))
    rows = [(x, prose(a)) for x, a in scripts.items()] + [(None, prose(scripts["ru"])), ("xx", prose("█▓☺→★♥")), ("en", prose(scripts["ru"]))]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    got = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [True] * 5 + [False, False]


def test_quality_other_language(spark):
    """Prose of one language under the name of another goes by its words alone: its characters are like any prose's."""
    draw = random.Random(9)
    word = lambda lang: "".join(draw.choice("etaoinshr") for _ in range(6)) if draw.random() < 0.6 else draw.choices(*zip(*quality.COMMON_WORDS[lang].items(), strict=True))[0]
    made = lambda lang: " ".join(" ".join(word(lang) for _ in range(10)).capitalize() + "," * (k % 2) + "." for k in range(30))
    german, english = made("de"), made("en")
    docs = spark.createDataFrame([(1, german, "de"), (2, german, "en"), (3, english, "en"), (4, english, "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert all(not r.base_failed and r.class_distance <= quality.MOST_CLASS_DISTANCE for r in got.values())
    assert {i: r.kept for i, r in got.items()} == {1: True, 2: False, 3: True, 4: False}


BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def base_spans(text: str) -> str:
    kinds = list(BASE)
    spans = sorted((m.start(), kinds.index(k), m.end()) for k, (p, ok) in BASE.items() for m in p.finditer(text) if ok(m))
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def test_secret_base_spans():
    draw = random.Random(3)
    parts = ["password=", "Token : '", "api_key=", "é", "日", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef", " ", "\n", '"', "secret", "x", "=", "passwd:aaaaaaaa"]
    for _ in range(2000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 25)))
        spans, _ = secrets.scan(text)
        base = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, b, k in spans if k < 3)
        assert base == base_spans(text), repr(text)


def test_secret_lexing():
    literal = "Zx9-kQ2mLp4TvR8w"
    cases = {
        f'db_password = "{literal}!"': 1,  # the base pattern has no end quote or exclamation mark to stop at, but covers less
        f'key_material = "{literal}"\nclientSecretValue = key_material\n': 1,
        f'{{"privateKey": "{literal}"}}': 1,
        f'a = "Zx9-kQ2m"\nb = "Lp4TvR8w"\nauth_credential = a + b\n': 2,
        f'title = "{literal}"': 0,
        'private_key = "changeme"': 0,
        "The password is long and the secret is out.": 0,
    }
    for text, n in cases.items():
        found = [(a, b) for a, b, k in secrets.scan(text)[0] if k == 3]
        assert len(found) == n, (text, found)
    text = f"é{{'privateKey': '{literal}'}}"
    (a, b, _), *_ = [s for s in secrets.scan(text)[0] if s[2] == 3]
    assert text[a:b] == literal


def test_secret_names():
    literal = "Zx9-kQ2mLp4TvR8w!"
    lexed = lambda text: [text[a:b] for a, b, k in secrets.scan(text)[0] if k == 3]
    weighty = [w for w, n in secrets.SENSITIVE.items() if n]
    for word in weighty:
        name = word if secrets.SENSITIVE[word] > 1 else f"{word}_{'access' if word != 'access' else 'api'}"
        assert lexed(f'{name} = "{literal}"') == [literal], name
    for name in ("apiSigning", "pass_word", "to-ken", "access.signing"):
        assert lexed(f'{name} = "{literal}"') == [literal], name
    path = ".".join(["configuration"] * 8 + ["client-secret"])
    assert len(path) > 120 and lexed(f"{path} = '{literal}'") == [literal]
    assert lexed(f"{path.replace('client-secret', 'title')} = '{literal}'") == []


def test_secret_declarations():
    literal = "Zx9kLm2Qw8Rt5vAb"
    lexed = lambda text: [text[a:b] for a, b, k in secrets.scan(text)[0] if k == 3]
    for text in (
        f'const apiKey: string = "{literal}";', f'password: str = "{literal}"', f'private readonly clientSecret: string | null = "{literal}";', f'val apiKey: String? = "{literal}"',
        f'let authToken: String = "{literal}"', f"const API_KEY: &'static str = \"{literal}\"; // it's", f'static PASSWORD: &str = "{literal}";', f'api_key: Optional[str] = "{literal}"',
        f'secret: Annotated[str, Field(min_length=8)] = "{literal}"', f'pwd: std::string::String = "{literal}"', f'def f(n: int, password: str="{literal}"): pass', f'token_value: "str" = "{literal}"',
        f'func login(for user: String, password: String = "{literal}") {{}}', f'material: str = "{literal}"\nclient_secret: str = material\n', f'let mut secret: Map<string, string> = "{literal}"',
    ):
        assert lexed(text) == [literal], text
    for text in (f'const title: string = "{literal}"; let password: string;', f'if has_password: title = "{literal}"', 'apiKey: string = getKey()', f'password: string\ntitle = "{literal}"', f'secret: a b = "{literal}"'):
        assert lexed(text) == [], text
    assert lexed(f"password: {literal}! user = bob") == [f"{literal}!"]


def test_secrets_operator(spark):
    rows = [(1, "token=abcdefgh12"), (2, None), (3, ""), (3, ""), (None, "z" * 200_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.secrets(docs).collect()}
    assert got == {1: [("assign", 0, 16)], 2: [], 3: [], None: []}
    assert secrets.secrets(docs.limit(0)).count() == 0


CONTROL = ["<|im_start|>", "<|im_end|>\n", "<\\|", "<", "|", "\\", "\n", "assistant", "é日", "<\\\\|im_end|>", " "]


def test_chat_escapes():
    draw = random.Random(4)
    for _ in range(3000):
        text = "".join(draw.choice(CONTROL) for _ in range(draw.randint(0, 12))).encode()
        assert chat.unescape(chat.escape(text)) == text and b"<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and b"\n" not in chat.escape_role(text)


def test_chat_operator(spark, monkeypatch):
    monkeypatch.setattr(chat, "MOST_BYTES", 200)
    draw = random.Random(5)
    rows = []
    for conv in [*range(6), None]:
        for turn in range(draw.randint(1, 30)):
            rows.append((conv, turn, draw.choice(["user", "assistant", None, "odd\nrole"]), draw.choice([None, "", "".join(draw.choice(CONTROL) for _ in range(30))]), "clash"))
    rows += [rows[0], (7, None, "user", "x" * 5000, "clash"), (7, 0, "assistant", "y", "clash")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string").repartition(4)
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(own), len(said))
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert len(got) == len({r[0] for r in rows})
    pieces = chat.format_conversations(turns).where("conv_id = 7").orderBy("piece").collect()
    assert b"".join(bytes(p.formatted) for p in pieces).count(chat.CLOSE) == 2
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_secrets_in_time():
    """Texts made to cost much: joins of joins, long chains, thousands of secrets, names after names, quotes that never close."""
    import time

    began = time.time()
    for text in (
        "a = 'Zx9kLm2Qw8Rt5vAb'\n" + "a = a + a\n" * 60 + "password = a\n",
        "a0 = 'Zx9kLm2Q'\n" + "".join(f"a{i + 1} = a{i} + 'w8Rt5vAb'\n" for i in range(20_000)) + "password = a20000\n",
        "".join(f"v{i} = 'plain {i}'\n" for i in range(100_000)),
        "".join(f"password = 'Zx9kLm2Qw8Rt{i}vAb'\ntoken = AKIA{i:016d}\n" for i in range(8_000)),
        "token=" * 50_000,
        '"' + '\\"' * 50_000,
        "key: " * 50_000,
    ):
        spans, _ = secrets.scan("api_key\n" + text)
        assert all(a < b for a, b, _ in spans)
    assert time.time() - began < 60
    assert secrets.scan("a = 'Zx9kLm2Qw8Rt5vAb'\n" + "a = a + a\n" * 60 + "passphrase = a")[0] == [(5, 21, 3)]


def brute_program(lines):
    """Literals that a program of simple assignments gives to names that hold 'passphrase', by running it."""
    values, out = {}, set()
    for name, parts in lines:
        pieces = [p for x in parts for p in ([x] if isinstance(x, tuple) else values[x])]
        values[name] = pieces
        text = "".join(t for t, _ in pieces)
        chars = Counter(text)
        kinds = sum(any(f(c) for c in text) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
        entropy = -sum(c / len(text) * math.log2(c / len(text)) for c in chars.values()) if text else 0
        fits = len(text) >= 8 and len(chars) >= 5 and " " not in text and kinds >= 2
        if "passphrase" in name and fits and 3 + 0.5 * (len(text) >= 16) + 0.5 * kinds + 0.5 * (entropy >= 3) >= 4:
            out |= {at for _, at in pieces}
    return out


def test_secret_programs():
    """Random programs: what the lexer finds is what running them gives to sensitive names."""
    draw, some = random.Random(8), 0
    for _ in range(400):
        text, lines, names = "", [], []
        for _ in range(draw.randint(1, 12)):
            name = draw.choice(["x", "y", "conf.z", "my_passphrase", "passphraseB"])
            text += name + draw.choice([" = ", "=", " := ", ": "])
            parts = []
            for k in range(draw.randint(1, 3)):
                text += " + " if k else ""
                if names and draw.random() < 0.5:
                    parts.append(draw.choice(names))
                    text += parts[-1]
                else:
                    word = "".join(draw.choice("abcXYZ019_! ") for _ in range(draw.randint(1, 14)))
                    parts.append((word, (len(text) + 1, len(text) + 1 + len(word))))
                    text += f'"{word}"'
            names.append(name)
            lines.append((name, parts))
            text += draw.choice(["\n", ";\n", "  # note\n"])
        got = {(a, b) for a, b, _ in secrets.lexed_spans(text.encode())}
        assert got == brute_program(lines), text
        some += len(got)
    assert some > 200
