"""Line dedup, PPM scores, Jaccard join and the pipeline: against brute force on small tables."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilsift.llm import components, jaccard, line_dedup, ppm


def words(draw, n, k=400):
    return " ".join(f"w{draw.randint(0, k)}" for _ in range(n))


# ---- line dedup


def brute_lines(docs: list[tuple], least: int) -> dict:
    """All runs of lines, compared with all others."""
    runs = {}
    for doc, text in sorted(docs):
        lines = [line for line in text.split("\n") if line.split()]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[a:b]) >= least:
                    runs.setdefault(tuple(lines[a:b]), []).append((doc, a, b))
    gone = defaultdict(set)
    for places in runs.values():
        for doc, a, b in places[1:]:
            gone[doc] |= set(range(a, b))
    return gone


def test_line_dedup(spark):
    draw = random.Random(1)
    pool = [words(draw, draw.randint(1, 9), 20) for _ in range(25)]
    docs = []
    for i in range(40):
        lines = [draw.choice(pool) if draw.random() < 0.7 else words(draw, 6) for _ in range(draw.randint(0, 12))]
        if docs and draw.random() < 0.4:
            other = docs[draw.randrange(len(docs))][1].split("\n")
            lines[2:2] = other[: draw.randint(0, len(other))]
        docs.append((i, "\n".join(x if draw.random() < 0.9 else "" for x in lines)))
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, n_lines string").repartition(3)
    got = {r.doc_id: r for r in line_dedup.line_dedup(frame, min_words=12).collect()}
    gone = brute_lines(docs, 12)
    for doc, text in docs:
        lines = [x for x in text.split("\n") if x.split()]
        left = [x for k, x in enumerate(lines) if k not in gone[doc]]
        assert [x for x in got[doc].text.split("\n") if x.split()] == left, doc
        assert (got[doc].n_lines, got[doc].n_deleted) == (len(lines), len(lines) - len(left))
    assert sum(r.n_deleted for r in got.values()) > 20


def test_line_dedup_edges(spark):
    run = "\n".join(["one two three four"] * 2 + ["five six seven"])
    rows = [(1, None), (2, ""), (3, run), (3, run), (None, run), (5, "a\n\n" + run), (6, "x " * 100_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.line_dedup(frame, min_words=11).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.text, r.n_deleted, r.deleted))
    assert by[1] == [(None, 0, "")] and by[2] == [("", 0, "")] and by[None] == [(run, 0, "")]
    assert by[3] == [("", 3, "0:3")] * 2 and by[5] == [("a\n", 3, "2:5")] and by[6][0][1] == 0
    assert line_dedup.line_dedup(frame.limit(0)).count() == 0


# ---- PPM


def brute_ppm(texts: list[bytes], train: list[bool]) -> list[float]:
    counts = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    edge = ppm.EDGE
    padded = [edge * ppm.ORDER + t + edge for t in texts]
    for b, learn in zip(padded, train, strict=True):
        for i in range(ppm.ORDER, len(b)) if learn else ():
            for k in range(ppm.ORDER + 1):
                counts[k][b[i - k : i]][b[i]] += 1
    out = []
    for b in padded:
        log = 0.0
        for i in range(ppm.ORDER, len(b)):
            out_of_question: set[int] = set()
            for k in range(ppm.ORDER, -1, -1):
                seen = counts[k].get(b[i - k : i])
                if not seen:
                    continue
                left = {s: c for s, c in seen.items() if s not in out_of_question}
                n, d = sum(left.values()), len(left)
                if b[i] in left:
                    log += math.log10(left[b[i]] / (n + d))
                    break
                if d:
                    log += math.log10(d / (n + d))
                out_of_question |= set(seen)
            else:
                log -= math.log10(256 - len(out_of_question))
        out.append(log)
    return out


def test_lm_scores(spark):
    draw = random.Random(2)
    rows = [(i, words(draw, draw.randint(0, 60), 30) + draw.choice(["", " É日", "\tTHE\n"])) for i in range(60)] + [(100, None), (101, ""), (3, "w1 w2"), (None, "w1 w2")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string").repartition(3)
    got = sorted(ppm.lm_scores(frame).collect(), key=lambda r: (str(r.doc_id), r.score))
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    texts = [(t or "") for _, t in rows]
    scores = brute_ppm([t.encode() for t in texts], [not h for h in held])
    tokens = [t.encode().translate(ppm.FOLD).split() for t in texts]
    counts = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for (i, _), ws, h, s in zip(rows, tokens, held, scores, strict=True):
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*ws, None])
        want.append((i, h, len(ws) + 1, sum(counts[w] > 0 for w in [*ws, None]), n, base, s))
    want.sort(key=lambda r: (str(r[0]), r[6]))
    for r, w in zip(got, want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5]
        assert abs(r.base_score - w[5]) < 1e-6 and abs(r.score - w[6]) < 1e-6
    assert ppm.lm_scores(frame.limit(0)).count() == 0


def test_lm_without_training(spark):
    frame = spark.createDataFrame([(i, "ab") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    for r in ppm.lm_scores(frame).collect():
        assert r.held_out and r.n_known == 0 and r.train_tokens == 0 and abs(r.score + 3 * math.log10(256)) < 1e-9


# ---- Jaccard join


def brute_sets(texts):
    out = []
    for t in texts:
        ws = (t or "").encode().translate(jaccard.FOLD).split()
        out.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    return out


def brute_components(ids, sets):
    comp = list(range(len(ids)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                comp[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(ids))]


def test_signatures_lose_no_pair():
    draw = np.random.default_rng(5)
    bands, tried = jaccard.Bands(), 0
    for _ in range(1500):
        n = int(draw.integers(1, 300))
        a = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        kept = draw.permutation(len(a))[: len(a) - int(draw.integers(0, len(a) // 5 + 1))]
        b = np.unique(np.concatenate([a[kept], draw.integers(0, 2**63, int(draw.integers(0, n // 4 + 2))).astype(np.uint64)]))
        inter = len(np.intersect1d(a, b))
        union = len(a) + len(b) - inter
        if len(b) and 100 * inter >= 80 * union and inter < union:
            tried += 1
            assert len(np.intersect1d(jaccard.signatures(a, bands), jaccard.signatures(b, bands)))
            assert jaccard.least_difference(jaccard.sketch(a), jaccard.sketch(b)) <= union - inter
    assert tried > 300


def test_shingle_sets():
    texts = ["", "  ", "a", "A b c D", "a  b\tc\nd e", "a b c d e f g", "x" * 50, "é É A b c d e f", "a b c d e a b c d e"]
    assert [len(s) for s in jaccard.shingle_sets(texts)] == [len(s) for s in brute_sets(texts)]
    assert np.array_equal(*jaccard.shingle_sets(["A b\tc D e", " a  b c d E\n"]))


def test_similar_documents(spark):
    draw = random.Random(6)
    texts, passage = [], words(draw, 60, 5000)
    for _ in range(40):
        base = words(draw, draw.choice([6, 12, 40, 150, 300]), 5000).split()
        texts.append(" ".join(base))
        for _ in range(draw.randint(0, 6)):  # chains: each copy differs a little from the one before
            base = base[:]
            for _ in range(max(1, len(base) // 40)):
                base[draw.randrange(len(base))] = f"v{draw.randint(0, 10**6)}"
            texts.append(" ".join(base).upper())
    texts += [passage + " " + words(draw, 5, 5000) for _ in range(12)] + [passage + " " + words(draw, 60, 5000) for _ in range(12)]
    texts += [None, "", " ", "a b", "A b", "a b c", texts[0], texts[0]]
    ids = [3 * i + 1 for i in range(len(texts))]
    draw.shuffle(ids)
    frame = spark.createDataFrame([(i, t, "clash") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, component_id string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(frame).collect()}
    sets = brute_sets(texts)
    want = dict(zip(ids, zip(map(len, sets), brute_components(ids, sets), strict=True), strict=True))
    assert got == want
    assert len({c for _, c in got.values()}) < len(texts) - 20


def test_similar_documents_edges(spark):
    frame = spark.createDataFrame([(None, "a b c d e f"), (9, "A b c d e f"), (9, "A b c d e f"), (None, "alone here"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.similar_documents(frame).collect()), key=str)
    assert got == sorted([(None, 9), (9, 9), (9, 9), (None, None), (2, 2)], key=str)
    assert jaccard.similar_documents(frame.limit(0)).count() == 0


def family(draw, n, length=120):
    """Variants of one text, whose edits add up to differences on both sides of the threshold."""
    base = words(draw, length, 10**6).split()
    out = []
    for _ in range(n):
        own = base[:]
        for _ in range(draw.randint(1, 4)):
            own[draw.randrange(length)] = f"v{draw.randint(0, 10**9)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("star_rows", "block_bytes", "most_common"), [(256, 8 << 20, 1 << 17), (4, 4000, 4)])
def test_large_groups(spark, monkeypatch, star_rows, block_bytes, most_common):
    """Hundreds of classes that share signatures: a family about the threshold, and texts that share nothing but a passage.
    Cutting stars finely and knowing hardly any common element changes nothing."""
    monkeypatch.setattr(jaccard, "STAR_ROWS", star_rows)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(jaccard._grouped, "__defaults__", (most_common,))
    draw = random.Random(11)
    passage = words(draw, 60, 10**6)
    texts = family(draw, 150) + [passage + " " + words(draw, 20, 10**6) for _ in range(150)] + [passage + " " + words(draw, 3, 10**6) for _ in range(30)]
    ids = list(range(len(texts)))
    draw.shuffle(ids)
    frame = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(frame).collect()}
    want = dict(zip(ids, brute_components(ids, brute_sets(texts)), strict=True))
    assert got == want
    assert 120 < len(set(want.values())) < 320


def test_thousands_that_are_not_similar():
    """A group of thousands of mutually dissimilar sets gives a pair each, no links, and soon."""
    draw = np.random.default_rng(3)
    shared = draw.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([shared, draw.integers(0, 2**63, 60).astype(np.uint64)])) for _ in range(3000)]
    names = [jaccard.digest(s) for s in sets]
    assert jaccard.joining_links(sets, names, [0] * len(sets), 80, 100) == []
    key = b"\1" * jaccard.KEY_BYTES
    import pyarrow as pa

    met = jaccard._meet(pa.table({"pid": [0], "classes": [b"".join(names)], "counts": [np.ones(3000, "<u4").tobytes()], "keys": [key * 3000]}))
    assert met.num_rows == 2999 and set(met["n"].to_pylist()) == {3000}
    assert set(met["a"].to_pylist()) == {min(names)}


def test_links_of_rows_without_id(spark):
    """Texts A, N, B where only N joins A and B: with or without an id on N."""
    base = [f"w{i}" for i in range(120)]
    a, n, b = base[:], base[:], base[:]
    a[20], a[60] = "x", "x"
    b[40], b[100] = "y", "y"
    texts = [" ".join(t) for t in (a, n, b)]
    sets = brute_sets(texts)
    assert len(sets[0] & sets[2]) * 100 < 80 * len(sets[0] | sets[2]) and len(sets[0] & sets[1]) * 100 >= 80 * len(sets[0] | sets[1])
    frame = spark.createDataFrame([(7, texts[0]), (None, texts[1]), (5, texts[2])], "doc_id long, text string")
    assert {r.component_id for r in jaccard.similar_documents(frame).collect()} == {5}
    left = jaccard.one_of_each(frame).collect()
    assert [(r.doc_id, r.text) for r in left] == [(5, texts[2])]


def test_one_of_each_edges(spark):
    near = " ".join(f"w{i}" for i in range(100))
    rows = [(4, near, "x"), (4, near, "x"), (4, near + " more", "y"), (None, near + " end", "z"), (None, "alone of all", "z"), (None, "alone of all", "z"), (1, None, "n"), (2, "", "n"), (None, None, "n"), (3, "x " * 200_000, "long")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    got = jaccard.one_of_each(frame).collect()
    assert sorted((str(r.doc_id), r._row) for r in got if r._row != "n") == [("3", "long"), ("4", got[[g.doc_id for g in got].index(4)]._row), ("None", "z")]
    assert sorted(str(r.doc_id) for r in got if r._row == "n") == ["1", "2", "None"]
    assert jaccard.one_of_each(frame.limit(0)).count() == 0 and jaccard.one_of_each(frame).columns == frame.columns


@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(40)], [(5, 9), (9, 1), (7, 3), (3, 3)], []])
def test_components(spark, links):
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    comp = {x: x for p in links for x in p if p[0] != p[1]}
    for _ in range(50):
        for a, b in links:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == comp


# ---- pipeline


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers
    from tests.llm.test_text_ops import PATH, base_counts
    from veilsift.llm import bpe, mixing, quality

    draw = random.Random(7)
    common = [w for w in quality.COMMON_WORDS["en"]]
    prose = lambda n: " ".join(draw.choice(common) if draw.random() < 0.45 else "".join(draw.choice("etaoinshr") for _ in range(draw.randint(3, 8))) for _ in range(n)) + "."
    rows, shared = [], prose(60)
    for i in range(60):
        rows.append((i, "\n".join([prose(40), prose(30)] + [shared] * (i % 6 == 0)), "en", f"s{i % 3}", 0))
    rows += [(100, rows[3][1], "en", "s1", 0), (101, rows[4][1].replace("the", "thee", 1), "en", "s2", 0), (102, "a b " * 100, "en", "s0", 0), (103, None, None, None, None), (104, "too short", "en", "s0", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()

    kept = [(i, t, s) for i, t, _, s, _ in rows if t and base_counts(t)["n_words"] >= 20 and 100 * base_counts(t)["n_repeat_words"] <= 30 * base_counts(t)["n_words"]]
    gone = brute_lines([(i, t) for i, t, _ in kept], line_dedup.MIN_WORDS)
    left = []
    for i, t, s in kept:
        lines = [x for k, x in enumerate(t.split("\n")) if k not in gone[i]]
        if lines:
            left.append((i, "\n".join(lines), s))
    comp = brute_components([i for i, _, _ in left], brute_sets([t for _, t, _ in left]))
    single = [r for r, c in zip(left, comp, strict=True) if r[0] == c]
    assert {r.doc_id for r in got} <= {i for i, _, _ in single} and 102 not in {r.doc_id for r in got}
    plan = mixing.mix_plan(spark.createDataFrame(single, "doc_id long, text string, source string")).collect()
    enc = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_from(PATH).rank_of, special_tokens={})
    want = Counter()
    for r in plan:
        want[(r.doc_id, len(enc.encode_ordinary(r.text)))] += r._copies
    assert Counter((r.doc_id, r.n_tokens) for r in got) == +want
