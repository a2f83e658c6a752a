"""Exact dedup, mixing and licence scans: edge cases, and collisions by force."""

from __future__ import annotations

import hashlib
import pathlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veilsift.llm import exact_dedup, license_texts, licenses, mixing

DOCS = "doc_id long, text string, source string, kept string, _hash_ string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "a b", "s1"), (2, None, "s1"), (3, "", None), (4, "a b", None), (4, "a b", None), (None, "a b", "s2"), (5, "x " * 50_000, "s2"), (6, "A b", "s2"), (None, "alone", "s3")]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS).repartition(3)


def test_exact_groups(odd):
    got = sorted(exact_dedup.exact_groups(odd).collect(), key=str)
    assert len(got) == 9
    for r in got:
        text = {1: "a b", 2: "", 3: "", 4: "a b", 5: "x " * 50_000, 6: "A b"}.get(r.doc_id)
        if text is not None:
            assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.keep_id, r.group_size, r.kept))
    assert by[1] == [(4, 4, False)] and by[4] == [(4, 4, True)] * 2
    assert by[2] == [(3, 2, False)] and by[3] == [(3, 2, True)]
    assert sorted(by[None], key=str) == sorted([(4, 4, False), (None, 1, False)], key=str)
    smallest = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(odd, keep="smallest").collect() if r.doc_id}
    assert smallest[4] == 1 and smallest[3] == 2


def test_exact_groups_survive_collisions(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(100)], "doc_id long, text string")
    got = exact_dedup.exact_groups(docs, hash_of=lambda t: F.lit(b"same")).collect()
    assert len(got) == 100 and all(r.doc_id % 7 == r.keep_id % 7 and r.group_size in (14, 15) for r in got)
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(docs, keep="first")


def test_exact_groups_normalise_and_empty(spark, odd):
    got = {r.doc_id: r.group_size for r in exact_dedup.exact_groups(odd, normalise=F.lower).collect()}
    assert got[6] == 5
    assert exact_dedup.exact_groups(odd.limit(0)).count() == 0


def shares(sizes: dict, weights=(5, 2, 1), most=3.0) -> dict:
    """Targets by the rule as told: share, stop what is above, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        if not free:
            return stopped
        level = (total - sum(stopped.values())) / sum(w[s] for s in free)
        above = [s for s in free if level * w[s] > most * sizes[s]]
        if not above:
            return stopped | {s: level * w[s] for s in free}
        stopped |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 3, None: 40}, {"a": 0, "b": 5}, {"x": 7}, {"a": 1, "b": 1, "c": 1, "d": 1, "e": 900}, {"a": 0}])
def test_source_targets(spark, sizes):
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = shares(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix(spark):
    rows = [(i, "w " * (i % 90 + 10), f"s{i % 4}" if i % 9 else None, "clash") for i in range(3000)] + [(9000, None, "s0", "c"), (9001, "", None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    planned = mixing.mix_plan(docs).collect()
    assert len(planned) == len(rows) and all(r._copies in (0, 1, 2, 3) for r in planned)
    taken, target = defaultdict(int), {}
    for r in planned:
        taken[r.source] += r._size * r._copies
        target[r.source] = r._target
    assert all(abs(taken[s] - target[s]) < 0.1 * target[s] for s in target)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r._copies for r in planned)
    again = {(r.doc_id, r._copies) for r in mixing.mix_plan(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r._copies) for r in planned}
    assert mixing.mix_plan(docs.limit(0)).count() == 0


def test_mix_joins_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BROADCAST_SOURCES", 1)
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 5}" if i % 5 else None) for i in range(100)], "doc_id long, text string, source string")
    assert mixing.mix_plan(docs).count() == 100


def test_licenses(spark):
    mit = license_texts.MIT
    rows = [
        (1, mit), (2, "Copyright (c) 2020 A. Person\n\n" + mit.upper()), (3, "/* Copyright 2019 B */\n" + mit.replace("sublicense", "sublicence").replace('"', "'")),
        (4, mit + " and more"), (5, "Prose.\nReleased under the MIT Licence!\nMore."), (6, "Licensed under CC BY-NC 4.0.\nLicensed under cc by nc 4.0"), (7, None), (8, ""), (8, ""), (None, "x " * 100_000),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, license string")
    got = sorted(licenses.license_scan(docs).collect(), key=str)
    assert len(got) == len(rows)
    by = {r.doc_id: (r.license, r.notices, r.n_notices) for r in got}
    assert by[1][0] == by[2][0] == by[3][0] == "MIT" and by[4][0] is None
    assert by[5] == (None, ["MIT"], 1) and by[6] == (None, ["CC-BY-NC-4.0"], 2)
    assert by[7] == by[8] == by[None] == (None, [], 0)
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_hint_is_in_all_that_is_known(spark):
    texts = [t for _, t in licenses.known_texts()] + [p.read_text() for p in (pathlib.Path(__file__).parent / "licenses").glob("*.txt")]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(licenses.canonical(F.col("t")).alias("c"))
    assert frame.where(~F.col("c").rlike(licenses.HINT)).count() == 0
    # Letters that only lower-casing would make plain don't make a known text.
    assert licenses.license_scan(spark.createDataFrame([(1, license_texts.MIT.replace("Permission", "Perm\u0130ssion").replace("i", "\u0130"))], "doc_id long, text string")).first()["license"] is None


def test_long_licenses(spark):
    end = "END OF TERMS AND CONDITIONS"
    rows = []
    for path in sorted((pathlib.Path(__file__).parent / "licenses").glob("*.txt")):
        text, name = path.read_text(), path.stem.split("@")[0]
        rows += [(name, text), (name, "\n".join(f" * {x}" for x in text.upper().split("\n"))), (None, text + "\nand more"), (None, text[: len(text) // 2])]
        if end in text:
            rows.append((name, text[: text.index(end) + len(end)]))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.license_scan(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [name for name, _ in rows]
    assert {name for name, _ in license_texts.DIGESTS} == {name for name, _ in rows if name}
