"""Tables whose columns are named like what operators use inside, rows without id, repeated rows, long texts, no rows."""

from __future__ import annotations

import public_tokenizers
import pytest

from veilsift.llm import bpe, exact_dedup, jaccard, licenses, line_dedup, mixing, ppm, quality, secrets

NAMES = ["_id", "_tag", "_Text", "_text_", "_lang", "_runs", "_found", "_of", "_source", "_Size", "_target", "_copies", "_copy", "_hash", "_row", "comp", "N_Words", "Kept", "Spans", "IDS", "Deleted", "Component_ID", "a b.c"]
DOCS = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in NAMES)

PROSE = "the cat and the dog of a house that was in the town for all of them to see and be with "


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, PROSE * 3), (2, None), (3, ""), (None, PROSE * 3), (None, None), (4, "word " * 200_000), (4, PROSE + "password = Zx9kLm2Qw8Rt5vAb"), (4, PROSE * 3), (4, PROSE * 3)]
    rows = [(i, t, "en" if i else None, "s" if i != 2 else None, *(f"{k}{c}" for c in NAMES)) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def bpe_of(docs):
    return bpe.bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


#: What each operator replaces of the columns above.
OPERATORS = [
    (bpe_of, {"text", "IDS"}),
    (quality.quality, {"N_Words", "Kept"}),
    (secrets.secrets, {"text", "Spans"}),
    (line_dedup.line_dedup, {"Deleted"}),
    (mixing.mix_plan, {"_Size", "_target", "_copies"}),
]


@pytest.mark.parametrize("operator, replaced", OPERATORS, ids=lambda x: getattr(x, "__name__", ""))
def test_rows_keep_their_columns(odd, operator, replaced):
    """Every row comes out once, with all columns that the operator doesn't replace."""
    kept = [f"`{c}`" for c in odd.columns if c not in replaced and (operator is not line_dedup.line_dedup or c != "text")]
    out = operator(odd)
    key = lambda df: sorted(map(repr, (tuple(r) for r in df.select(*kept).collect())))
    assert key(out) == key(odd)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    empty = operator(odd.limit(0))
    assert empty.columns == out.columns and empty.count() == 0


def test_mix_gives_whole_rows(odd):
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    assert set(map(repr, out.collect())) <= set(map(repr, odd.collect())) and out.count() > 0
    assert mixing.mix(odd.limit(0)).count() == 0


@pytest.mark.parametrize("operator", [exact_dedup.exact_groups, licenses.license_scan, ppm.lm_scores, jaccard.similar_documents], ids=lambda x: x.__name__)
def test_rows_by_id(odd, operator):
    """Operators that return a row a row: as many, with the same ids."""
    ids = lambda df: sorted(repr(r[0]) for r in df.select("doc_id").collect())
    assert ids(operator(odd)) == ids(odd)
    assert operator(odd.limit(0)).count() == 0


def test_equal_rows_are_judged_alike(odd):
    got = [r for r in quality.quality(odd).collect() if r["text"] == PROSE * 3]
    assert len(got) == 4 and len({(r["n_words"], r["base_failed"], r["kept"]) for r in got}) == 1
    long = next(r for r in quality.quality(odd).collect() if (r["text"] or "").startswith("word"))
    assert long["n_words"] == 200_000 == long["n_repeat_words"] and long["base_failed"]
