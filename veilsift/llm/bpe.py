"""Byte-level BPE by replaying merges over the distinct words of a corpus shard.

Words never influence each other, so the replay can run where the texts lie: each Arrow batch is a shard
whose distinct words share one inverted index from token pair (by its rank) to word positions. No text is
shuffled, nothing grows with the corpus, and a lost task repeats only its own shard.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilsift.llm.common import ddl, documents, numbered, others, tick, tidy
from veilsift.llm.quality import slices

NONE = np.int32(2**31 - 1)
#: Bytes of text whose distinct words are replayed together, and about how many of ids and decoded texts are given at once.
SHARD_BYTES, GIVEN_BYTES = 16 << 20, 4 << 20

RESULT = "n_tokens long, ids binary, decoded binary"


class Ranks:
    """A vocabulary given as bytes with ranks, and the pairs that its merges can join."""

    def __init__(self, rank_of: dict[bytes, int]):
        self.rank_of = rank_of
        self.token = [b""] * (max(rank_of.values(), default=-1) + 1)
        for t, r in rank_of.items():
            self.token[r] = t
        self.single = np.full(256, -1, np.int32)
        pairs = {}
        for t, r in rank_of.items():
            if len(t) == 1:
                self.single[t[0]] = r
            for i in range(1, len(t)):
                a, b = rank_of.get(t[:i]), rank_of.get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        if (self.single < 0).any():
            raise ValueError("a byte-level vocabulary has a rank for each byte")
        self.keys = np.fromiter(sorted(pairs), np.int64, len(pairs))
        self.ranks = np.fromiter((pairs[k] for k in self.keys.tolist()), np.int32, len(pairs))

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that pairs join to, NONE where they don't."""
        if not len(self.keys):
            return np.full(len(a), NONE)
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


@lru_cache(maxsize=4)
def ranks_from(path: str) -> Ranks:
    with open(path, "rb") as f:
        return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def encode_words(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of each word: all ids one after another, and where each word's begin (with the end).

    As the public tokenizer does, a word that is a token is that token; otherwise the adjacent pair of
    lowest rank is joined, the leftmost of equals first, until no pair has a rank. All words together are
    one chain of positions. positions_of holds, for each rank, the positions where a pair of that rank
    begins; the ranks are applied in order and only the two neighbours of a join get a new pair.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.concatenate(([0], np.cumsum(lengths)))
    n = int(begins[-1])
    token = ranks.single[np.frombuffer(b"".join(words), np.uint8)]
    # Places fit 32 bits: an Arrow column has less than 2 GB of text.
    word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    left, right = np.arange(-1, n - 1, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
    first = begins[:-1][lengths > 0]
    left[first] = -1
    right[begins[1:][lengths > 0] - 1] = -1
    alive = np.ones(n, bool)
    whole = np.fromiter((ranks.rank_of.get(w, -1) for w in words), np.int64, len(words))
    known = np.flatnonzero((whole >= 0) & (lengths > 0))
    pair = np.full(n, NONE, np.int32)
    inner = np.flatnonzero((right >= 0) & (whole[word] < 0)) if n else np.zeros(0, np.int64)
    pair[inner] = ranks.of_pairs(token[inner], token[right[inner]])
    alive[whole[word] >= 0] = False
    alive[begins[known]] = True
    token[begins[known]] = whole[known]

    positions_of: dict[int, list[np.ndarray]] = defaultdict(list)
    waiting: list[int] = []

    def file_under(at: np.ndarray) -> None:
        at = at[pair[at] != NONE]
        if not len(at):
            return
        at = at[np.argsort(pair[at], kind="stable")]
        of = pair[at]
        cuts = np.flatnonzero(np.diff(of)) + 1
        for rank, part in zip(of[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
            if rank not in positions_of:
                heapq.heappush(waiting, rank)
            positions_of[rank].append(part)

    file_under(inner)
    while waiting:
        rank = heapq.heappop(waiting)
        lists = positions_of.pop(rank)
        at = np.concatenate(lists)
        at = np.sort(at[alive[at] & (pair[at] == rank)])
        if not len(at):
            continue
        at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        # One position a word at a time where positions touch, or where a join could make a pair that
        # comes before this rank; the rest of that word waits for its next turn.
        touching = np.zeros(len(at), bool)
        if len(at) > 1:
            same = word[at[1:]] == word[at[:-1]]
            touching[1:] = same & (right[at[:-1]] == at[1:])
            if touching.any():
                run = np.flatnonzero(~touching)
                place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                touching = place % 2 == 1
            if rank in _early(ranks):
                touching[1:] |= same
        later = at[touching]
        at = at[~touching]
        gone = right[at]
        after = right[gone]
        token[at] = rank
        right[at] = after
        has = after >= 0
        left[after[has]] = at[has]
        alive[gone] = False
        pair[gone] = NONE
        before = left[at]
        before = before[before >= 0]
        pair[at] = NONE
        pair[at[has]] = ranks.of_pairs(token[at[has]], token[after[has]])
        pair[before] = ranks.of_pairs(token[before], token[right[before]])
        file_under(np.concatenate((at, before)))
        later = later[alive[later] & (pair[later] == rank)]
        if len(later):
            file_under(later)

    starts = np.concatenate(([0], np.cumsum(alive)))[begins]
    return token[alive], starts


_EARLY: dict[int, tuple[Ranks, set[int]]] = {}


def _early(ranks: Ranks) -> set[int]:
    """Tokens that can join to one of lower rank; for most vocabularies there are none."""
    if id(ranks) not in _EARLY:
        a, b = ranks.keys >> 32, ranks.keys & 0xFFFFFFFF
        _EARLY[id(ranks)] = ranks, {*a[ranks.ranks <= a].tolist(), *b[ranks.ranks <= b].tolist()}
    return _EARLY[id(ranks)][1]


def encode_texts(texts: list[str], ranks: Ranks, pattern: str) -> Iterator[np.ndarray]:
    """Token ids of each text, without special tokens.

    Texts fall into pieces that end before each space after anything but white space. No match of the
    pattern crosses such a place or looks beyond it, so the pattern runs once over each distinct piece.
    """
    find = _compiled(pattern).findall
    pieces: dict[str, int] = _numbering()
    heads: dict[str, int] = _numbering()
    rows = []
    for t in texts:
        if _RAGGED.search(t):
            parts = _BREAK.split(t)
            rows.append((-1, np.fromiter((pieces[p[1:]] if p[:1] == " " else -1 - heads[p] for p in parts), np.int32, len(parts))))
        else:
            parts = t.split(" ")
            rows.append((heads[parts.pop(0)], np.fromiter(map(pieces.__getitem__, parts), np.int32, len(parts))))
    words: dict[str, int] = _numbering()
    parsed, bounds = array("i"), array("q", [0])
    for p in itertools.chain((" " + p for p in pieces), heads):
        parsed.extend(map(words.__getitem__, find(p)))
        bounds.append(len(parsed))
    n_pieces = len(pieces)
    # What is done with goes before the next large things come.
    distinct = [w.encode() for w in words]
    del words, pieces, heads
    ids, starts = encode_words(distinct, ranks)
    del distinct
    every = np.frombuffer(parsed, np.int32) if len(parsed) else np.zeros(0, np.int32)
    ids, ends = _gather(ids, starts[every], np.diff(starts)[every])
    starts = np.concatenate(([0], ends))[np.frombuffer(bounds, np.int64)]
    length = np.diff(starts)
    for head, row in rows:
        if head >= 0:
            row = np.concatenate(([n_pieces + head], row))
        else:
            row = np.where(row < 0, n_pieces - 1 - row, row)
        yield _gather(ids, starts[row], length[row])[0]


#: White space before a space; and where a piece ends.
_RAGGED, _BREAK = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")


def _numbering() -> dict[str, int]:
    """Numbers keys as they come."""
    d: dict[str, int] = defaultdict()
    d.default_factory = d.__len__
    return d


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of values one after another, and where each ends."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - ends + lengths, lengths) + np.arange(total)], ends


@lru_cache(maxsize=4)
def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def bpe(docs: DataFrame, path: str, pattern: str, text_col: str = "text", digests: bool = False) -> DataFrame:
    """docs without its text, with n_tokens, ids (little-endian unsigned 32-bit integers) and decoded
    (the bytes the ids stand for); with digests, ids_sha256 and decoded_sha256 in place of the two.

    path is a file of ranks that every executor can open; pattern splits texts into words. Null counts as
    empty and gives no tokens. Texts may be of any length, rows may repeat, other columns pass unchanged;
    columns named like the results, whatever the case, are replaced. A table without rows gives none.
    """
    added = {"n_tokens": pa.int64()} | ({"ids_sha256": pa.string(), "decoded_sha256": pa.string()} if digests else {"ids": pa.binary(), "decoded": pa.binary()})
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    rest = others(docs, text_col, *added)
    schema = ddl(rest, *(f"{c} {names[t]}" for c, t in added.items()))
    rest_names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_from(path)
        bytes_of = ranks.token.__getitem__
        for whole in batches:
            for batch in slices(whole, len(rest_names), rows=len(whole), most=SHARD_BYTES):
                at, held, out = 0, 0, {c: [] for c in added}
                for end, ids in enumerate(encode_texts([t or "" for t in batch.column(len(rest_names)).to_pylist()], ranks, pattern), 1):
                    decoded = b"".join(map(bytes_of, ids.tolist()))
                    raw = ids.astype("<u4").tobytes()
                    values = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest()) if digests else (len(ids), raw, decoded)
                    for c, v in zip(added, values, strict=True):
                        out[c].append(v)
                    held += len(raw) + len(decoded)
                    if held >= GIVEN_BYTES or end == len(batch):
                        kept = batch.slice(at, end - at)
                        yield pa.RecordBatch.from_arrays([kept.column(i) for i in range(len(rest_names))] + [pa.array(out[c], t) for c, t in added.items()], names=[*rest_names, *added])
                        at, held, out = end, 0, {c: [] for c in added}

    return docs.select(*numbered(rest), F.col(tick(text_col)).alias("_text")).mapInArrow(tidy(run), schema)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
