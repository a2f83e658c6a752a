"""Documents whose sets of word shingles are similar, by PartEnum signatures.

Two sets of nearly equal size with Jaccard similarity t differ in few elements. Sizes fall into bands; in
each band the domain of shingles is cut into more parts than elements can differ, so that some parts of two similar
sets are equal, and a signature is a hash of what a set has in such a part. Sets that share a
signature are candidates; every candidate is checked on its whole sets.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilsift.llm.common import discard, documents, materialize, shuffle_partitions, tidy
from veilsift.llm.components import components
from veilsift.llm.quality import slices

U64 = np.uint64

#: A-Z to lower case, and all white space of the word rule to a space.
FOLD = bytes(32 if b in b"\t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


def scramble(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = x + U64((salt * BASE + BASE) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return scramble(np.arange(256, dtype=U64), 7)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), U64(base))
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps)
    return have[:n]


def _word_bounds(folded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums of all folded texts with single spaces, where each word begins and ends in them, and words per text."""
    data = np.frombuffer(b" ".join([*folded, b""]) if folded else b"", np.uint8)
    ends_of = np.cumsum(np.fromiter((len(r) + 1 for r in folded), np.int64, len(folded)))
    inside = data != 32
    before = np.concatenate(([False], inside[:-1]))
    first = np.flatnonzero(inside & ~before)
    per_text = np.diff(np.concatenate(([0], np.searchsorted(first, ends_of))))
    kept = inside | before
    data, inside = data[kept], inside[kept]
    begin = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1]))) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(~inside)
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(_byte_values()[data] * _powers(BASE, len(data)), dtype=U64)))
    return sums, begin, end, per_text


def _hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches: equal stretches have equal sums once their place is divided out."""
    return scramble((sums[end] - sums[begin]) * _powers(INVERSE, len(sums))[begin])


#: Bytes of text hashed at once; the prefix sums of these take eight times as much, a few times over.
HASHED_BYTES = 2 << 20


def portions(folded: list[bytes]) -> Iterator[list[bytes]]:
    """Consecutive texts of bounded size together, one text at least."""
    part: list[bytes] = []
    size = 0
    for t in folded:
        if part and size + len(t) > HASHED_BYTES:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def word_hashes(folded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of folded texts, in order, and how many each text has."""
    hashes, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for part in portions(folded):
        sums, begin, end, per_text = _word_bounds(part)
        hashes.append(_hashes(sums, begin, end))
        counts.append(per_text)
    return np.concatenate(hashes), np.concatenate(counts)


def shingle_sets(texts: list[str], words: int = 5) -> list[np.ndarray]:
    """The set of each text: sorted 64-bit hashes of its runs of words, many texts at once.

    A run's hash comes from prefix sums over the bytes of the folded texts with single spaces, so no
    run is ever built as a string. A text with fewer words is one run; without words its set is empty.
    """
    out = []
    for part in portions([t.encode("utf-8", "surrogatepass").translate(FOLD) for t in texts]):
        sums, begin, end, per_text = _word_bounds(part)
        at = 0
        for n in per_text.tolist():
            size = min(words, n)
            out.append(np.unique(_hashes(sums, begin[at : at + n - size + 1], end[at + size - 1 : at + n])) if n else np.zeros(0, U64))
            at += n
    return out


def digest(s: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; equal sets are one class from here on."""
    return xxhash.xxh3_128_digest(s.astype("<u8").tobytes()) if len(s) else None


class Bands:
    """Bands of set sizes for similarity num/den, and how many elements two similar sets may differ in."""

    def __init__(self, num: int = 80, den: int = 100):
        self.num, self.den = num, den
        self.low, self.high = [1], [den // num]

    def of(self, n: int) -> int:
        while self.high[-1] < n:
            self.low.append(self.high[-1] + 1)
            self.high.append(self.low[-1] * self.den // self.num)
        return int(np.searchsorted(self.high, n))

    def instances(self, n: int) -> list[int]:
        """The bands whose signatures a set of n elements takes: its own, and the next if that has sets similar to it."""
        b = self.of(n)
        return [b, b + 1] if n * self.den // self.num > self.high[b] else [b]

    def differ(self, b: int) -> int:
        """Most elements that two similar sets, of which none is larger than band b allows, can differ in."""
        self.of(self.low[b] if b < len(self.low) else self.high[-1] + 1)
        union = 2 * self.high[b] * self.den // (self.num + self.den)
        return union * (self.den - self.num) // self.den

    @lru_cache(maxsize=1000)  # noqa: B019 - a handful of instances a worker
    def partitions(self, b: int, parts: int, spoiled: int) -> int:
        """How many partitions let even the smallest sets that take part in band b expect enough that are not empty."""
        least = self.differ(b) // (spoiled + 1) + 1
        n = self.low[b] * self.num / self.den
        best = (-math.inf, least)
        for n1 in range(least, 2 * least + 1, 1 + least // 200):
            full = 1 - math.exp(-n * (parts - spoiled) / (n1 * parts))
            over = n1 * full ** math.comb(parts, spoiled) - least if spoiled < parts - 1 else (n1 * parts * full - self.differ(b) - 1) / parts
            if over >= 0.5:
                return n1
            best = max(best, (over, n1))
        return best[1]


#: The cuts of the domain that look for telling parts, each into half as many more partitions, and those that take any.
TELLING_TURNS, ANY_TURNS = 6, 64


def signatures(s: np.ndarray, bands: Bands, common: np.ndarray | None = None) -> np.ndarray:
    """All signatures of a set, sorted."""
    return np.unique(np.concatenate([np.zeros(0, U64), *(sig for _, sig in signatures_by_band(s, bands, common))]))


def signatures_by_band(s: np.ndarray, bands: Bands, common: np.ndarray | None = None, parts: int = 2, spoiled: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """The signatures of a set in each band that it takes part in. common: elements, sorted, that so many sets have that they tell little.

    In a band where sets differ in up to k elements, the domain is cut into n1 partitions and each
    into `parts` smaller ones. In more than n1 - 1 - k // (spoiled + 1) partitions two similar sets differ in at most
    `spoiled` of the smaller parts, and agree on one of the subsets of parts - spoiled of them: each subset is a
    signature. One without a telling element, be it empty or of common ones, is left out. That is safe for a set with
    more than k // (spoiled + 1) partitions whose subsets all tell (or, where subsets are single parts,
    with more than k parts that do): some of these no difference touches. A set with fewer takes further turns, with the
    domain cut anew and finer; a pair is found in the turn in which the first of its two sets stops, as both took
    it. Sets that never stop, because common elements are almost all they have, end with turns in which every element tells.
    """
    subsets = list(itertools.combinations(range(parts), parts - spoiled))
    tells = np.ones(len(s), bool)
    if common is not None and len(common) and len(s):
        tells = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] != s
    for b in bands.instances(len(s)):
        k = bands.differ(b)
        if k == 0:
            continue  # similar sets of this band are equal, and equal sets are one class already
        first = bands.partitions(b, parts, spoiled)
        out = []
        for turn in range(TELLING_TURNS + ANY_TURNS):
            n1 = int(first * 1.5**turn) if turn < TELLING_TURNS else first
            counted = tells if turn < TELLING_TURNS else slice(None)
            salt = b * 128 + turn + 1
            place = (scramble(s, salt) % U64(n1 * parts)).astype(np.int64)
            content = np.zeros(n1 * parts, U64)
            np.add.at(content, place, scramble(s, 0))
            count = np.bincount(place[counted], minlength=n1 * parts).reshape(n1, parts)
            content = content.reshape(n1, parts)
            full = np.stack([count[:, subset].sum(1) > 0 for subset in subsets], 1)
            for i, subset in enumerate(subsets):
                tag = (np.arange(n1, dtype=U64) * U64(len(subsets)) + U64(i)) * U64(BASE) + U64(salt)
                out.append(scramble(content[:, subset].sum(1, dtype=U64) ^ scramble(tag, 3), 5)[full[:, i]])
            if (full.sum() > k) if spoiled == parts - 1 else (full.all(1).sum() > k // (spoiled + 1)):
                break
        else:
            raise RuntimeError("no cut of the domain fills enough parts")
        yield b, np.unique(np.concatenate(out))


#: Bytes of a signature that are sent. Its pid tells some bits more; what chance makes equal is checked like any candidate.
KEY_BYTES = 5
SENT = "pid long, classes binary, counts binary, keys binary"
FOUND = "a binary, b binary, n long"

#: Signatures that one pid is to hold.
PID_SIGNATURES = 6 << 20
#: Members of a star that go to one task together with their leader, and bytes of sets compared in one task.
STAR_ROWS, BLOCK_BYTES = 256, 8 << 20


def pids_of_bands(sizes: dict[int, int], bands: Bands, least: int) -> tuple[dict[int, tuple[int, int]], int]:
    """For each band its first pid and how many it has, and the number of all. sizes: about how many elements sets of
    about a size have together.

    A set meets only sets of its own bands, so it goes to the pids of these: few, which keeps together what names it. There
    are as many pids as the signatures, about one an element, ask for, and about `least` if that is more.
    """
    load: dict[int, int] = {}
    for n, elements in sizes.items():
        for b in bands.instances(n):
            load[b] = load.get(b, 0) + elements
    most = min(PID_SIGNATURES, max(1, sum(load.values()) // least))
    out, at = {}, 0
    for b in sorted(load):
        out[b] = at, -(-load[b] // most)
        at += out[b][1]
    return out, max(1, at)


def _send(pids: dict[int, tuple[int, int]], words: int, num: int, den: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for whole in batches:
            for batch in slices(whole, rows=20_000):
                sets: dict[bytes, np.ndarray] = {}
                for s in shingle_sets([t or "" for t in batch.column(0).to_pylist()], words):
                    if len(s):
                        sets.setdefault(digest(s), s)
                names = list(sets)
                sent: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for i, s in enumerate(sets.values()):
                    for b, sig in signatures_by_band(s, bands, common):
                        at, n = pids.get(b, (0, 1))
                        sent.append((sig, ((sig >> U64(32)) * U64(n) >> U64(32)).astype(np.int64) + at, np.full(len(sig), i)))
                if not sum(len(x[0]) for x in sent):
                    continue
                sig, pid, doc = (np.concatenate(x) for x in zip(*sent, strict=True))
                order = np.argsort(pid, kind="stable")
                sig, doc, pid = sig[order], doc[order], pid[order]
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(pid)) + 1, [len(pid)]))
                rows: list[tuple] = []
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    there, count = np.unique(doc[a:b], return_counts=True)
                    keys = np.ascontiguousarray(sig[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])
                    rows.append((int(pid[a]), b"".join(names[i] for i in there.tolist()), count.astype("<u4").tobytes(), keys.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["pid", "classes", "counts", "keys"])

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Candidates of the signatures of one pid: each class of a group that shares a signature, with the group's least
    class, and the size of the largest such group. A group of n classes gives n - 1 pairs, and a pair is given once."""
    keys, classes = [np.zeros(0, np.uint64)], [np.zeros(0, "V16")]
    for c, n, k in zip(table["classes"].to_pylist(), table["counts"].to_pylist(), table["keys"].to_pylist(), strict=True):
        classes.append(np.repeat(np.frombuffer(c, "V16"), np.frombuffer(n, "<u4")))
        wide = np.zeros((len(k) // KEY_BYTES, 8), np.uint8)
        wide[:, :KEY_BYTES] = np.frombuffer(k, np.uint8).reshape(-1, KEY_BYTES)
        keys.append(wide.view("<u8").ravel())
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key = key[order]
    again = np.zeros(len(key), bool)
    again[1:] = key[1:] == key[:-1]
    again[:-1] |= again[1:]
    key, cls = key[again], np.concatenate(classes)[order[again]]
    if not len(key):
        return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
    # V16 has no order in numpy: two big-endian halves have.
    halves = np.ascontiguousarray(cls).view(">u8").reshape(-1, 2).astype(U64)
    order = np.lexsort((halves[:, 1], halves[:, 0], key))
    key, halves = key[order], halves[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (halves[1:] != halves[:-1]).any(1)))
    key, halves = key[fresh], halves[fresh]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    rows = np.flatnonzero(np.arange(len(key)) != np.repeat(start, size))
    both = np.concatenate((halves[np.repeat(start, size)[rows]], halves[rows]), axis=1)
    n = np.repeat(size, size)[rows]
    order = np.lexsort((-n, both[:, 3], both[:, 2], both[:, 1], both[:, 0]))
    both, n = both[order], n[order]
    first = np.concatenate(([True], (both[1:] != both[:-1]).any(1)))[: len(both)]
    raw = both[first].astype(">u8").tobytes()
    halves_of = lambda at: pa.array([raw[i + at : i + at + 16] for i in range(0, len(raw), 32)], pa.binary())
    return pa.table({"a": halves_of(0), "b": halves_of(16), "n": pa.array(n[first], pa.int64())})


def sketch(s: np.ndarray) -> bytes:
    """A bit for each of about 2n places that tells whether an odd number of a set's elements fall there. Places
    that two sketches tell apart are no more than elements in which the sets differ."""
    places = max(64, 1 << int(2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & U64(places - 1)).astype(np.int64), minlength=places) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound on how many elements two sets differ in, from their sketches."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def sets_of(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """_id, _row (a number that rows equal in id and text share), n_shingles, the class of each row's set and its sketch
    (null if empty); at the first row of a batch, the elements that at least OFTEN different sets of the batch have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, rows=20_000):
                sets = shingle_sets([t or "" for t in batch.column(2).to_pylist()], words)
                names = [digest(s) for s in sets]
                once = {n: s for n, s in zip(names, sets, strict=True) if n}
                element, n = np.unique(np.concatenate([*once.values(), np.zeros(0, U64)]), return_counts=True)
                shared = [element[n >= OFTEN].astype("<u8").tobytes(), *[None] * (len(sets) - 1)]
                named = [pa.array(x, pa.binary()) for x in (names, [sketch(s) if len(s) else None for s in sets], shared)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), *named], names=["_id", "_row", "n_shingles", "class", "sketch", "common"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _keyed(docs, id_col, text_col).mapInArrow(tidy(run), f"_id {kind}, _row long, n_shingles long, class binary, sketch binary, common binary")


#: A column that no input has.
KEY = "veilsift row number"


def row_number(id_col: str, text_col: str) -> Column:
    """A number that tells rows apart which differ in id or text, but for collisions: what it finds is compared again."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col(f"`{id_col}`").isNull())


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("_id"), row_number(id_col, text_col).alias("_row"), F.col(f"`{text_col}`").alias("_text"))


#: An element is common if so many different sets of one batch have it. At most MOST_COMMON are known, in as many
#: times 8 bytes: which ones they are bears on how many candidates there are, not on what is found.
OFTEN, MOST_COMMON = 3, 1 << 17


def common_elements(sets: DataFrame, most: int = MOST_COMMON) -> np.ndarray:
    """The elements that are common in most batches, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, "<i8"))], names=["element"])

    counted = sets.where("common IS NOT NULL").select("common").mapInArrow(run, "element long").groupBy("element").count()
    rows = counted.orderBy(F.col("count").desc(), "element").limit(most).select("element").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).astype(U64))


def _texts(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """A text of each class in pairs: that of any row that has its set, with id or without."""

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, rows=20_000):
                own = [digest(s) for s in shingle_sets([t or "" for t in batch.column(1).to_pylist()], words)]
                yield batch.filter(pa.array([a == b for a, b in zip(own, batch.column(0).to_pylist(), strict=True)], pa.bool_()))

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    chosen = classes.select("class", "_row").join(wanted, "class", "left_semi")
    # Which texts are wanted grows with the table: the same join at every size. Repeated rows lie together after it.
    texts = _keyed(docs, id_col, text_col).join(chosen.hint("merge"), "_row").select("_row", "class", "_text").distinct()
    return texts.select("class", "_text").mapInArrow(tidy(right), "class binary, _text string")


def _beside_leaders(pairs: DataFrame, of_classes: DataFrame, *columns: str) -> DataFrame:
    """(a, salt, b, columns) of the members of pairs, each after a row of its leader, where b is null. A class that
    leads thousands comes once for every STAR_ROWS or so of them, so no task gets all pairs of one leader."""
    leaders = pairs.select("a", "salt", F.lit(None).cast("binary").alias("b"), F.col("a").alias("class")).distinct()
    uses = leaders.unionByName(pairs.select("a", "salt", "b", F.col("b").alias("class")))
    rows = uses.hint("merge").join(of_classes.select("class", *columns), "class").select("a", "salt", "b", *columns)
    return rows.repartition(shuffle_partitions(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))


def _likely(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose sketches don't rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own, size = None, b"", 0
        for batch in batches:
            near = []
            for a, b, n, x in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if b is None:
                    leader, own, size = a, x, n
                near.append(b is not None and a == leader and least_difference(own, x) * (den + num) <= (size + n) * (den - num))
            yield batch.select(["a", "salt", "b"]).filter(pa.array(near, pa.bool_()))

    return _beside_leaders(pairs, classes, "n_shingles", "sketch").mapInArrow(tidy(run), "a binary, salt long, b binary")


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return den * shared >= num * (len(x) + len(y) - shared)


def _check(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that link, on whole texts. Of a leader's text nothing but its set is kept while its members pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.zeros(0, U64)
        for whole in batches:
            for batch in slices(whole):
                sets = shingle_sets([t or "" for t in batch.column(3).to_pylist()], words)
                found = []
                for a, b, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), sets, strict=True):
                    if b is None:
                        leader, own = a, s
                    elif a == leader and linked(own, s, num, den):
                        found.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return _beside_leaders(pairs, texts, "_text").mapInArrow(tidy(run), "a binary, b binary")


def joining_links(sets: list[np.ndarray], comps: list, part: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links between different components: enough to join whatever all links between these sets join. part: 0 or 1;
    if both come, only sets of different parts are compared.

    Sets of the largest component aren't compared with one another. Every other set is compared with all that
    aren't in its component by then: sketches in one matrix rule most out, the rest are compared element by element.
    """
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    side = np.asarray(part)
    across = len(np.unique(side)) > 1
    label = np.unique(np.array([c.hex() for c in comps]), return_inverse=True)[1]
    places = max(64, 1 << int(4 * size.max() - 1).bit_length())
    bits = np.zeros((n, places // 64), U64)
    for i, s in enumerate(sets):
        odd = (np.bincount((s & U64(places - 1)).astype(np.int64), minlength=places) & 1).astype(np.uint8)
        bits[i] = np.packbits(odd, bitorder="little").view("<u8")
    done = np.zeros(n, bool)
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(label != np.argmax(np.bincount(label))).tolist():
        done[i] = True
        others = np.flatnonzero((label != label[i]) & ~done & ((side != side[i]) | (not across)))
        apart = np.bitwise_count(bits[others] ^ bits[i]).sum(1).astype(np.int64)
        near = apart * (den + num) <= (size[others] + size[i]) * (den - num)
        for j in others[near][np.argsort(apart[near], kind="stable")].tolist():
            if label[j] != label[i] and linked(sets[i], sets[j], num, den):
                out.append((i, j))
                label[label == label[i]] = label[j]
    return out


def _across_components(pairs: DataFrame, settled: DataFrame, classes: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links between members of one star that aren't in one component yet.

    A star is a least class with all that share a signature of three classes or more with it. Two members of a
    group are members of its least class's star, and a pair that several groups hold comes up once. A star whose sets exceed
    BLOCK_BYTES is cut into parts, and every two parts are one task, so that none gets an unbounded group.
    What comes out of a task joins components: fewer links than it has members.
    """

    def close(table: pa.Table) -> pa.Table:
        nodes, u = table["node"].to_pylist(), table["u"].to_pylist()
        sets = shingle_sets([t or "" for t in table["_text"].to_pylist()], words)
        found = joining_links(sets, table["comp"].to_pylist(), [int(x != u[0]) for x in u], num, den)
        return pa.table({side: pa.array([nodes[f[i]] for f in found], pa.binary()) for i, side in enumerate("ab")})

    wide = pairs.where("n > 2")
    members = wide.select("a", "salt", F.col("b").alias("node")).unionByName(wide.select("a", F.lit(0).cast("long").alias("salt"), F.col("a").alias("node")).distinct())
    placed = members.join(settled, "node", "left").join(classes.select(F.col("class").alias("node"), "n_shingles"), "node")
    placed = materialize(placed.select("a", "salt", "node", F.coalesce("comp", "node").alias("comp"), "n_shingles"), "placed")
    stars = placed.groupBy("a").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.sum(F.col("n_shingles") * 8).alias("bytes")).where("x <> y")
    stars = stars.select("a", F.ceil(F.col("bytes") / BLOCK_BYTES).alias("parts"))
    salted = placed.select("a", "salt").distinct().join(stars, "a")
    dealt = placed.join(salted, ["a", "salt"]).select("a", "node", "comp", F.pmod(F.xxhash64("node"), F.col("parts")).alias("u"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("v"))
    blocks = dealt.select("a", "node", "comp", "u", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))
    whole = blocks.join(texts.select(F.col("class").alias("node"), "_text"), "node")
    links = materialize(whole.groupBy("a", "lo", "hi").applyInArrow(close, "a binary, b binary"), "closing")
    discard(placed)
    return links


def _candidates(docs: DataFrame, text_col: str, classes: DataFrame, common: np.ndarray, words: int, num: int, den: int) -> DataFrame:
    """(a, b, n, salt): classes that share a signature, with the least that does, and the size of the largest such group."""
    # A row for each quarter more in size: some dozens, however large the table.
    sizes = classes.groupBy(F.floor(F.log(1.25, "n_shingles")).alias("size")).agg(F.sum("n_shingles")).collect()
    pids, n_pids = pids_of_bands({int(1.25 ** (size + 0.5)): n for size, n in sizes}, Bands(num, den), shuffle_partitions(docs.sparkSession))
    sent = docs.select(F.col(f"`{text_col}`").alias("_text")).mapInArrow(tidy(_send(pids, words, num, den, common)), SENT)
    pairs = sent.repartition(n_pids, "pid").groupBy("pid").applyInArrow(_meet, FOUND).groupBy("a", "b").agg(F.max("n").alias("n"))
    return materialize(pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.floor(F.col("n") / STAR_ROWS)))), "pairs")


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int, most_common: int = MOST_COMMON) -> DataFrame:
    """_id, _row, n_shingles, class, comp (a class that stands for the component) and component_id of every row."""
    sets = materialize(sets_of(docs, id_col, text_col, words), "sets")
    own = [F.min("_id").alias("own"), F.min("_row").alias("_row"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")]
    classes = materialize(sets.where("class IS NOT NULL").groupBy("class").agg(*own), "classes")
    pairs = _candidates(docs, text_col, classes, common_elements(sets, most_common), words, num, den)
    likely = materialize(_likely(pairs, classes, num, den), "likely")
    read = likely.select("a", "b").unionByName(pairs.where("n > 2").select("a", "b"))
    texts = materialize(_texts(docs, id_col, text_col, classes, read, words), "texts")
    links = materialize(_check(likely, texts, words, num, den), "links")
    discard(likely)
    settled = components(links)
    more = _across_components(pairs, settled, classes, texts, words, num, den)
    discard(pairs, texts)
    if more.take(1):
        settled = components(links.unionByName(more))
    discard(links, more)

    least = classes.select("class", "own")
    joined = least.join(settled, least["class"] == settled["node"], "left").select("class", F.coalesce("comp", "class").alias("comp"), "own")
    roots = joined.groupBy("comp").agg(F.min("own").alias("component_id"))
    by_class = materialize(joined.select("class", "comp").join(roots, "comp"), "components")
    discard(classes)
    return sets.select("_id", "_row", "n_shingles", "class").join(by_class, "class", "left")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of docs: id, n_shingles and component_id, the smallest id that links reach.

    Documents link when den * |intersection| >= num * |union| for their sets of runs of `words` words (whole
    texts, A-Z lower-cased). Sets are held as 64-bit hashes of runs and named by 128-bit digests.

    1. Equal sets become one class, so exact copies cost one set a batch, not one a copy. Elements that many sets of
       a batch have (shared passages) are noted: a signature without any other element is made only for sets that have few others.
    2. Signatures go to their pid packed in byte strings of some thousands, sorted there and paired: each group of
       classes that share one gives pairs with its least class only, never all pairs. Each band has as many pids as its
       signatures ask for.
    3. A sketch of each set bounds from below in how much two sets differ; pairs that it lets pass are
       checked on whole texts, and links joined to components.
    4. Members of a group that are in different components by now are compared in blocks of bounded bytes, where links are
       told by whole sets, and only such links come out as join components. Then components are final.

    A text without words (null, empty, white space) has no shingles and is its own component. Rows without id
    link like any others, and their texts may join documents that don't link with one another; they name no component, so one
    whose rows all lack an id has none. Repeated rows are equals, and so are rows that share an id but not their text
    in all but name. An empty table gives an empty table; other columns are ignored, whatever their names.
    """
    rows = _grouped(docs, id_col, text_col, words, num, den)
    return rows.select(F.col("_id").alias(id_col), "n_shingles", F.coalesce("component_id", F.when(F.col("class").isNull(), F.col("_id"))).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component: that with the smallest id, rows without id last, and of rows that share the
    id the one whose hash is least. Rows without words link with nothing and stay. Rows equal in id and text are one
    document, of which one row stays. An empty table stays empty. Columns stay, whatever their names."""
    rows = _grouped(docs, id_col, text_col, words, num, den)
    each = rows.groupBy("_id", "_row", "comp").agg(F.count(F.lit(1)).alias("n"))
    alone = F.when(F.col("comp").isNull(), F.struct("_id", "_row"))
    first = F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "_row", "n")).alias("first")
    chosen = materialize(each.groupBy("comp", alone.alias("alone")).agg(first).select("first._id", "first._row", "first.n"), "chosen")
    keyed = docs.withColumn(KEY, row_number(id_col, text_col))
    kept = keyed.join(chosen.select(F.col("_id").alias(f"{KEY}_id"), F.col("_row").alias(f"{KEY}_of")), (F.col(KEY) == F.col(f"{KEY}_of")) & F.col(f"`{id_col}`").eqNullSafe(F.col(f"{KEY}_id")), "left_semi")
    if chosen.where("n > 1").take(1):
        kept = kept.dropDuplicates([KEY, id_col])
    return kept.drop(KEY)


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir).select("doc_id", "text"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS u(i) WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""
