"""Language-model scores by prediction by partial matching, over a byte-context trie of the whole corpus.

The model is learned from every training text and never held in one place. Texts are dealt into blocks of some
megabytes. A block knows its distinct byte strings of the trie's depth and its distinct words; only
those travel, packed, to the partition that owns them, and what comes back is one number for each, in the order
sent. So what is moved follows the number of distinct things in blocks, and no task holds more than a block or its
share of distinct things.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilsift.llm.common import documents, materialize, shuffle_partitions
from veilsift.llm.jaccard import FOLD, portions, scramble, word_hashes

U64 = np.uint64
#: Bytes of context of the longest prediction. With one more byte, a path of the trie is five bytes.
ORDER = 4
#: Before the first byte of a text and after its last: a byte that UTF-8 never has.
EDGE = b"\xff"
BLOCK_BYTES = 4 << 20
#: Bytes of text a partition of owned things is to stand for, so that there are as many as the table asks for.
OWNED_BYTES = 32 << 20

TERMS = "kind string, pid long, block long, keys binary, counts binary, tokens long"
REPLIES = "kind string, pid long, block long, reply binary, distinct long"
PARTS = "_id {id}, _held boolean, n_words long, known_words long, word_logs double, byte_logs double"


def held_out(id_col: Column, modulus: int = 7, remainder: int = 2) -> Column:
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % modulus == remainder


def paths(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trie's paths that texts take: for every byte and every end, the number of its path; the
    distinct paths (ORDER + 1 bytes as one integer), sorted; and how many bytes each text has, with its end."""
    parts = [_paths(p) for p in portions(texts)]
    path = np.unique(np.concatenate([np.zeros(0, np.int64), *(p for _, p, _ in parts)]))
    node = np.concatenate([np.zeros(0, np.int32), *(np.searchsorted(path, p).astype(np.int32)[n] for n, p, _ in parts)])
    return node, path, np.concatenate([np.zeros(0, np.int64), *(n for _, _, n in parts)])


def _paths(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """paths() of some megabytes, unsorted. The trie grows a level at a time for all places together: a node and the
    next byte give the next node."""
    data = np.frombuffer(b"".join(EDGE * ORDER + t + EDGE for t in texts), np.uint8)
    length = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    places = np.ones(len(data), bool)
    begins = np.cumsum(length + ORDER) - length - ORDER
    places[((begins + length)[:, None] + np.arange(ORDER)).ravel()] = False
    place = np.flatnonzero(places).astype(np.int32 if len(data) < 2**31 else np.int64)
    present = np.flatnonzero(np.bincount(data, minlength=256))
    symbol = np.zeros(256, np.uint8)
    symbol[present] = np.arange(len(present))
    symbols = symbol[data]
    node, path, wide = symbols[place].astype(np.int32), present.astype(np.int64), len(present)
    for k in range(1, ORDER + 1):
        size = len(path) * wide
        code = node.astype(np.int32 if size < 2**31 else np.int64)
        code *= wide
        code += symbols[k:][place]
        if size <= 2 * len(code) + (1 << 20):
            seen = np.zeros(size, bool)
            seen[code] = True
            found = np.flatnonzero(seen)
            node = (np.cumsum(seen, dtype=np.int32) - 1)[code]
        else:
            found, node = np.unique(code, return_inverse=True)
            node = node.astype(np.int32)
        path = path[found // wide] << 8 | present[found % wide]
    return node, path, length


def owner(key: np.ndarray, n_pids: int) -> np.ndarray:
    """Where a key belongs. It rises with the key, so sorted keys come sorted by owner."""
    return ((key >> U64(32)) * U64(n_pids) >> U64(32)).astype(np.int64)


def _block_terms(texts: list[bytes], train: np.ndarray) -> dict[str, tuple[np.ndarray, ...]]:
    """Of a block: the sorted keys of its paths and words, in that order what each stands for, how often training
    texts have it, and for every place in the texts the number of its key."""
    node, path, length = paths(texts)
    count, learned = np.zeros(len(path), np.int64), np.repeat(train, length)
    for a in range(0, len(node), 1 << 20):
        count += np.bincount(node[a : a + (1 << 20)][learned[a : a + (1 << 20)]], minlength=len(path))
    key = scramble(path.astype(U64))
    order = np.argsort(key)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    hashes, words = word_hashes([t.translate(FOLD) for t in texts])
    distinct, which = np.unique(hashes, return_inverse=True)
    seen = np.bincount(which[np.repeat(train, words)], minlength=len(distinct))
    return {"path": (key[order], path[order], count[order], rank[node], length), "word": (distinct, distinct, seen, which, words)}


def _whole(table: pa.Table) -> tuple[list[bytes], np.ndarray]:
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in table["_text"].to_pylist()]
    return texts, ~np.array(table["_held"].to_pylist(), bool)


def _collect(table: pa.Table, n_pids: int) -> pa.Table:
    texts, train = _whole(table)
    block = table["_block"][0].as_py()
    rows = []
    for kind, (key, stands_for, count, _, _) in _block_terms(texts, train).items():
        pid = owner(key, n_pids)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(pid)) + 1, [len(pid)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b > a:
                raw = np.ascontiguousarray(stands_for[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _WIDTH[kind]])
                rows.append((kind, int(pid[a]), block, raw.tobytes(), _pack(count[a:b]), int(count[a:b].sum())))
    return _table(rows, TERMS)


_WIDTH = {"path": ORDER + 1, "word": 8}
_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table({n: pa.array(c, _TYPES[k]) for c, (n, k) in zip(columns, fields, strict=True)})


def _pack(count: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs; the first byte says how many."""
    top = int(count.max()) if len(count) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + count.astype(f"<u{width}").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _keys(raw: bytes, kind: str) -> np.ndarray:
    width = _WIDTH[kind]
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return wide.view("<u8").ravel()


def _sum(table: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of the blocks' lists with the sums of their counts, and each list's keys as numbers of these."""
    lists = [_keys(k, kind) for k in table["keys"].to_pylist()]
    counts = np.concatenate([_unpack(c) for c in table["counts"].to_pylist()])
    distinct, which = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, which, counts)
    return distinct, total, np.split(which, np.cumsum([len(x) for x in lists])[:-1])


def _path_totals(table: pa.Table) -> pa.Table:
    distinct, total, _ = _sum(table, "path")
    return pa.table({"path": pa.array(distinct.astype(np.int64)), "count": pa.array(total)})


def _word_replies(table: pa.Table) -> pa.Table:
    _, total, lists = _sum(table, "word")
    known = int((total > 0).sum())
    rows = [("word", p, b, _pack(total[x]), known if i == 0 else 0) for i, (p, b, x) in enumerate(zip(table["pid"].to_pylist(), table["block"].to_pylist(), lists, strict=True))]
    return _table(rows, REPLIES)


class Level:
    """Counts of (context, byte) at one order, with what escaping from it leaves to the next."""

    def __init__(self, code: np.ndarray, count: np.ndarray):
        some = count > 0
        self.code, which = np.unique(code[some], return_inverse=True)
        self.count = np.zeros(len(self.code), np.int64)
        np.add.at(self.count, which, count[some])
        self.context, self.of = np.unique(self.code >> 8, return_inverse=True)
        self.n = np.zeros(len(self.context), np.int64)
        np.add.at(self.n, self.of, self.count)
        self.d = np.bincount(self.of, minlength=len(self.context))
        self.excluded = np.zeros(len(self.context), np.int64)

    def exclude(self, lower_count: np.ndarray) -> None:
        """lower_count: for each code, how often the next lower order has its byte. Their sum in a context
        is the mass that escaping from the context rules out there."""
        np.add.at(self.excluded, self.of, lower_count)

    def counts_of(self, code: np.ndarray) -> np.ndarray:
        return _find(self.code, self.count, code)

    def at(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _find(self.context, self.n, context), _find(self.context, self.d, context), _find(self.context, self.excluded, context)


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of keys, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def path_logs(path: np.ndarray, count: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 of the probability of each path's last byte after the others.

    path and count: all paths of the corpus whose last two context bytes are among theirs, with training counts. pairs:
    256 x 256 training counts of a byte after one byte, of the whole corpus. In a context seen n times with d
    different bytes, a byte seen c times has probability c / (n + d) and escaping has d / (n + d). After an
    escape the bytes of the longer context are out of question, so they are taken from n and d of the
    shorter one. A context never seen is passed over; below the empty one all bytes left are alike.
    """
    byte = path & 0xFF
    single = pairs.sum(0)
    levels = {k: Level(path & ((1 << 8 * (k + 1)) - 1), count) for k in range(ORDER, 1, -1)}
    one = np.arange(65536)
    levels[1] = Level(one, pairs.ravel())
    levels[0] = Level(np.arange(256), single)
    for k in range(ORDER, 0, -1):
        levels[k].exclude(levels[k - 1].counts_of(levels[k].code & ((1 << 8 * k) - 1)))
    log = np.zeros(len(path))
    open_ = np.ones(len(path), bool)
    gone_n, gone_d = np.zeros(len(path), np.int64), np.zeros(len(path), np.int64)
    for k in range(ORDER, -1, -1):
        code = path & ((1 << 8 * (k + 1)) - 1)
        n, d, excluded = levels[k].at(code >> 8)
        c = levels[k].counts_of(code)
        left_n, left_d = n - gone_n, d - gone_d
        hit = open_ & (c > 0)
        log[hit] += np.log10(c[hit] / (left_n + left_d)[hit])
        open_ &= ~hit
        escape = open_ & (left_d > 0)
        log[escape] += np.log10((left_d / np.maximum(left_n + left_d, 1))[escape])
        gone_n, gone_d = excluded, d
    log[open_] -= np.log10(256 - np.count_nonzero(single))
    return log


def _model(table: pa.Table, pairs: np.ndarray) -> pa.Table:
    path = table["path"].to_numpy()
    return pa.table({"path": pa.array(path), "log": pa.array(path_logs(path, table["count"].to_numpy(), pairs))})


def _path_replies(model: pa.Table, terms: pa.Table) -> pa.Table:
    keys, logs = model["path"].to_numpy(), model["log"].to_numpy()
    order = np.argsort(keys)
    keys, logs = keys[order], logs[order]
    rows = []
    for p, b, raw in zip(terms["pid"].to_pylist(), terms["block"].to_pylist(), terms["keys"].to_pylist(), strict=True):
        rows.append(("path", p, b, logs[np.searchsorted(keys, _keys(raw, "path").astype(np.int64))].astype("<f8").tobytes(), 0))
    return _table(rows, REPLIES)


def _score(docs: pa.Table, replies: pa.Table, schema: pa.Schema) -> pa.Table:
    if not docs.num_rows:
        return schema.empty_table()
    texts, train = _whole(docs)
    terms = _block_terms(texts, train)
    got: dict[str, list[tuple[int, bytes]]] = {"path": [], "word": []}
    for kind, pid, raw in zip(replies["kind"].to_pylist(), replies["pid"].to_pylist(), replies["reply"].to_pylist(), strict=True):
        got[kind].append((pid, raw))
    logs = np.concatenate([np.frombuffer(r, "<f8") for _, r in sorted(got["path"])])
    totals = np.concatenate([_unpack(r) for _, r in sorted(got["word"])]) if got["word"] else np.zeros(0, np.int64)
    _, _, _, place, length = terms["path"]
    _, _, _, which, words = terms["word"]
    sums = lambda values, at, n: np.array([values[at[b - k : b]].sum() for b, k in zip(np.cumsum(n).tolist(), n.tolist(), strict=True)])
    return pa.table(
        {
            "_id": docs["_id"],
            "_held": docs["_held"],
            "n_words": pa.array(words),
            "known_words": pa.array(sums((totals > 0).astype(np.int64), which, words)),
            "word_logs": pa.array(sums(np.log10(totals + 1.0), which, words)),
            "byte_logs": pa.array(sums(logs, place, length)),
        }
    ).cast(schema)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose crc32 of the id, as text, leaves `remainder` are held out; the model learns from all others. score is
    the log10 probability of the text's bytes and its end under PPM with contexts of up to ORDER bytes, escape
    method C and exclusion. base_score is that of its words (A-Z lower-cased) and one end token under the
    training words' add-one unigram. Words are told apart by 64-bit hashes.

    Null text counts as empty: an end and nothing else. Null ids count as the empty text for holding out;
    repeated rows count as often as they come, and score alike. With no training text every byte is as likely as any.
    An empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), held_out(F.col(id_col), modulus, remainder).alias("_held"))
    size, n_train = rows.agg(F.coalesce(F.sum(F.octet_length("_text") + 64), F.lit(0)), F.count_if(~F.col("_held"))).first()
    pids = max(shuffle_partitions(spark), size // OWNED_BYTES + 1)
    blocks = max(pids, size // BLOCK_BYTES + 1)
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks))).groupBy("_block")

    terms = materialize(dealt.applyInArrow(lambda t: _collect(t, pids), TERMS), "terms")
    of_paths, of_words = (terms.where(F.col("kind") == k).repartition(pids, "pid").groupBy("pid") for k in ("path", "word"))
    totals = materialize(of_paths.applyInArrow(_path_totals, "path long, count long"), "paths")
    # At most 256 x 256 rows, whatever the corpus.
    pairs = np.zeros(65536, np.int64)
    for pair, n in totals.groupBy(F.col("path").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("count")).collect():
        pairs[pair] = n
    pairs = pairs.reshape(256, 256)
    context = F.shiftright("path", 8).bitwiseAND(0xFFFF)
    logs = totals.groupBy(F.pmod(F.xxhash64(context), F.lit(4 * pids)).alias("part")).applyInArrow(lambda t: _model(t, pairs), "path long, log double")
    model = materialize(logs.mapInArrow(partial(_with_owner, n_pids=pids), "pid long, path long, log double"), "model")
    path_replies = model.repartition(pids, "pid").groupBy("pid").cogroup(of_paths).applyInArrow(lambda m, t: _path_replies(m, t), REPLIES)
    word_replies = materialize(of_words.applyInArrow(_word_replies, REPLIES), "words")
    known, tokens = word_replies.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0], terms.where("kind = 'word'").agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]

    schema = PARTS.format(id=kind)
    arrow = _arrow_schema(docs, id_col)
    replies = path_replies.unionByName(word_replies).withColumnRenamed("block", "_block").groupBy("_block")
    parts = dealt.cogroup(replies).applyInArrow(lambda d, r: _score(d, r, arrow), schema)
    train_tokens, distinct = tokens + n_train, known + (n_train > 0)
    words = F.col("word_logs") + F.lit(float(np.log10(n_train + 1))) - (F.col("n_words") + 1) * F.lit(float(np.log10(train_tokens + distinct + 1)))
    return parts.select(
        F.col("_id").alias(id_col),
        F.col("_held").alias("held_out"),
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known_words") + int(n_train > 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        words.alias("base_score"),
        F.col("byte_logs").alias("score"),
    )


def _with_owner(batches: Iterator[pa.RecordBatch], n_pids: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pid = owner(scramble(batch.column(0).to_numpy().astype(U64)), n_pids)
        yield pa.RecordBatch.from_arrays([pa.array(pid), batch.column(0), batch.column(1)], names=["pid", "path", "log"])


def _arrow_schema(docs: DataFrame, id_col: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    own = to_arrow_type(docs.schema[id_col].dataType)
    return pa.schema([("_id", own), ("_held", pa.bool_()), ("n_words", pa.int64()), ("known_words", pa.int64()), ("word_logs", pa.float64()), ("byte_logs", pa.float64())])


def op9_lm(spark, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir).select("doc_id", "text"))
