"""Exact substring deduplication over a sharded, sparse suffix array.

A byte goes if a `SPAN`-byte string that covers it also starts in a document with a smaller id.

1. Every string of SPAN bytes is keyed by the least hash among its q-grams (a minimizer), so equal
   strings have equal keys, and runs of neighbouring strings share one. Keys are the initial
   q-gram buckets. Packed by block of documents and dealt by key, keys that occur in two documents
   are found and sent back to their blocks.
2. The blocks send the runs of strings under such keys, with their text, to their buckets. Runs
   equal within a block are sent once, from the least document; the others are known to go.
3. Inside a bucket the strings are refined by bucket pointers: a string's identifier at depth 2d is
   the pair of the identifiers of depth d at its start and d bytes on, recursively from single
   bytes; strings left alone in their bucket drop out before the next sort. At depth SPAN the
   members of a bucket are compared byte by byte, and each learns the least document among them.
4. Each block unites the spans found and cuts its documents.

Documents are shuffled once, by a hash of the id; blocks and buckets grow in number, not in size,
and a passage that very many documents share reaches a bucket once a block.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import slices, table

SPAN = 50
Q = 20
#: Text bytes of a block and of the part of it that is hashed at a time, about; blocks at least.
BLOCK_BYTES, PART_BYTES, MIN_BLOCKS = 4 << 20, 1 << 20, 16
#: Strings under one key that a run holds at most.
RUN = 64
#: Strings that a bucket refines at a time, about; those of one key stay together.
PORTION = 400_000
LAST_ID = (1 << 63) - 1

_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _pair(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """An identifier of a pair of identifiers."""
    h = a * _MULT[level] + (b ^ (b >> np.uint64(29))) * _MULT[(level + 3) % 6]
    return h ^ (h >> np.uint64(31))


def _doubled(data: np.ndarray, depth: int) -> np.ndarray:
    """Identifiers of the strings of 16 bytes (depth 16), or of Q bytes, at every offset."""
    ids, four = data.astype(np.uint64) + np.uint64(1), None
    for level in range(4):
        d = 1 << level
        ids = _pair(ids[:-d], ids[d:], level)
        four = ids if level == 1 else four
    if depth == 16:
        return ids
    n = len(data) - depth + 1
    return _pair(ids[:n], four[16 : 16 + n], 4)


def keys_of(data: np.ndarray) -> np.ndarray:
    """The key of the SPAN-byte string at every offset: its least q-gram identifier."""
    low = _doubled(data, Q)
    width, reach = SPAN - Q + 1, 1
    least = low
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(low) - width + 1], least[width - reach :][: len(low) - width + 1])
    return least


def mixed(key: np.ndarray) -> np.ndarray:
    """The keys, one to one, with even bits: a least identifier of many has mostly zeros on top."""
    key = (key ^ (key >> np.uint64(32))) * _MULT[1]
    key = (key ^ (key >> np.uint64(29))) * _MULT[2]
    return key ^ (key >> np.uint64(32))


class Block:
    """The documents of one block, ordered by id, and their strings' runs."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.ids, self.texts = ids, texts

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes, key, document, first offset in bytes, offset of the document's part, strings) by part."""
        some: list[tuple[int, int, bytes]] = []
        size = 0
        for d, text in enumerate(self.texts):
            for lo in range(0, max(len(text) - SPAN + 1, 0), PART_BYTES):
                piece = text[lo : lo + PART_BYTES + SPAN - 1]
                some.append((d, lo, piece))
                size += len(piece)
                if size >= PART_BYTES:
                    yield self._part(some)
                    some, size = [], 0
        if some:
            yield self._part(some)

    @staticmethod
    def _part(some: list[tuple[int, int, bytes]]):
        data = np.frombuffer(b"".join(p for _, _, p in some), np.uint8)
        key = keys_of(data)
        length = np.array([len(p) for _, _, p in some])
        begin = np.cumsum(length) - length
        owner = np.repeat(np.arange(len(some)), length)[: len(key)]
        good = np.arange(len(key)) + SPAN <= (begin + length)[owner]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        since = np.arange(len(key)) - np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
        fresh |= since % RUN == 0
        start = np.flatnonzero(fresh & good)
        last = np.append(np.flatnonzero(fresh), len(key))
        stop = last[np.searchsorted(last, start, side="right")]
        stop = np.minimum(stop, (begin + length - SPAN + 1)[owner[start]])
        which = owner[start]
        doc = np.array([d for d, _, _ in some])[which]
        shift = (np.array([lo for _, lo, _ in some]) - begin)[which]
        return data, mixed(key[start]), doc, start, shift, stop - start


def _block(group: pa.Table) -> tuple[Block, pa.Table]:
    order = np.argsort(group.column("id").to_numpy(), kind="stable")
    group = group.take(pa.array(order))
    return Block(group.column("id").to_numpy(), [t or b"" for t in group.column("data").to_pylist()]), group


def _bucket(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)


def _short(key: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits after the bucket's."""
    return ((key << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def _split(values: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Ranges of equal buckets; bucket is sorted."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(bucket)]):
        if hi > lo:
            yield int(bucket[lo]), slice(lo, hi)


def refine(data: np.ndarray, start: np.ndarray, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The least doc among equal strings of SPAN bytes, for the strings that begin at start."""
    least = doc.copy()
    if not len(start):
        return least
    pointer = _doubled(data, 16)
    live, ident = np.arange(len(start)), key
    for step in (0, 16, 32, SPAN - 16):
        ident = _pair(ident, pointer[start[live] + step], step % 5)
        order = np.argsort(ident)
        held = ident[order]
        same = held[1:] == held[:-1]
        shared = np.append(same, False) | np.insert(same, 0, False)
        order = order[shared]  # in the order of their buckets; strings that stand alone drop out
        live, ident = live[order], held[shared]
        if not len(live):
            return least
    first = np.flatnonzero(np.insert(ident[1:] != ident[:-1], 0, True))
    size = np.diff(np.append(first, len(ident)))
    head = np.repeat(live[first], size)
    equal = np.ones(len(live), bool)
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    for off in (*range(0, SPAN - 8, 8), SPAN - 8):
        equal &= (words[start[live] + off] == words[start[head] + off]).all(axis=1)
    if equal.all():
        least[live] = np.repeat(np.minimum.reduceat(doc[live], first), size)
    else:  # identifiers of different strings met: told apart by their bytes
        text, best = data.tobytes(), {}
        names = [text[s : s + SPAN] for s in start[live].tolist()]
        for name, d in zip(names, doc[live].tolist()):
            best[name] = min(d, best.get(name, d))
        least[live] = [best[n] for n in names]
    return least


def _flags_to_spans(lo: np.ndarray, n: np.ndarray, flag: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end) of the runs of flagged strings; strings are listed run by run."""
    offset = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (row[at[1:]] != row[at[:-1]]) | (offset[at[1:]] != offset[at[:-1]] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return row[at[begin]], offset[at[begin]], offset[at[end]] + SPAN


_SPANS = "block long, ids binary, tids binary, lo binary, hi binary"
_SENT = f"bucket long, kind int, key binary, n binary, text binary, {_SPANS}"


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of docs.

    kept is the text's UTF-8 bytes without those removed. Null texts are empty; a null doc_id counts
    as the largest id; rows that share a doc_id are separate, and neither removes from the other.
    An empty table gives no rows; other columns of docs are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"),
        F.xxhash64("text").alias("tid"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"),
    )
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(MIN_BLOCKS, -(-total // block_bytes))
    bits = max(0, int(n_blocks - 1).bit_length())
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks))).repartition(n_blocks, "block")

    def index(group: pa.Table) -> pa.Table:
        """Sorted distinct keys of a block by bucket, and whether two of its documents hold one."""
        block, group = _block(group)
        found = [(key, doc) for _, key, doc, *_ in block.runs()]
        out = []
        if found:
            key, doc = np.concatenate([k for k, _ in found]), np.concatenate([d for _, d in found])
            name = block.ids[doc]
            order = np.argsort(key, kind="stable")
            key, name = key[order], name[order]
            first = np.flatnonzero(np.insert(key[1:] != key[:-1], 0, True))
            many = np.minimum.reduceat(name, first) < np.maximum.reduceat(name, first)
            key = key[first]
            for b, part in _split(key, _bucket(key, bits)):
                out.append({"bucket": b, "block": group.column("block")[0].as_py(), "keys": _short(key[part], bits).tobytes(), "many": np.packbits(many[part]).tobytes()})
        return pa.Table.from_pylist(out, schema=pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("many", pa.binary())]))

    def repeated(group: pa.Table) -> pa.Table:
        """For each block, the keys of this bucket that two documents hold."""
        keys = [np.frombuffer(k, np.uint32) for k in group.column("keys").to_pylist()]
        flags = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)).astype(bool) for m, k in zip(group.column("many").to_pylist(), keys)]
        code = (np.concatenate(keys).astype(np.uint64) << np.uint64(32)) | np.arange(sum(map(len, keys)), dtype=np.uint64)
        code.sort()
        same = (code[1:] >> np.uint64(32)) == (code[:-1] >> np.uint64(32))
        twice = np.concatenate([np.zeros(0, bool), *flags])
        twice[(code[np.append(same, False) | np.insert(same, 0, False)] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
        ends = np.cumsum([len(k) for k in keys])
        out = [{"bucket": group.column("bucket")[0].as_py(), "block": b, "keys": k[twice[e - len(k) : e]].tobytes()} for b, k, e in zip(group.column("block").to_pylist(), keys, ends)]
        return pa.Table.from_pylist(out, schema=pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary())]))

    def send(group: pa.Table, wanted: pa.Table) -> pa.Table:
        """The runs of a block under repeated keys, packed by bucket; kind 1: spans already known to go."""
        schema = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("key", pa.binary()), ("n", pa.binary()), ("text", pa.binary()), ("block", pa.int64()), ("ids", pa.binary()), ("tids", pa.binary()), ("lo", pa.binary()), ("hi", pa.binary())])
        if not group.num_rows or not wanted.num_rows:
            return schema.empty_table()
        block, group = _block(group)
        tids, name = group.column("tid").to_numpy(), group.column("block")[0].as_py()
        asked = np.sort(np.concatenate([(np.uint64(b) << np.uint64(32)) | np.frombuffer(k, np.uint32).astype(np.uint64) for b, k in zip(wanted.column("bucket").to_pylist(), wanted.column("keys").to_pylist())]))
        seen: dict[bytes, int] = {}
        known, texts, cols = [array("q") for _ in range(3)], [], [array("Q"), array("q"), array("q"), array("q")]
        for data, key, doc, start, shift, n in block.runs():
            code = (_bucket(key, bits).astype(np.uint64) << np.uint64(32)) | _short(key, bits).astype(np.uint64)
            at = np.minimum(np.searchsorted(asked, code), max(len(asked) - 1, 0))
            hit = np.flatnonzero(asked[at] == code) if len(asked) else np.zeros(0, np.int64)
            raw = data.tobytes()
            for k, d, a, s, m in zip(*(x[hit].tolist() for x in (key, doc, start, shift, n))):
                text = raw[a : a + m + SPAN - 1]
                owner = seen.setdefault(text, d)
                if block.ids[owner] < block.ids[d]:
                    values, into = (d, a + s, a + s + len(text)), known
                else:
                    values, into = (k, d, a + s, m), cols
                    texts.append(text)
                for x, v in zip(into, values):
                    x.append(v)
        out = []
        seen.clear()
        if known[0]:
            d, lo, hi = (np.frombuffer(x, np.int64) for x in known)
            out.append({"bucket": name & ((1 << bits) - 1), "kind": 1, "block": name, "ids": block.ids[d].tobytes(), "tids": tids[d].tobytes(), "lo": lo.tobytes(), "hi": hi.tobytes()})
        if texts:
            key = np.frombuffer(cols[0], np.uint64)
            d, lo, n = (np.frombuffer(x, np.int64) for x in cols[1:])
            order = np.argsort(key, kind="stable")
            for b, part in _split(key[order], _bucket(key[order], bits)):
                rows_ = order[part]
                out.append({"bucket": b, "kind": 0, "key": key[rows_].tobytes(), "n": n[rows_].tobytes(), "text": b"".join(texts[i] for i in rows_), "block": name, "ids": block.ids[d[rows_]].tobytes(), "tids": tids[d[rows_]].tobytes(), "lo": lo[rows_].tobytes()})
        return pa.Table.from_pylist(out, schema=schema)

    def resolve(group: pa.Table) -> pa.Table:
        """Spans to remove, by block, from the runs of one bucket."""
        schema = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("tids", pa.binary()), ("lo", pa.binary()), ("hi", pa.binary())])
        ready = group.filter(pc.equal(group.column("kind"), 1)).select(["block", "ids", "tids", "lo", "hi"])
        runs = group.filter(pc.equal(group.column("kind"), 0))
        if not runs.num_rows:
            return ready.cast(schema)
        load = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in runs.column(c).to_pylist()])
        key, n, ids, tids, lo = load("key", np.uint64), load("n", np.int64), load("ids", np.int64), load("tids", np.int64), load("lo", np.int64)
        block = np.repeat(runs.column("block").to_numpy(), [len(x) // 8 for x in runs.column("n").to_pylist()])
        text = b"".join(runs.column("text").to_pylist())
        at = np.cumsum(n + SPAN - 1) - (n + SPAN - 1)
        order = np.argsort(key, kind="stable")
        whole = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))  # where a key's runs begin
        done = []
        for first, last in slices(np.add.reduceat(n[order], whole), PORTION):
            some = order[whole[first] : whole[last] if last < len(whole) else len(order)]
            data = np.frombuffer(b"".join([text[a:b] for a, b in zip(at[some].tolist(), (at[some] + n[some] + SPAN - 1).tolist())]), np.uint8)
            width = n[some] + SPAN - 1
            row = np.repeat(np.arange(len(some)), n[some])
            start = (np.cumsum(width) - width)[row] + np.arange(len(row)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
            least = refine(data, start, key[some][row], ids[some][row])
            which, begin, end = _flags_to_spans(lo[some], n[some], least < ids[some][row], row)
            done.append((some[which], begin, end))
        which, begin, end = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(block[which], kind="stable")
        which, begin, end = which[order], begin[order], end[order]
        out = [{"block": b, "ids": ids[which[p]].tobytes(), "tids": tids[which[p]].tobytes(), "lo": begin[p].tobytes(), "hi": end[p].tobytes()} for b, p in _split(which, block[which])]
        return pa.concat_tables([pa.Table.from_pylist(out, schema=schema), ready.cast(schema)])

    def cut(group: pa.Table, spans: pa.Table) -> pa.Table:
        load = lambda c: np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, np.int64) for x in spans.column(c).to_pylist()]])
        ids, tids, lo, hi = (load(c) for c in ("ids", "tids", "lo", "hi"))
        by: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, t, a, b in zip(ids.tolist(), tids.tolist(), lo.tolist(), hi.tolist()):
            by.setdefault((i, t), []).append((a, b))
        out = []
        for doc_id, i, t, data in zip(*(group.column(c).to_pylist() for c in ("doc_id", "id", "tid", "data"))):
            data, kept, end, n_spans = data or b"", [], 0, 0
            upto = -1
            for a, b in sorted(by.get((i, t), ())):
                if a > upto:
                    n_spans += 1
                    kept.append(data[end:a])
                upto = end = max(upto, b)
            kept.append(data[end:])
            rest = b"".join(kept)
            out.append((doc_id, len(data), len(data) - len(rest), n_spans, hashlib.sha256(rest).hexdigest(), rest))
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()

    keys = rows.groupBy("block").applyInArrow(index, "bucket long, block long, keys binary, many binary")
    wanted = keys.groupBy("bucket").applyInArrow(repeated, "bucket long, block long, keys binary")
    sent = rows.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(send, _SENT)
    spans = sent.groupBy("bucket").applyInArrow(resolve, _SPANS)
    return rows.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
