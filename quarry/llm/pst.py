"""Language-model scores from a probabilistic suffix tree over words.

Symbols are lower-cased words, one end a text, and the start of a text as the first context. The
root predicts a symbol from its smoothed count in training (the base). A context of up to `DEPTH`
symbols that occurs `MIN_COUNT` times or more is tried: it predicts from its successors' counts,
smoothed by its suffix's distribution, which stands for 2 n^0.8 of n occurrences. It stays in the tree if that gains at least
`MIN_GAIN` nats over its suffix on all its occurrences (their divergence times their number); a
context that fails but lies below a state keeps its suffix's distribution. A token is scored in the
longest state that is a suffix of what precedes it. Both thresholds are absolute, so contexts and
successors grow with the corpus.

The tree never stands in one place. Texts are packed once into blocks: distinct words, and tokens
as numbers, in a table bucketed by block; replies are appended to another, so that the rounds join
both without a shuffle. In every round a block sends its distinct n-grams (hashes and counts, pre-aggregated)
to buckets by hash, which add up all blocks and reply; the first round counts words, the next ones
count n-grams one longer whose context is frequent enough, and add up the gains of the contexts
before. An n-gram of any frequency is one entry a block, so no bucket is hot. At last each block
scores its texts with what the buckets replied. n-grams are told apart by the 32 bits of their hash
after the bucket's own (a bucket holds about as many at any size), words by all 64.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import LOWER, fold, table
from quarry.plans.session import shared_dir

#: The longest context, and the least occurrences of one whose successors are counted.
DEPTH, MIN_COUNT = 2, 4
#: Nats that a state gains over its suffix.
MIN_GAIN = 10.0
#: Text bytes of a block, about; a longer text is a block of its own. Buckets at least.
BLOCK_BYTES, MIN_BUCKETS = 12 << 20, 16
#: Buckets of the two tables at most; beyond it a bucket holds several blocks.
MAX_PARTS = 50_000
START, END = xxhash.xxh64_intdigest(b"\n\n"), xxhash.xxh64_intdigest(b"\n")
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def normal(text: str | None) -> list[bytes]:
    """The tokens of a text; a line feed, which no word holds, stands for the end."""
    return [*(text or "").encode().translate(LOWER).split(), b"\n"]


def weight(times):
    """Occurrences that the suffix's distribution stands for beside those of a context."""
    return 2.0 * times**0.8


def _longer(gram: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of each n-gram and the word that follows it."""
    h = (gram ^ (gram >> np.uint64(29))) * _MULT[0] + word * _MULT[1]
    h = (h ^ (h >> np.uint64(32))) * _MULT[2]
    return h ^ (h >> np.uint64(31))


def _zip(n: np.ndarray) -> bytes:
    """Numbers below 2^32, by planes of their bytes."""
    return zlib.compress(n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unzip(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _keys(keys: np.ndarray, kind: int, bits: int) -> bytes:
    """Sorted hashes of one bucket: words whole, n-grams as the gaps between the 32 bits after the bucket's."""
    if kind == 2:
        return keys.tobytes()
    low = (keys << np.uint64(bits)) >> np.uint64(32)
    return _zip(np.diff(low, prepend=np.uint64(0)))


def _unkeys(data: bytes, kind: int) -> np.ndarray:
    return np.frombuffer(data, np.uint64) if kind == 2 else np.cumsum(_unzip(data)).astype(np.uint64)


def _cuts(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted hashes: a bucket is their first bits."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edge = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    return [(int(bucket[a]), a, b) for a, b in zip(edge, edge[1:]) if b > a]


_PACKED = "block long, ids array<long>, train array<boolean>, n binary, words binary, tokens binary"
_PACKED_SCHEMA = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("n", pa.binary()), ("words", pa.binary()), ("tokens", pa.binary())])
_ASK = "kind int, bucket long, block long, keys binary, n binary"
_ASK_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])
_REPLY = "kind int, bucket long, block long, n binary, tokens long, kinds long"
_REPLY_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("n", pa.binary()), ("tokens", pa.int64()), ("kinds", pa.int64())])
_SCORE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def pack(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks of consecutive rows of (doc_id, text, train), as they are read; no shuffle."""

    def block(name: int, ids: list, texts: list, train: list) -> pa.RecordBatch:
        hashes, n = [], []
        for t in texts:
            w = normal(t)
            hashes.append(np.uint64(START))
            hashes.extend(map(xxhash.xxh64_intdigest, w))
            n.append(len(w))
        words, tokens, times = np.unique(np.fromiter(hashes, np.uint64, len(hashes)), return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # small numbers for frequent words
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        words, tokens = words[order], number[tokens]
        row = {"block": name, "ids": ids, "train": train, "n": _zip(np.array(n)), "words": words.tobytes(), "tokens": _zip(tokens)}
        return pa.RecordBatch.from_pylist([row], schema=_PACKED_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, size = TaskContext.get().partitionId() << 32, ([], [], []), 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for x, v in zip(held, row):
                    x.append(v)
                size += len(row[1] or "") + 1
                if size >= block_bytes:
                    yield block(name, *held)
                    name, held, size = name + 1, ([], [], []), 0
        if held[0]:
            yield block(name, *held)

    return docs.select("doc_id", "text", "train").mapInArrow(run, _PACKED)


class Block:
    """A packed block: tokens with a start before each text, and what the buckets have replied so far."""

    def __init__(self, row: pa.Table, bits: int):
        row = row.to_pylist()[0]
        self.name, self.ids, self.bits = row["block"], row["ids"], bits
        self.n = _unzip(row["n"])
        words = np.frombuffer(row["words"], np.uint64)
        order = np.argsort(words)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.words, self.tokens = words[order], number[_unzip(row["tokens"])]
        self.first = np.cumsum(self.n + 1) - (self.n + 1)
        self.place = np.arange(len(self.tokens)) - np.repeat(self.first, self.n + 1)
        self.train = np.repeat(np.array(row["train"], bool), self.n + 1)

    def _replied(self, replies: dict, kind: int, keys: np.ndarray) -> np.ndarray | None:
        got = replies.get(kind)
        if got is None:
            return None
        cuts = _cuts(keys, self.bits)
        if not cuts:
            return np.zeros(0, np.int64)
        if kind % 2:
            return np.concatenate([np.unpackbits(np.frombuffer(got[b], np.uint8), count=hi - lo) for b, lo, hi in cuts]).astype(bool)
        return np.concatenate([_unzip(got[b]) for b, _, _ in cuts])

    def walk(self, replies: dict, tokens: int, kinds: int, depth: int) -> tuple[list, np.ndarray, np.ndarray]:
        """(what to ask next, base probabilities, probabilities in the longest states so far).

        Kind 2 k asks for counts of k-grams, kind 2 d + 1 for gains of contexts of d symbols. To ask:
        (kind, sorted distinct keys, what this block adds).
        """
        count = self._replied(replies, 2, self.words)
        if count is None:
            return [(2, self.words, np.bincount(self.tokens, self.train, len(self.words)))], *[np.zeros(0)] * 2
        known = count[self.tokens]
        base = (known + 0.1) / (tokens + 0.1 * (kinds + 1))
        p, gram, word, asked = base.copy(), self.words[self.tokens], self.words[self.tokens], []
        for d in range(1, depth + 1):
            # tokens whose context of d symbols lies in their text and is frequent
            at = np.flatnonzero((self.place[1:] >= d) & (known[:-1] >= MIN_COUNT)) + 1
            context, times = gram[at - 1], known[at - 1]
            keys, here = np.unique(_longer(context, word[at]), return_inverse=True)
            count = self._replied(replies, 2 * d + 2, keys)
            if count is None:
                asked.append((2 * d + 2, keys, np.bincount(here, self.train[at], len(keys))))
                break
            found = count[here]
            share = weight(times)
            better = (found + share * p[at]) / (times + share)
            names, owner = np.unique(context, return_inverse=True)
            state = self._replied(replies, 2 * d + 1, names)
            if state is None:
                asked.append((2 * d + 1, names, np.bincount(owner, self.train[at] * np.log(better / p[at]), len(names))))
            else:
                good = state[owner]
                p[at[good]] = better[good]
            known, longer = np.zeros(len(known), np.int64), np.zeros(len(gram), np.uint64)
            known[at], longer[at] = found, keys[here]
            gram = longer
        return asked, base, p

    def ask(self, asked: list) -> Iterator[dict]:
        for kind, keys, n in asked:
            for b, lo, hi in _cuts(keys, self.bits):
                yield {"kind": kind, "bucket": b, "block": self.name, "keys": _keys(keys[lo:hi], kind, self.bits), "n": n[lo:hi].astype("<f4").tobytes() if kind % 2 else _zip(n[lo:hi])}

    def scores(self, base: np.ndarray, known: np.ndarray, p: np.ndarray) -> pa.Table:
        token, first = self.place > 0, np.cumsum(self.n) - self.n
        sums = [np.add.reduceat(x[token], first) for x in (known.astype(np.int64), np.log10(base), np.log10(p))]
        return pa.table({"doc_id": pa.array(self.ids, pa.int64()), "n_tokens": self.n, "n_known": sums[0], "base_score": sums[1], "score": sums[2]}, schema=_SCORE_SCHEMA)


def _answer(group: pa.Table) -> pa.Table:
    """Sums of a bucket's keys over all blocks: counts, or for gains whether they suffice."""
    kind, bucket = group.column("kind")[0].as_py(), group.column("bucket")[0].as_py()
    keys = [_unkeys(k, kind) for k in group.column("keys").to_pylist()]
    edge = np.cumsum([0, *map(len, keys)])
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    load = (lambda x: np.frombuffer(x, "<f4").astype(float)) if kind % 2 else _unzip
    sums = np.bincount(at, np.concatenate([load(x) for x in group.column("n").to_pylist()]), len(every))
    out = []
    for i, block in enumerate(group.column("block").to_pylist()):
        own = sums[at[edge[i] : edge[i + 1]]]
        out.append({"kind": kind, "bucket": bucket, "block": block, "n": np.packbits(own >= MIN_GAIN).tobytes() if kind % 2 else _zip(own), "tokens": 0, "kinds": 0})
    if kind == 2:
        word = sums[every != np.uint64(START)]
        out[0] |= {"tokens": int(word.sum()), "kinds": int((word > 0).sum())}
    return pa.Table.from_pylist(out, schema=_REPLY_SCHEMA)


def score_texts(docs: DataFrame, train: str, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    train names a boolean column: the rows that the model learns from. Tokens are the words and one
    end; null texts are empty and have the end alone; a very long text is scored whole, in a block of
    its own; repeated rows are rows of their own and count as often as they are there. Without
    training rows all counts are 0. An empty table gives no rows; other columns of docs, whatever
    their names, are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.coalesce(F.col(train), F.lit(False)).alias("train"))
    spark = docs.sparkSession
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MAX_PARTS, max(1, -(-total // block_bytes)))
    bits = (max(MIN_BUCKETS, -(-total // (2 * block_bytes))) - 1).bit_length()
    names = [f"suffix_tree_{x}_{uuid.uuid4().hex}" for x in ("blocks", "replies")]

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("append").bucketBy(n, "block").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
        return spark.table(name)

    packed = keep(pack(rows, block_bytes), names[0])
    replies: DataFrame | None = None
    tokens = kinds = 0

    def gathered(got: pa.Table) -> dict:
        out: dict[int, dict[int, bytes]] = {}
        for kind, bucket, data in zip(*(got.column(c).to_pylist() for c in ("kind", "bucket", "n"))):
            out.setdefault(kind, {})[bucket] = data
        return out

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(pa.Table.from_batches([batch.slice(i, 1)]), bits)
                yield pa.RecordBatch.from_pylist(list(block.ask(block.walk({}, 0, 0, depth)[0])), schema=_ASK_SCHEMA)

    for r in range(depth + 2):
        if replies is None:
            asked = packed.mapInArrow(begin, _ASK)
        else:

            def ask(row: pa.Table, got: pa.Table) -> pa.Table:
                if not row.num_rows:
                    return _ASK_SCHEMA.empty_table()
                block = Block(row, bits)
                return pa.Table.from_pylist(list(block.ask(block.walk(gathered(got), tokens, kinds, depth)[0])), schema=_ASK_SCHEMA)

            asked = packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(ask, _ASK)
        answered = asked.repartition(1 << bits, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(_answer, _REPLY)
        replies = keep(answered.repartition(n, "block"), names[1])
        if r == 0:
            found = replies.agg(F.sum("tokens"), F.sum("kinds")).first()
            tokens, kinds = found[0] or 0, found[1] or 0

    def finish(row: pa.Table, got: pa.Table) -> pa.Table:
        if not row.num_rows:
            return _SCORE_SCHEMA.empty_table()
        block, held = Block(row, bits), gathered(got)
        _, base, p = block.walk(held, tokens, kinds, depth)
        known = block._replied(held, 2, block.words)[block.tokens] > 0
        return block.scores(base, known, p)

    scored = packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("_train", fold("doc_id", 10) != 0)
    found = score_texts(docs, "_train")
    return found.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
