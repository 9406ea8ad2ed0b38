"""Language identification by segmentation-marginalised unigrams.

The vocabulary is a fixed public one (a sentencepiece model, read on the driver; its path is a
parameter). Each language has a probability for every piece, learned by expectation
maximisation. A word's likelihood sums over all of its segmentations into pieces (forward
algorithm over its UTF-8 bytes, rescaled every `STRIDE` bytes, so that no word is too long or too
strange); pieces never cross white space, so a text's likelihood is the product over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import fold, slices, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes after which likelihoods are rescaled; a byte is at least about FLOOR likely, so none is lost in between.
STRIDE = 16
#: Words that are summed at a time.
WORDS = 4096
#: Training documents of each language, about; they are picked by a hash of doc_id.
TRAIN_DOCS = 1500
#: Labels that are learned at most; more are an error.
MAX_LABELS = 1000
ROUNDS = 4
#: The least probability of a piece, before all are made to sum to 1.
FLOOR = 1e-6
#: Words remembered by a task before it starts anew.
MEMO = 200_000


def load_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Pieces as bytes, the word mark as a space; all 256 single bytes are among them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            found.add(model.id_to_piece(i).replace("▁", " ").encode())
    return sorted(found)


class Lattice:
    """Finds all pieces at all offsets of many words at once."""

    MULT = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[bytes]):
        self.size, self.tables = len(pieces), []
        self.seen = np.zeros(1 << 22, bool)
        by: dict[int, list[tuple[int, int]]] = {}
        for i, p in enumerate(pieces):
            by.setdefault(len(p), []).append((self._hash(p), i))
        self.longest = max(by)
        for n in range(1, self.longest + 1):
            pairs = sorted(by.get(n, []))
            keys = np.array([k for k, _ in pairs], np.uint64)
            self.seen[keys >> np.uint64(42)] = True
            self.tables.append((keys, np.array([i for _, i in pairs], np.int64)))

    def _hash(self, piece: bytes) -> int:
        h = 0
        for b in piece:
            h = ((h + b + 1) * int(self.MULT)) & (2**64 - 1)
        return h

    def ids(self, data: np.ndarray) -> np.ndarray:
        """ids[n - 1, i]: the piece of n bytes that starts at i, or size (none)."""
        out = np.full((self.longest, len(data)), self.size, np.int32)
        h = np.zeros(len(data), np.uint64)
        for n, (keys, pieces) in enumerate(self.tables, 1):
            if n > len(data):
                break
            m = len(data) - n + 1
            h = (h[:m] + data[n - 1 :].astype(np.uint64) + np.uint64(1)) * self.MULT
            maybe = np.flatnonzero(self.seen[h >> np.uint64(42)])
            if len(keys) and len(maybe):
                at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
                hit = keys[at] == h[maybe]
                out[n - 1, maybe[hit]] = pieces[at[hit]]
        return out

    @staticmethod
    def laid(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, offset, length) of the words, each led by a space."""
        joined = np.frombuffer(b" " + b" ".join(words), np.uint8)
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        return joined, np.cumsum(length) - length, length

    def _filled(self, table: np.ndarray, steps: Iterator[tuple[int, int, np.ndarray, np.ndarray]], p: np.ndarray, forward: bool) -> np.ndarray:
        """Fills alpha (forward) or beta by steps; gives the logarithms of the scales of its rows.

        The rows that a piece may reach share one scale at any time.
        """
        n, log, last = len(table) - 1, np.zeros_like(table), None
        for k, e, has, piece in steps:
            to, source = (e, e - k) if forward else (e - k, e)
            if to != last and last is not None:
                self._rescale(table, log, last, n, forward)
            last = to
            table[to, has] += table[source, has] * p[piece]
        if last is not None:
            self._rescale(table, log, last, n, forward)
        return log

    def _rescale(self, table: np.ndarray, log: np.ndarray, row: int, n: int, forward: bool) -> None:
        """After a row is whole: the next one takes its scale; every STRIDE rows the reachable ones are rescaled."""
        if (row if forward else n - row) % STRIDE == 0:
            near = slice(max(0, row + 1 - self.longest), row + 1) if forward else slice(row, row + self.longest)
            most = table[near].max(axis=0)
            table[near] /= most
            log[near] += np.log(most)
        after = row + 1 if forward else row - 1
        if 0 <= after <= n:
            log[after] = log[row]

    def _steps(self, ids: np.ndarray, at: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(bytes, end, words, piece) of all pieces of words of n bytes, ends in order."""
        for e in range(1, n + 1):
            for k in range(1, min(e, self.longest) + 1):
                piece = ids[k - 1, at + e - k]
                has = np.flatnonzero(piece < self.size)
                if len(has):
                    yield k, e, has, piece[has]

    def loglik(self, words: list[bytes], p: np.ndarray) -> np.ndarray:
        """Log likelihoods (word, language)."""
        out = np.zeros((len(words), p.shape[1]))
        order = np.argsort([-len(w) for w in words], kind="stable")
        for lo in range(0, len(words), WORDS):
            some = order[lo : lo + WORDS]
            data, at, length = self.laid([words[i] for i in some.tolist()])
            out[some] = self._logsum(self.ids(data), at, length, p)
        return out

    def _logsum(self, ids: np.ndarray, at: np.ndarray, length: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Log likelihoods of words, longest first: the last columns of alpha alone are held."""
        keep = self.longest + 1
        ring, scale = np.zeros((keep, len(at), p.shape[1])), np.zeros((len(at), p.shape[1]))
        ring[0], out = 1, np.zeros((len(at), p.shape[1]))
        for e in range(1, int(length[0]) + 1):
            live = int(np.searchsorted(-length, -e, side="right"))
            now = np.zeros((live, p.shape[1]))
            for k in range(1, min(e, self.longest) + 1):
                piece = ids[k - 1, at[:live] + e - k]
                has = np.flatnonzero(piece < self.size)
                if len(has) == live:
                    now += ring[(e - k) % keep, :live] * p[piece]
                elif len(has):
                    now[has] += ring[(e - k) % keep, has] * p[piece[has]]
            ring[e % keep, :live] = now
            ended = slice(int(np.searchsorted(-length, -e, side="left")), live)
            out[ended] = np.log(now[ended]) + scale[ended]
            if e % STRIDE == 0:
                most = ring[:, :live].max(axis=0)
                ring[:, :live] /= most
                scale[:live] += np.log(most)
        return out

    def expected(self, words: list[bytes], weight: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected piece counts over all segmentations, for one language."""
        out = np.zeros(self.size + 1)
        for lo, hi in slices(np.fromiter(map(len, words), np.int64, len(words)), 1 << 20):
            data, at, length = self.laid(words[lo:hi])
            ids = self.ids(data)
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                steps = list(self._steps(ids, at[rows], n))
                alpha, beta = np.zeros((n + 1, len(rows))), np.zeros((n + 1, len(rows)))
                alpha[0] = beta[n] = 1
                ahead = self._filled(alpha, iter(steps), p, True)
                behind = self._filled(beta, sorted(steps, key=lambda s: s[0] - s[1]), p, False)
                whole, share = np.log(alpha[n]) + ahead[n], weight[lo + rows]
                for k, e, has, piece in steps:
                    scale = np.exp(ahead[e - k, has] + behind[e, has] - whole[has]) * share[has]
                    out += np.bincount(piece, alpha[e - k, has] * p[piece] * beta[e, has] * scale, self.size + 1)
        return out[: self.size]


def train(docs: DataFrame, pieces: list[bytes], text: str = "text", label: str = "lang", rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities [piece or none, language]) from a bounded sample of docs.

    docs has doc_id, text and label; about TRAIN_DOCS rows of each label are used, whole.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    totals = {r[0]: r[1] for r in rows.groupBy(label).count().limit(MAX_LABELS + 1).collect()}
    if len(totals) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    names = sorted(totals)
    if not names:
        return [], np.zeros((len(pieces) + 1, 0))
    rate = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(TRAIN_DOCS / totals[k]))])
    chance = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(chance < rate[F.col(label)])
    word = F.explode(F.split(text, r"\s+")).alias("word")
    counts = picked.select(F.col(label).alias("lang"), word).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = counts.persist()
    p = np.full((len(pieces) + 1, len(names)), 1.0 / len(pieces))
    p[-1] = 0
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, names, p))

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocab, langs, probs = shared.value
            lattice, sums = Lattice(vocab), np.zeros((len(vocab), len(langs)))
            for batch in batches:
                lang = np.array(batch.column(0).to_pylist())
                words = [w.encode() for w in batch.column(1).to_pylist()]
                n = batch.column(2).to_numpy().astype(float)
                for g, name in enumerate(langs):
                    rows = np.flatnonzero(lang == name)
                    if len(rows):
                        sums[:, g] += lattice.expected([words[i] for i in rows], n[rows], probs[:, g])
            piece, g = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(piece), pa.array(sums[piece, g])], names=["g", "piece", "n"])

        sums = np.zeros((len(pieces) + 1, len(names)))
        found = counts.repartition("word").mapInArrow(gather, "g long, piece long, n double")
        for r in found.groupBy("g", "piece").agg(F.sum("n").alias("n")).collect():  # at most pieces x languages
            sums[r[1], r[0]] = r[2]
        sums[:-1] += 0.02
        p = np.maximum(sums / sums.sum(axis=0), FLOOR)
        p[-1] = 0
        p /= p.sum(axis=0)
        shared.unpersist()
    counts.unpersist()
    return names, p


def identify(docs: DataFrame, names: list[str], p: np.ndarray, pieces: list[bytes]) -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language and its posterior share of even priors.

    A null text, one without a letter, or a model without languages gives `und` and 0. Ties go to
    the first language by name. Texts and words of any length are scored whole. Only doc_id and text
    are read; repeated rows stay; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((pieces, names, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, langs, probs = shared.value
        lattice = Lattice(vocab)
        memo: dict[str, int] = {}
        known = np.zeros((0, len(langs)))
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(sizes, 1 << 22):
                part = batch.slice(lo, hi - lo)
                lists = pc.utf8_split_whitespace(pc.fill_null(part.column(1), ""))
                coded = lists.flatten().dictionary_encode()
                words = coded.dictionary.to_pylist()
                if len(memo) > MEMO:
                    memo, known = {}, known[:0]
                new = [w for w in words if w not in memo]
                if new:
                    memo.update(zip(new, range(len(known), len(known) + len(new))))
                    known = np.concatenate([known, lattice.loglik([w.encode() for w in new], probs)])
                at = np.fromiter((memo[w] for w in words), np.int64, len(words))
                each = known[at[coded.indices.to_numpy(zero_copy_only=False)]] if len(at) else known[:0]
                offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                some, total = offsets[1:] > offsets[:-1], np.zeros((len(offsets) - 1, len(langs)))
                if len(each):  # each text's own words alone are summed
                    total[some] = np.add.reduceat(each, offsets[:-1][some], axis=0)
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                letters = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                lang = np.where(letters, np.array(langs, object)[best], "und")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(np.where(letters, share, 0.0))], names=["doc_id", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    asked = docs.select(F.col("doc_id").cast("long"), "text", letters)
    if not names:
        return asked.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return asked.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op1_langid(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = load_pieces(vocabulary)
    names, p = train(docs.where(fold("doc_id", 4) != 2), pieces)
    found = identify(docs, names, p, pieces)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
