"""Toxicity by compression distance under two zstandard dictionaries.

An ordinary dictionary is trained on words of ordinary text, a toxic one is made of the words that
toxic documents hold far more often than ordinary ones. Both serve as raw content: every word is
compressed once against the ordinary content and once against toxic and ordinary content, in a
window between two pieces of ordinary content that cost the same on both sides. The bytes saved, and
their share of the bytes that the word costs by ordinary content, are its distance: a short word saves
few bytes, but most of its cost. A document's gains feed a logistic calibration, fitted on labelled
documents that took no part in dictionary training; no word is left out before it.
"""

from __future__ import annotations

import random
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import find, fold, table

#: Labelled documents used for training, of each class; the bound of the sample.
TOXIC_DOCS, ORDINARY_DOCS = 2500, 5000
#: Least hashes of three-word passages that texts are told to be copies by: BANDS pairs, of which one must agree.
BANDS = 6
#: The share of the sample that the dictionaries see; the rest calibrates.
TRAIN_SHARE = 0.6
ORDINARY_BYTES = 16_384
#: Bounds of the shares saved whose words are counted apart.
SHARES = np.array([0.2, 0.35, 0.5, 0.65])
#: A toxic word's share of toxic documents, and how often that exceeds its share of ordinary ones.
MIN_SHARE, MIN_LIFT = 0.008, 10
#: The fewest toxic documents that a toxic word is in.
MIN_DOCS = 4
#: Words remembered by a task before it starts anew.
MEMO = 500_000
#: Letters in lower case and bytes from 0x80 on; all else separates.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LETTERS).split()


class Meter:
    """Bytes that the toxic content saves."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as zs

        settings = zs.ZstdCompressionParameters(
            window_log=17, chain_log=15, hash_log=15, search_log=4, min_match=4, target_length=64, strategy=zs.STRATEGY_LAZY2,
            format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        self.sides = []
        for content in (ordinary, toxic + ordinary):
            held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=settings)
            self.sides.append(zs.ZstdCompressor(dict_data=held, compression_params=settings).compress)
        end = len(ordinary)
        self.lead, self.tail = ordinary[max(0, end - 300) : max(0, end - 220)], ordinary[max(0, end - 500) : max(0, end - 470)]
        self.empty = len(self.sides[0](b"%b %b" % (self.lead, self.tail)))
        self.memo: dict[bytes, int] = {}

    def word(self, word: bytes) -> tuple[int, int]:
        """Bytes that the toxic content saves, and bytes that the word costs by ordinary content."""
        known = self.memo.get(word)
        if known is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            window = b"%b %b %b" % (self.lead, word, self.tail)
            ordinary, toxic = (len(side(window)) for side in self.sides)
            known = self.memo[word] = (ordinary - toxic << 32) + max(1, ordinary - self.empty)
        return known >> 32, known & 0xFFFFFFFF

    def features(self, text: str | None) -> tuple[float, ...]:
        """Of the distinct words: numbers by share saved, the largest share, gains summed, the share of all, and their number."""
        each = np.array([self.word(w) for w in set(words_of(text))] or [(0, 1)], np.float64)
        gain, cost = each[:, 0], each[:, 1]
        share = gain / cost
        counts = np.bincount(np.searchsorted(SHARES, share, side="right"), minlength=len(SHARES) + 1)[1:]
        return *np.log1p(counts), share.max(), np.log1p(gain[gain > 0].sum()), 10 * gain.sum() / cost.sum(), np.log1p(len(each))


def _passages(words: list[bytes]) -> list[int]:
    """Least hashes of a text's passages of three words."""
    odd = (np.arange(1, 2 * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    grams = {zlib.crc32(b" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))}
    return (np.fromiter(grams, np.uint64, len(grams))[:, None] * odd).min(axis=0).tolist()


def _copies(texts: list[list[int]]) -> np.ndarray:
    """A number of each text's group of copies and near copies, which share their passages; texts are told by their _passages."""
    parent, first = np.arange(len(texts)), {}
    for i, h in enumerate(texts):
        for k in range(BANDS):
            other = first.setdefault((k, h[2 * k], h[2 * k + 1]), i)
            if other != i:
                a, b = find(parent, np.array([i, other]))
                parent[max(a, b)] = min(a, b)
    return find(parent, np.arange(len(texts)))


def _support(texts: Iterable[str]) -> Counter:
    """Documents that hold each word (` word `); copies and near copies count once.

    Texts are taken one at a time, and no more is kept of each than numbers of its distinct words
    and its least hashes: this runs on the driver.
    """
    numbers: dict[bytes, int] = {}
    own, sizes, told = array("q"), [], []
    for words in map(words_of, texts):
        start = len(own)
        own.extend(numbers.setdefault(w, len(numbers)) for w in set(words))
        sizes.append(len(own) - start)
        told.append(_passages(words))
    pairs = np.unique(np.frombuffer(own, np.int64) * len(told) + np.repeat(_copies(told), sizes))
    held = np.bincount(pairs // max(1, len(told)), minlength=len(numbers))
    return Counter({b" %b " % w: n for w, n in zip(numbers, held.tolist())})


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    import zstandard as zs

    try:
        return zs.train_dictionary(size, samples).as_bytes()
    except zs.ZstdError:  # too few samples to train on: they are the content
        return b"".join(dict.fromkeys(samples))[-size:]


def fit(rows: list[tuple[str, int]], seed: int = 7) -> Model | None:
    """A model from (text, 0 or 1) rows; None unless both classes are there."""
    shuffle = random.Random(seed)
    rows = sorted(set((t, y) for t, y in rows if t is not None))
    shuffle.shuffle(rows)
    cut = int(len(rows) * TRAIN_SHARE)
    parts = [[t for t, y in rows[:cut] if y == k] for k in (0, 1)]
    if not parts[0] or not parts[1] or len({y for _, y in rows[cut:]}) < 2:
        return None
    common, marked = _support(parts[0]), _support(parts[1])
    n0, n1 = len(parts[0]), len(parts[1])
    toxic = {w: n for w, n in marked.items() if n >= max(MIN_DOCS, MIN_SHARE * n1) and (n / n1) >= MIN_LIFT * (common[w] + 0.5) / n0}
    samples = [w for w, n in sorted(common.items()) if n > 1 for _ in range(min(n, 50))]
    shuffle.shuffle(samples)
    model = Model(_dictionary(ORDINARY_BYTES, samples), b"".join(sorted(toxic, key=lambda w: (toxic[w], w))), ())
    meter = Meter(model.ordinary, model.toxic)
    x = np.array([(1.0, *meter.features(t)) for t, _ in rows[cut:]])
    y = np.array([k for _, k in rows[cut:]], float)
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), x.T @ (y - p) - 0.5 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = tuple(w.tolist())
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model | None:
    """A model from a bounded sample of labelled docs; ids are picked by hash, then read by a broadcast join.

    Repeated labels of an id count by their maximum; null labels and ids are left out.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    picked = None
    for y, n in ((0, ORDINARY_DOCS), (1, TOXIC_DOCS)):
        some = marked.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = some if picked is None else picked.unionAll(some)
    texts = docs.select("doc_id", "text")
    rows = texts.join(F.broadcast(picked), "doc_id").select("text", "y").collect()  # TOXIC_DOCS + ORDINARY_DOCS rows at most
    return fit([(r[0], int(r[1])) for r in rows])


def score(docs: DataFrame, model: Model | None, column: str = "_score") -> DataFrame:
    """docs with a score from 0 to 1 (1: likelier toxic) of their whole texts in a column that docs does not have.

    Null and empty texts score as texts without any gain; very long texts are scored whole; equal
    texts score alike, repeated rows stay; without a model (no labels of both classes) all score 0.
    An empty table gives no rows. Every row and column of docs stays.
    """
    if model is None:
        return docs.withColumn(column, F.lit(0.0))
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = held.value
        meter = Meter(m.ordinary, m.toxic)
        w = np.array(m.weights)
        for texts in batches:
            x = np.array([(1.0, *meter.features(t)) for t in texts]).reshape(-1, len(w))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))

    return docs.withColumn(column, run("text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    found = score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
