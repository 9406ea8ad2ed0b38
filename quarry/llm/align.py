"""Alignment of two tokenizers' tokens over the same text.

Every document is encoded by both. The ids are exploded with their places; running sums of the
entries' bytes (a window) say where each token ends; an equi-join on document and end finds the
places at which tokens of both end, the cuts, and a running count of the cuts numbers the groups
between them. A group is a range of tokens of either side, and the two ranges joined are its
links, which Arrow batches fold to distinct id pairs a document.

Pair counts are summed up before the shuffle. Links find them again by a broadcast of the pairs
that hold at least one in `HOT_PAIRS` of all, of which there are `HOT_PAIRS` at most; only rarer
pairs are joined by a shuffle, so no pair, however common, meets in one task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import tokens
from quarry.llm.common import slices, table
from quarry.plans.session import shared_dir

#: Text bytes whose tokens a task sorts at a time, about, and the tasks at most (larger parts spill).
PART_BYTES, MAX_PARTS = 2 << 20, 200_000
#: Id pairs whose counts are broadcast at most.
HOT_PAIRS = 200_000
#: Tokens that are folded at a time, about, and the links of a group from which equal ids are counted first.
FOLD_TOKENS, WIDE_GROUP = 1 << 17, 1024
#: Stretches that a task remembers, and documents that an Arrow batch holds at most.
MEMO, BATCH_ROWS = 350_000, 300
#: Text bytes that are encoded at a time, about.
ENCODE_BYTES = 2 << 20
#: Ids travel as 16-bit numbers, from the least one up.
SHIFT = 1 << 15


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start:start + size] of all ranges, end to end."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def encoded(docs: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """(row, doc_id, ids): the ids of both sides, row a number of its own for each row of docs.

    ids is null where a text is null or empty, or where the bytes of either side's entries are not
    a space and the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tokens.file_bytes(byte_bpe), tokens.file_bytes(piece_bpe)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.both(*shared.value, MEMO)
        for batch in batches:
            for lo, hi in tokens.parts_of(batch.column(2), ENCODE_BYTES):
                part = batch.slice(lo, hi - lo)
                texts = pc.fill_null(part.column(2), "")
                found = encode(texts)
                good = encode.spelled & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
                keep = np.flatnonzero(good)
                starts = np.stack([at[keep] + (0 if i == 0 else len(found[0][0])) for i, (_, at) in enumerate(found)], axis=1).ravel()
                lengths = np.stack([np.diff(at)[keep] for _, at in found], axis=1).ravel()
                ids = _gather(np.concatenate([ids for ids, _ in found]).astype(np.int32), starts, lengths)
                inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array((ids - SHIFT).astype(np.int16)))
                outer = pa.array(np.concatenate([[0], np.cumsum(2 * good)]), pa.int32())
                lists = pa.ListArray.from_arrays(outer, inner, mask=pa.array(~good))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["row", "doc_id", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    # rows are never null, but a join asks; said here, all readers share one shuffle
    return rows.mapInArrow(run, "row long, doc_id long, ids array<array<smallint>>").where("row IS NOT NULL")


def cuts_of(enc: DataFrame, sizes: list[DataFrame]) -> DataFrame:
    """(row, grp, a, b): the places of the tokens of both sides that end where tokens of both end; grp counts them from 1.

    enc is spread by row; sizes gives each side's (id, size), the bytes of an id, in travelling form.
    """
    sides = []
    for i, (name, size) in enumerate(zip("ab", sizes)):
        # doc_id is named so that all readers of enc share one shuffle
        each = enc.select("row", "doc_id", F.posexplode(F.col("ids")[i]).alias(name, "id")).join(F.broadcast(size), "id")
        upto = Window.partitionBy("row", "doc_id").orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sides.append(each.withColumn("end", F.sum("size").over(upto)).select("row", "end", name))
    met = sides[0].join(sides[1], ["row", "end"])
    return met.withColumn("grp", F.row_number().over(Window.partitionBy("row").orderBy("end"))).select("row", "grp", "a", "b")


@contextmanager
def documents_stay_together(spark: SparkSession) -> Iterator[None]:
    """While it holds, joins on row and end of sides spread by row need no shuffle, and Arrow batches are small."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Fold:
    """Folds the groups of documents to texts and distinct linked pairs."""

    def __init__(self, most: int):
        digits = [b"?%d" % i for i in range(most)]
        self.size = np.array([len(d) for d in digits])
        self.start, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(digits), np.uint8)

    @staticmethod
    def ranges(last: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first token, tokens) of groups by their last tokens; first marks the first group of a document."""
        before = np.concatenate([[0], last[:-1] + 1])
        before[first] = 0
        return before, last + 1 - before

    def texts(self, values: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray) -> list[str]:
        """SHA-256 of each document's groups; start and size by group and side."""
        ids = _gather(values, start.ravel(), size.ravel())
        width = self.size[ids]
        out = _gather(self.flat, self.start[ids], width)
        at = np.cumsum(width) - width
        mark = np.full(len(ids), ord(","), np.uint8)
        begin = (np.cumsum(size.ravel()) - size.ravel()).reshape(-1, 2)
        mark[begin[:, 0]], mark[begin[:, 1]] = ord(";"), ord("|")
        out[at] = mark
        edges, data = [*at[begin[first, 0]].tolist(), len(out)], out.tobytes()
        return [hashlib.sha256(data[a + 1 : b]).hexdigest() for a, b in zip(edges, edges[1:])]

    @staticmethod
    def pairs(values: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, a, b, links) of distinct linked pairs, in order."""
        links = size[:, 0] * size[:, 1]
        thin = np.flatnonzero(links <= WIDE_GROUP)
        n = links[thin]
        which = np.repeat(thin, n)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        a = values[start[which, 0] + nth // size[which, 1]]
        b = values[start[which, 1] + nth % size[which, 1]]
        keys, weights = [(doc[which] << 42) | (a << 21) | b], [np.ones(len(which), np.int64)]
        for g in np.flatnonzero(links > WIDE_GROUP).tolist():
            (a, m), (b, k) = (np.unique(values[start[g, i] : start[g, i] + size[g, i]], return_counts=True) for i in (0, 1))
            keys.append(((doc[g] << 42) | (a[:, None] << 21) | b[None, :]).ravel())
            weights.append((m[:, None] * k[None, :]).ravel())
        key, weight = np.concatenate(keys), np.concatenate(weights)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        n = np.add.reduceat(weight[order], new) if len(key) else weight
        key, low = key[new], (1 << 21) - 1
        return key >> 42, (key >> 21) & low, key & low, n


_FOLDED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])


def folded(aligned: DataFrame, most: int) -> DataFrame:
    """Documents (row, doc_id, ids, cuts) with their counts, their groups' digest and their distinct pairs (a, b, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold(most)
        for batch in batches:
            weight = pc.fill_null(pc.list_value_length(batch.column(3)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(weight + 1, FOLD_TOKENS):
                yield _fold(fold, batch.slice(lo, hi - lo))

    return aligned.select("row", "doc_id", "ids", "cuts").mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<long>")


def _fold(fold: Fold, part: pa.RecordBatch) -> pa.RecordBatch:
    rows = part.num_rows
    counts = pc.fill_null(pc.list_value_length(part.column(3)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    told = np.flatnonzero(counts)
    cut, inner = part.column(3).flatten(), part.column(2).filter(pa.array(counts > 0)).flatten()
    doc = np.repeat(told, counts[told])
    grp, last = pc.struct_field(cut, "grp").to_numpy(), [pc.struct_field(cut, n).to_numpy().astype(np.int64) for n in "ab"]
    order = np.lexsort((grp, doc))
    last = [x[order] for x in last]
    size = pc.list_value_length(inner).to_numpy().astype(np.int64).reshape(-1, 2)
    values = inner.flatten().to_numpy().astype(np.int64) + SHIFT
    base = np.zeros((rows, 2), np.int64)
    base[told] = (np.cumsum(size.ravel()) - size.ravel()).reshape(-1, 2)
    first = np.cumsum(counts[told]) - counts[told]
    found = [Fold.ranges(x, first) for x in last]
    start = np.stack([f[0] + base[doc, i] for i, f in enumerate(found)], axis=1)
    width = np.stack([f[1] for f in found], axis=1)
    digest, totals, links = np.full(rows, "", object), np.zeros((rows, 2), np.int64), np.zeros(rows, np.int64)
    totals[told] = size
    digest[told] = fold.texts(values, start, width, first) if len(told) else []
    np.add.at(links, doc, width[:, 0] * width[:, 1])
    owner, a, b, n = Fold.pairs(values, start, width, doc)
    offsets = pa.array(np.searchsorted(owner, np.arange(rows + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((a, pa.int32()), (b, pa.int32()), (n, pa.int64()))]
    columns = [part.column(0), part.column(1), *(pa.array(x) for x in (totals[:, 0], totals[:, 1], counts, links)), pa.array(digest, pa.string()), *lists]
    return pa.RecordBatch.from_arrays(columns, schema=_FOLDED)


def align(docs: DataFrame, path: str, byte_bpe: str | None = None, piece_bpe: str | None = None) -> DataFrame:
    """Aligns text of docs (doc_id, text) under both tokenizers; stores and gives one row a document.

    The columns are those of `folded`: row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and
    the distinct linked id pairs (a, b) with their links n. A null or empty text, or one whose
    tokens do not spell a space and the text, has no tokens: zeros, '' and no pairs. Repeated rows
    and ids stay; an empty table gives no rows; other columns are not read. Texts of any length are
    aligned whole; both vocabularies hold 65,536 ids at most.
    """
    spark = docs.sparkSession
    byte_bpe, piece_bpe = byte_bpe or tokens.public_path(tokens.BYTE_BPE), piece_bpe or tokens.public_path(tokens.PIECE_BPE)
    entries = [tokens.byte_bpe_entries(tokens.file_bytes(byte_bpe)), tokens.piece_entries(tokens.file_bytes(piece_bpe))]
    most = max(map(len, entries))
    if most > 2 * SHIFT:
        raise ValueError("a vocabulary has more than 65,536 ids")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MAX_PARTS, max(spark.sparkContext.defaultParallelism, -(-n_bytes // PART_BYTES)))
    enc = encoded(docs, byte_bpe, piece_bpe).repartition(parts, "row")
    sizes = [spark.createDataFrame([(i - SHIFT, len(e)) for i, e in enumerate(known)], "id smallint, size int") for known in entries]
    cuts = cuts_of(enc, sizes).groupBy("row").agg(F.collect_list(F.struct("grp", "a", "b")).alias("cuts"))
    with documents_stay_together(spark):
        folded(enc.join(cuts, "row", "left"), most).write.parquet(path)
    return spark.read.parquet(path)


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, docs, best): how many documents hold a pair, and whether that is the most of all pairs of a."""
    counts = found.select(F.inline(F.arrays_zip("a", "b"))).groupBy("a", "b").agg(F.count("*").alias("docs"))
    return counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a")))


def linked_counts(found: DataFrame, path: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(row, n_best, count_sum) of the rows of `align` that have links, by the counts of all of them; path stores the counts."""
    pair_counts(found).write.parquet(path)
    counts = found.sparkSession.read.parquet(path)
    total = counts.agg(F.sum("docs")).first()[0] or 0
    hot = F.col("docs") * hot_pairs >= F.lit(total)  # the counts add up to total, so hot_pairs at most
    links = found.select("row", F.inline(F.arrays_zip("a", "b", "n")))
    tried = links.join(F.broadcast(counts.where(hot)), ["a", "b"], "left")
    rare = tried.where("docs is null").select("row", "a", "b", "n").join(counts.where(~hot), ["a", "b"])
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("docs") * F.col("n")).alias("count_sum")]
    both = tried.where("docs is not null").select("row", "n", "docs", "best").unionAll(rare.select("row", "n", "docs", "best"))
    return both.groupBy("row").agg(*sums)


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = f"{shared_dir(spark)}/align-{uuid.uuid4().hex}"
    found = align(table(spark, sf_dir, "documents"), f"{top}/documents")
    sums = linked_counts(found, f"{top}/pairs")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
