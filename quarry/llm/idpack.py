"""Token ids in files of fixed-width bit packing.

A file holds the ids of consecutive documents:

    magic | blocks | block offsets | document starts | document ids | known ids | trailer | magic

A block packs BLOCK_IDS ids (the last one fewer, filled up with zeros to a multiple of 64), each
in the fewest bits that hold every id of the vocabulary, 64 ids to as many 64-bit words as an id
has bits. Offsets (64 bits each) say where a block begins, so any range of ids is read by
unpacking the blocks that it touches, and starts say at which id of the file a document begins.
All numbers are little-endian. Documents are dealt to files by ranges of their ids, so that files
in order, and rows in a file, ascend; each task writes one file under a name of its own, and the
manifest of the tasks that succeeded is all that readers go by.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import tokens
from quarry.llm.common import table
from quarry.plans.session import shared_dir

MAGIC = b"QIDPACK1"
BLOCK_IDS = 8192
#: Bits of an id, ids of a block, ids, documents, blocks; the magic follows.
TRAILER = struct.Struct("<IIQQQ")
#: Text bytes of a file, about.
FILE_BYTES = 64 << 20
#: Ids that a reading task unpacks at a time, about.
READ_IDS = 1 << 20


def width(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in bits each, filled up with zeros to a multiple of 64 ids."""
    group = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    group.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(group), bits), "<u8")
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= group[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= group[:, j] >> np.uint64(64 - shift)
    return out.tobytes()


def unpack(data: bytes, bits: int) -> np.ndarray:
    """The ids of whole groups of 64, as 32-bit numbers."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out, mask = np.empty((len(words), 64), "<u4"), np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        found = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            found = found | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = found & mask
    return out.reshape(-1)


class Writer:
    """Writes one file; documents in order."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits, self.at = sink, bits, len(MAGIC)
        self.offsets, self.sizes, self.ids, self.known = [], [], [], []
        self.held, self.n_held = [], 0
        sink.write(MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError("an id has more bits than the vocabulary")
        self.ids += [d or 0 for d in doc_ids]
        self.known += [d is not None for d in doc_ids]
        self.sizes.append(sizes)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 16 * BLOCK_IDS:
            self._flush(self.n_held // BLOCK_IDS * BLOCK_IDS)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for i in range(0, n, BLOCK_IDS):
            block = pack(ids[i : min(i + BLOCK_IDS, n)], self.bits)
            self.offsets.append(self.at)
            self.at += len(block)
            self.sink.write(block)
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> tuple[int, int]:
        """Ends the file; (documents, ids) that it holds."""
        self._flush(self.n_held)
        sizes = np.concatenate([[0], *self.sizes]).astype(np.int64)
        starts = np.cumsum(sizes)
        for part, kind in ((self.offsets, "<u8"), (starts, "<u8"), (self.ids, "<i8"), (self.known, "u1")):
            self.sink.write(np.asarray(part).astype(kind).tobytes())
        self.sink.write(TRAILER.pack(self.bits, BLOCK_IDS, int(starts[-1]), len(self.ids), len(self.offsets)) + MAGIC)
        return len(self.ids), int(starts[-1])


class Reader:
    """Random access to one file; source is seekable."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, 2) - TRAILER.size - len(MAGIC)
        tail = self._at(end, TRAILER.size + len(MAGIC)) if end >= len(MAGIC) else b""
        if not tail.endswith(MAGIC):
            raise ValueError("this is no file of packed ids, or it is not whole")
        self.bits, self.block_ids, self.n_ids, self.n_docs, self.n_blocks = TRAILER.unpack(tail[: TRAILER.size])
        sizes = [8 * self.n_blocks, 8 * (self.n_docs + 1), 8 * self.n_docs, self.n_docs]
        at = end - sum(sizes)
        self.blocks_end = at
        parts = []
        for size, kind in zip(sizes, ("<u8", "<u8", "<i8", "u1")):
            parts.append(np.frombuffer(self._at(at, size), kind))
            at += size
        self.offsets, self.starts, self.doc_ids, self.known = parts
        self.starts = self.starts.astype(np.int64)

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop - 1 of the file; only the blocks that they touch are read."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        end = int(self.offsets[last + 1]) if last + 1 < self.n_blocks else self.blocks_end
        begin = int(self.offsets[first])
        ids = unpack(self._at(begin, end - begin), self.bits)
        return ids[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file."""
        return self.read(int(self.starts[i]), int(self.starts[i + 1]))

    def runs(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, document after the last, ids) of runs of documents of about READ_IDS ids; a longer one stands alone."""
        i = 0
        while i < self.n_docs:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + READ_IDS, side="right")) - 1)
            yield i, j, self.read(int(self.starts[i]), int(self.starts[j]))
            i = j


def _open(path: str):
    """(filesystem, path in it) of a plain path or an address."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes text of docs (doc_id, text) into files under path, in ascending doc_id; gives their manifest.

    tokenizer is a tokenizers file (the public byte-level BPE by default); end_id follows each
    document (None: nothing). Null text is empty, a null doc_id comes first. Rows that share a
    doc_id are ordered by a hash of the text, equal rows by where they were read. Texts of any
    length are encoded whole; an empty table gives a manifest without rows; other columns are not
    read. The manifest is stored under path too: (part, file, n_docs, n_ids), part ascending.
    """
    spark = docs.sparkSession
    content = tokens.file_bytes(tokenizer or tokens.public_path(tokens.BYTE_BPE))
    bits = width(max(len(tokens.byte_bpe_entries(content)), (end_id or 0) + 1))
    shared = spark.sparkContext.broadcast(content)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    files = max(spark.sparkContext.defaultParallelism, -(-n_bytes // file_bytes))
    order = [F.asc_nulls_first("doc_id"), F.col("h"), F.col("nth")]
    dealt = rows.withColumn("h", F.xxhash64("text")).withColumn("nth", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(files, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part, encode = TaskContext.get().partitionId(), tokens.byte_bpe(shared.value)
        name = f"{path}/ids-{part:07d}-{uuid.uuid4().hex}"
        filesystem, place = _open(name)
        filesystem.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with filesystem.open_output_stream(place) as sink:
            writer = Writer(sink, bits)
            for batch in chain([first], batches):
                for lo, hi in tokens.parts_of(batch.column(1)):
                    ((ids, offsets),) = encode(batch.column(1).slice(lo, hi - lo))
                    if end_id is not None:
                        ids = np.insert(ids, offsets[1:], end_id)
                        offsets = offsets + np.arange(len(offsets))
                    writer.add(batch.column(0).slice(lo, hi - lo).to_pylist(), ids, np.diff(offsets))
            n_docs, n_ids = writer.close()
        yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "n_docs": n_docs, "n_ids": n_ids}])

    found = dealt.select("doc_id", "text").mapInArrow(run, "part long, file string, n_docs long, n_ids long")
    found.write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files of a manifest.

    start counts the ids of all documents before, over all files; the checksum is of the ids as
    little-endian unsigned 32-bit numbers. One task reads a file, a run of blocks at a time.
    """
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)).alias("before"))
    files = files.repartition(max(1, manifest.count()), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                filesystem, place = _open(row["file"])
                with filesystem.open_input_file(place) as source:
                    reader = Reader(source)
                    for i, j, ids in reader.runs():
                        starts, data = reader.starts[i : j + 1], ids.tobytes()
                        ends = (4 * (starts - starts[0])).tolist()
                        crc = [zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:])]
                        doc_id = pa.array(reader.doc_ids[i:j], pa.int64(), mask=reader.known[i:j] == 0)
                        columns = [doc_id, pa.array(row["before"] + starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op11_idpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_ids(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}")
    return read_ids(manifest)
