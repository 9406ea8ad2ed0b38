"""Token files and alignments against whole-text encodings and plain reference models."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF

from quarry.llm import idpack, queries, tokens

RNG = random.Random(11)
ALPHABET = ["a", "b", "é", "'s", " ", " ", "  ", "\n", "\t", " ", "　", "▁", "▁ ", "1", "23", "!", "\0", "<|endoftext|>", "\U00010348", "́", "word", "The", "\x1c", "\x85", "\r\n", "<s>", "﻿"]
TEXTS = ["".join(RNG.choice(ALPHABET) for _ in range(RNG.randrange(25))) for _ in range(3000)]


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.public_path(tokens.BYTE_BPE))


def test_stretches_give_the_tokens_of_whole_texts():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    byte, piece = (tokens.file_bytes(tokens.public_path(n)) for n in (tokens.BYTE_BPE, tokens.PIECE_BPE))
    whole, plain = Tokenizer.from_str(byte.decode()), Tokenizer.from_str(byte.decode())
    plain.encode_special_tokens = True
    pieces = SentencePieceProcessor(model_proto=piece)
    for encode, told in (
        (tokens.byte_bpe(byte), lambda t: whole.encode(t, add_special_tokens=False).ids),
        (tokens.byte_bpe(byte, True, True), lambda t: plain.encode(f" {t}", add_special_tokens=False).ids),
        (tokens.piece_bpe(piece), lambda t: pieces.encode(t) if t else encode.sides[0]([" "])[0]),
    ):
        assert encode.split
        for lo in range(0, len(TEXTS), 100):
            ((ids, at),) = encode(pa.array(TEXTS[lo : lo + 100], pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [told(t) for t in TEXTS[lo : lo + 100]]
        assert encode(pa.array([], pa.string()))[0][1].tolist() == [0]


def test_forgetting_changes_nothing(monkeypatch):
    encode = tokens.byte_bpe(tokens.file_bytes(tokens.public_path(tokens.BYTE_BPE)))
    before = encode(pa.array(TEXTS, pa.string()))[0][0].tolist()
    monkeypatch.setattr(tokens, "MEMO", 3)
    found = [encode(pa.array(TEXTS[i : i + 50], pa.string()))[0][0].tolist() for i in range(0, len(TEXTS), 50)]
    assert [i for part in found for i in part] == before


@pytest.mark.parametrize("bits", range(1, 33))
def test_packing_is_exact_and_minimal(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 64 * 5 - 7, dtype=np.uint64).astype(np.uint32)
    data = idpack.pack(ids, bits)
    assert len(data) == 5 * 8 * bits and idpack.unpack(data, bits)[: len(ids)].tolist() == ids.tolist()
    assert idpack.width(2**bits) == bits and (bits == 1 or idpack.width(2**bits - 1 if bits > 1 else 2) == bits)


def test_files_give_any_range(tmp_path, monkeypatch):
    monkeypatch.setattr(idpack, "BLOCK_IDS", 128)
    monkeypatch.setattr(idpack, "READ_IDS", 300)
    sizes = [0, 1, 700, 0, 5, 127, 128, 3000, 2]
    ids = np.random.default_rng(4).integers(0, 50257, sum(sizes)).astype(np.uint32)
    with open(tmp_path / "f", "wb") as sink:
        writer = idpack.Writer(sink, 16)
        at = 0
        for i, n in enumerate(sizes):
            writer.add([i if i else None], ids[at : at + n], np.array([n]))
            at += n
        assert writer.close() == (len(sizes), len(ids))
    with open(tmp_path / "f", "rb") as source:
        reader = idpack.Reader(source)
        assert (reader.bits, reader.block_ids, reader.n_ids) == (16, 128, len(ids)) and reader.known.tolist() == [0] + [1] * 8
        for _ in range(200):
            a = RNG.randrange(len(ids) + 1)
            b = RNG.randrange(a, len(ids) + 50)
            assert reader.read(a, b).tolist() == ids[a:b].tolist()
        assert [reader.document(i).tolist() for i in range(9)] == [ids[sum(sizes[:i]) : sum(sizes[: i + 1])].tolist() for i in range(9)]
        runs = list(reader.runs())
        assert [r[0] for r in runs][0] == 0 and runs[-1][1] == 9 and sum(len(r[2]) for r in runs) == len(ids)
    (tmp_path / "g").write_bytes((tmp_path / "f").read_bytes()[:-3])
    with pytest.raises(ValueError), open(tmp_path / "g", "rb") as source:
        idpack.Reader(source)
    with pytest.raises(ValueError):
        idpack.Writer(open(tmp_path / "h", "wb"), 4).add([1], np.array([16], np.uint32), np.array([1]))


def told_ids(model, rows):
    """(doc_id, start, n_tokens, crc32) of rows in ascending doc_id."""
    out, start = [], 0
    for i, t in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_idpack_matches_plain_encoding(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = queries.QUERIES["op11_idpack"](spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == told_ids(model, docs)


def test_idpack_odd_rows(spark, model, tmp_path):
    rows = [(5, "b <|endoftext|> c"), (None, "null id"), (2, None), (2, ""), (9, "x y " * 20_000), (-1, "é\0 a"), (7, "same"), (7, "same")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, h string")
    manifest = idpack.write_ids(df, str(tmp_path / "a"), file_bytes=1000)
    got = sorted(map(tuple, idpack.read_ids(manifest).collect()), key=lambda r: r[1])
    told = told_ids(model, sorted(rows, key=lambda r: (r[0] is not None, r[0])))
    assert [(r[0], r[2], r[3]) for r in got] == [(r[0], r[2], r[3]) for r in told] and [r[1] for r in got] == [r[1] for r in told]
    assert manifest.count() > 1 and {f.file.startswith(str(tmp_path)) for f in manifest.collect()} == {True}
    one = spark.createDataFrame([(3, "hi there")] * 50, "doc_id long, text string")
    assert idpack.read_ids(idpack.write_ids(one, str(tmp_path / "b"))).agg({"start": "max"}).first()[0] == 49 * 3
    empty = idpack.write_ids(df.limit(0), str(tmp_path / "c"))
    assert empty.count() == 0 and idpack.read_ids(empty).count() == 0
