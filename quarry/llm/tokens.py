"""Public tokenizers applied to whole texts, each distinct stretch of a text encoded once.

A stretch begins at a space (U+0020) that follows a character other than white space. No token of
a byte-level BPE with its usual pattern, and none of a piece model whose pieces hold spaces only
at their front, reaches over such a place, so the tokens of a text are those of its stretches in
turn. Tokenizers of other kinds get whole texts. A task remembers the stretches it has met.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarry.llm.common import slices

#: Files of the public tokenizers, by public_tokenizers.path.
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Stretches that a task remembers before it starts anew.
MEMO = 1_000_000
#: Text bytes that are encoded at a time, about; a longer text stands alone.
SLICE_BYTES = 4 << 20
#: White space, and all that a tokenizer may take for it (U+2581 is the mark of a space in pieces).
_BLANK = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{2581}\x{3000}\x{feff}"
#: Texts in which a space is first, last or beside another blank; the others are cut at every space.
_UNEVEN = rf"^ |[{_BLANK}] | $"
_EDGE = re.compile("([^" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", _BLANK) + "]) ")
_MARK = "\0"


def public_path(name: str) -> str:
    """The place of a public tokenizer's file; any other path may be given in its stead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Token ids of texts, by one tokenizer or several at a time.

    Each of sides gives the ids of each of a list of texts; split says whether stretches may stand
    alone, led whether a space is put before each text, and memo how many stretches are remembered.
    With entries (the bytes of each id, by side), `spelled` tells which texts the tokens of all
    sides spell: those all of whose stretches they do.
    """

    def __init__(self, sides: list[Callable[[list[str]], list[list[int]]]], split: bool, led: bool, memo: int | None = None, entries: list[list[bytes]] | None = None):
        self.sides, self.split, self.led, self.most, self.entries = sides, split, led, memo, entries
        self.spelled = np.zeros(0, bool)
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.good = np.zeros(0, bool)
        self.known = [(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)) for _ in self.sides]

    def _rows(self, stretches: list[str]) -> np.ndarray:
        """Where the memory has the stretches; new ones are encoded first."""
        new = [w for w in dict.fromkeys(stretches) if w not in self.memo]
        if new:
            good = np.ones(len(new), bool)
            for i, (encode, (flat, start, size)) in enumerate(zip(self.sides, self.known)):
                found = encode(new)
                if self.entries:
                    known = self.entries[i]
                    good &= np.fromiter((b"".join([known[j] for j in ids]) == w.encode() for w, ids in zip(new, found)), bool, len(new))
                more = np.fromiter(map(len, found), np.int32, len(found))
                ids = np.fromiter(chain.from_iterable(found), np.uint32, int(more.sum()))
                start = np.concatenate([start, len(flat) + np.cumsum(more, dtype=np.int64) - more])
                self.known[i] = (np.concatenate([flat, ids]), start, np.concatenate([size, more]))
            self.good = np.concatenate([self.good, good])
            self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new))))
        return np.fromiter((self.memo[w] for w in stretches), np.int64, len(stretches))

    def pieces(self, texts: pa.Array) -> pa.Array:
        """Lists of stretches; all but a text's first are without the space that leads them."""
        if not self.split:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1), pa.int32()), texts)
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        odd = np.flatnonzero(uneven.to_numpy(zero_copy_only=False))
        even = pc.split_pattern(texts.filter(pc.invert(uneven)), " ")
        if not len(odd):
            return even
        # a text that holds the mark is one stretch
        lists = [[t] if _MARK in t else _EDGE.sub(rf"\1{_MARK}", t).split(_MARK) for t in texts.take(pa.array(odd)).to_pylist()]
        place = np.argsort(np.concatenate([np.delete(np.arange(len(texts)), odd), odd]), kind="stable")
        return pa.concat_arrays([even, pa.array(lists, even.type)]).take(pa.array(place))

    def __call__(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, offsets) of each side; no text is null: text i has ids[offsets[i]:offsets[i + 1]]."""
        if not len(texts):
            self.spelled = np.zeros(0, bool)
            return [(np.zeros(0, np.uint32), np.zeros(1, np.int64)) for _ in self.sides]
        lists = self.pieces(texts)
        offsets = lists.offsets.to_numpy()
        offsets = (offsets - offsets[0]).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        if len(self.memo) > (self.most or MEMO):
            self._forget()
        if self.led:
            at = self._rows([f" {w}" for w in words])[codes]
        else:
            used = np.zeros(len(words), bool)
            used[np.delete(codes, offsets[:-1])] = True
            rows = np.zeros(len(words), np.int64)
            rows[used] = self._rows([f" {words[i]}" for i in np.flatnonzero(used).tolist()])
            at = rows[codes]
            at[offsets[:-1]] = self._rows([words[i] for i in codes[offsets[:-1]].tolist()])
        self.spelled = np.logical_and.reduceat(self.good[at], offsets[:-1])  # a text has one stretch at least
        out = []
        for flat, start, size in self.known:
            ends = np.concatenate([[0], np.cumsum(size[at], dtype=np.int64)])
            out.append((flat[np.repeat(start[at] - ends[:-1], size[at]) + np.arange(ends[-1])], ends[offsets]))
        return out


def _joined(encode: Callable[[list[str]], list[list[int]]], length: np.ndarray, texts: list[str]) -> list[list[int]]:
    """The ids of each text, from one pass over those that are whole stretches, laid end to end.

    length is the bytes of each id's entry; where tokens do not end with the texts, each text is
    encoded alone.
    """
    whole = [t for t in texts if t[:1] == " " and _EDGE.match(t[-1:] + " ")]
    if len(whole) < 2:
        return encode(texts)
    (ids,) = encode(["".join(whole)])
    ends, stops = np.cumsum(length[ids]), np.cumsum([len(t.encode()) for t in whole])
    last = np.searchsorted(ends, stops)
    if last[-1] >= len(ends) or not np.array_equal(ends[last], stops):
        return encode(texts)
    cut = [0, *(last + 1).tolist()]
    found = {t: ids[a:b] for t, a, b in zip(whole, cut, cut[1:])}
    alone = [t for t in texts if t not in found]
    found.update(zip(alone, encode(alone)))
    return [found[t] for t in texts]


@lru_cache(4)  # a worker's later tasks know the stretches of its earlier ones
def byte_bpe(content: bytes, plain_specials: bool = False, led: bool = False) -> Encoder:
    """The encoder of a tokenizers file; with plain_specials the strings of special tokens are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    told = json.loads(content)
    pre = told.get("pre_tokenizer") or {}
    own = not (told.get("normalizer") or told.get("truncation") or told.get("padding"))
    byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    added = any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in told.get("added_tokens") or [])
    model = Tokenizer.from_str(content.decode())
    model.encode_special_tokens = plain_specials
    length = np.array([len(e) for e in byte_bpe_entries(content)])
    each = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
    split = bool(own and byte_level and not added)
    return Encoder([(lambda texts: _joined(each, length, texts)) if split else each], split, led)


@lru_cache(4)
def piece_bpe(content: bytes) -> Encoder:
    """The encoder of a sentencepiece file; the space before each text is the one that the model adds."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    kept = "".join(model.encode(" a  b\n ", out_type=str)).replace("<0x0A>", "\n") == "▁▁a▁▁b\n▁"
    lone = model.encode("a ")[len(model.encode("a")) :]  # a space that ends a text

    def encode(texts: list[str]) -> list[list[int]]:
        found = model.encode([t[1:] for t in texts], num_threads=1)
        return [lone if t == " " else ids for t, ids in zip(texts, found)]

    return Encoder([encode], kept and not any(re.search("[^▁]▁", p) for p in pieces), True)


@lru_cache(1)
def both(byte: bytes, piece: bytes, memo: int) -> Encoder:
    """The encoder of a tokenizers and a sentencepiece file for the same led texts, special strings plain; stretches are cut and remembered once."""
    sides = byte_bpe(byte, True, True), piece_bpe(piece)
    return Encoder([e.sides[0] for e in sides], all(e.split for e in sides), True, memo, [byte_bpe_entries(byte), piece_entries(piece)])


def byte_bpe_entries(content: bytes) -> list[bytes]:
    """The bytes of each id of a tokenizers file: its entry, byte-level decoded; an added token's own text."""
    told = json.loads(content)
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    table = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    entries = {i: bytes(table[c] for c in e) if all(c in table for c in e) else e.encode() for e, i in told["model"]["vocab"].items()}
    entries |= {t["id"]: t["content"].encode() for t in told.get("added_tokens") or []}
    return [entries.get(i, b"") for i in range(max(entries) + 1)]


def piece_entries(content: bytes) -> list[bytes]:
    """The bytes of each id of a sentencepiece file: its piece in UTF-8, U+2581 as space, <0xHH> as byte HH."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    pieces = ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]


def parts_of(texts: pa.Array, most: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """Ranges of rows of about so many bytes of text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    return list(slices(np.maximum(sizes, 64), most))
