"""Rolling hashes of source lines, as code scanning services compare them.

A line's hash covers HASH_BLOCK code units from its first one on, blanks and tabs left out: the
polynomial of UTF-16 code units to HASH_BASE modulo 2^64, in hexadecimal, with the number of
times that the hash has occurred up to there. A carriage return counts as a line feed and swallows one that
follows; the text ends with HASH_END and zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: units of a block, base, unit after the last, lines at most.
HASH_BLOCK, HASH_BASE, HASH_END, HASH_LINES = 100, 37, 65535, 100_000


def _kept_units(text: str) -> np.ndarray:
    """Code units that count, with the end mark: no blanks and tabs, carriage returns as feeds, no feed that a return precedes."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    swallowed = np.zeros(len(units), bool)
    swallowed[1:] = (units[:-1] == 13) & (units[1:] == 10)
    units = units[~(swallowed | (units == 32) | (units == 9))]
    return np.append(np.where(units == 13, np.uint64(10), units), np.uint64(HASH_END))


def line_hashes_of(text: str) -> list[str] | None:
    """`hash:number` of each line; None for a text of more than HASH_LINES lines. The last line may be empty."""
    units = _kept_units(text)
    begins = np.append(0, np.flatnonzero(units[:-1] == 10) + 1)
    if len(begins) > HASH_LINES:
        return None
    padded = np.append(units, np.zeros(HASH_BLOCK, np.uint64))
    sums, base = np.zeros(len(begins), np.uint64), np.uint64(HASH_BASE)
    for k in range(HASH_BLOCK):  # Horner's rule for all lines at once; 64-bit numbers wrap around
        sums = sums * base + padded[begins + k]
    seen: dict[int, int] = {}
    out = []
    for value in sums.tolist():
        seen[value] = seen.get(value, 0) + 1
        out.append(f"{value:x}:{seen[value]}")
    return out


def line_hashes(text: Column) -> Column:
    """The hashes of all lines of a text, first line first; null for null text or too many lines."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else line_hashes_of(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(text)
