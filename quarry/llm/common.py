"""Small helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII capitals to small letters, bytes of any other kind unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def renamed(columns: list[str], own: list[str]) -> dict[str, str]:
    """What each column is called beside the result's own: `<name>_in` (and on) where the names clash."""
    taken, out = {*own, *columns}, {}
    for c in columns:
        name = c
        while name in own or (name != c and name in taken):
            name += "_in"
        out[c] = name
        taken.add(name)
    return out


def unused(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column has it."""
    while name in columns:
        name = f"_{name}"
    return name


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes sum to about limit; a larger row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def union_pairs(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i] in place; the root of a set is its least member."""
    while len(a):
        a, b = find(parent, a), find(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = up
