"""SimHash near-duplicates: fingerprints, linked through vantage-point trees.

A tree holds one part of every fingerprint (its key). It splits by the Hamming distance to a
vantage point: at or below a bound goes left, above it right; by the triangle inequality a query of
radius r with distance d needs the left side only if d <= bound + r and the right side only if
d > bound - r. Every node has a vantage point of its own, the best of several by balance and by how
few keys lie so near the bound that they go both ways. The upper levels, fitted on a sample of 64
fingerprints a shard (bounded by `SAMPLE_BYTES`), deal fingerprints to shards: each is at home in
one shard and queries every shard that its ball overlaps, so no pair is lost at a boundary. Inside
a shard the same splitting goes on down to small leaves; keys within reach are compared on more bits.

* Fingerprints of 64 bits within `RADIUS` = 3 bits agree to within one bit on at least one 32-bit
  half (3 // 2 = 1), so two trees find every pair.
* `similar_documents` asks for a Jaccard similarity of sets of word shingles instead. Majority bits
  tell the angle of two multisets, which misses the similarity of small or unequal sets; so the
  `WIDE` bits of its fingerprints are min-wise ones (a bit of the shingle whose permuted hash is
  least): each differs with a chance of (1 - similarity) / 2, whatever the sizes. `TREES` keys of 32
  bits are searched with a radius of `REACH`; a pair at 0.8 is met with a chance of 0.996, and of
  more above. They only find candidates, up to `SIGMAS` standard deviations over the expected
  distance of `CHECK` bits: all of them, so that few pairs of a large group whose texts are hardly
  less similar than asked have to be tried. A candidate is linked if the exact similarity of the shingle sets is
  reached; where one is refused its class is searched again, until no candidate is untried.

Groups of copies collapse to one fingerprint first, and shards return spanning links, never all
pairs of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import LOWER, find, slices, table, union_pairs, unused
from quarry.operators.graph import connected_components
from quarry.plans.session import materialize

RADIUS = 3
#: Bytes of the sample that vantage points are fitted on, and vantage points tried for a node.
SAMPLE_BYTES, TRIES = 32 << 20, 6
#: Distinct fingerprints at home in a shard, about: of 64 bits, and wide ones.
SHARD, WIDE_SHARD = 1 << 16, 1 << 18
#: Below this a branch is compared in full.
LEAF = 128
#: Text bytes that are made shingle sets at a time, about.
PART_BYTES = 1 << 21
#: Bits of a wide fingerprint; its trees, of which each has a 32-bit word as its key, and the radius of its searches.
WIDE, TREES, REACH = 1024, 32, 1
#: Bits that candidates are compared by, and the standard deviations that they may lie over the expected distance.
CHECK, SIGMAS = 1024, 4
#: Trees that are searched first; the others then look only between the classes that these found.
FIRST = 4
#: Pairs of a shard for each of its rows that are tried at once: at first, and when a class is searched again.
AT_FIRST, TRIED = 0.25, 64
#: Rows of a table that is broadcast at most, 16 bytes each; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Odd multipliers, each a permutation of 32-bit hashes; made by one rule.
_ODD = ((np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)).astype(np.uint32)) | np.uint32(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of the word shingles; 0 for a text without words."""
    w = words_of(text)
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        h = [digest(b" ".join(w), 42)]
    else:
        line, ends, at = b" ".join(w), [], -1
        for x in w:
            at += len(x) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends)]
        h = [digest(line[s:e], 42) for s, e in zip(starts, ends[words - 1 :])]
    hashes = np.array(h, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; a text of fewer words is one shingle, without words none."""
    w = words_of(text)
    if not w:
        return np.zeros(0, np.uint64)
    each = np.fromiter((xxhash.xxh64_intdigest(x) for x in w), np.uint64, len(w))
    n = max(1, len(w) - words + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(words, len(w))):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + each[k : k + n]
    return np.unique(h ^ (h >> np.uint64(29)))


def _wide(h: np.ndarray) -> bytes:
    if not len(h):
        return bytes(WIDE // 8)
    low = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    least = np.full(WIDE, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 64):
        np.minimum(least, (low[i : i + 64, None] * _ODD).min(axis=0), out=least)
    return np.packbits((least * np.uint32(0x85EBCA6B)) >> np.uint32(31)).tobytes()


def wide_fingerprint(text: str | None, words: int = 5) -> bytes:
    """`WIDE` min-wise bits of the set of word shingles; zero for a text without words."""
    return _wide(shingles(text, words))


def distance_at(similarity: float, bits: int = WIDE) -> int:
    """The expected distance of fingerprints at a Jaccard similarity."""
    return round(bits * (1 - similarity) / 2)


def radius_at(similarity: float, bits: int = CHECK) -> int:
    """The distance that fingerprints of a similarity hardly exceed."""
    p = (1 - similarity) / 2
    return int(np.ceil(bits * p + SIGMAS * np.sqrt(bits * p * (1 - p))))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp as 8 big-endian bytes. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t.as_py(), words).to_bytes(8, "big") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.binary())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp binary")


def wide_fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, tid, fp, node, n): tid is xxhash64 of the text, node of its set of n shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(2):
                h = shingles(t.as_py(), words)
                out.append((_wide(h), xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63), len(h)))
            fp, node, n = zip(*out) if out else ((), (), ())
            made = [pa.array(fp, pa.binary()), pa.array(node, pa.int64()), pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "tid", "fp", "node", "n"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tid"), "text")
    return rows.mapInArrow(run, "doc_id long, tid long, fp binary, node long, n int")


def _bytes(column) -> np.ndarray:
    """Binary values of one width as rows of bytes."""
    values = column.to_pylist()
    if not values:
        return np.zeros((0, 0), np.uint8)
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


@dataclass
class Tree:
    """Vantage points, bounds and both children of the nodes; a negative child is a leaf, ~child its shard."""

    point: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    right: np.ndarray
    shards: int


def _split(part: np.ndarray, points: np.ndarray, reach: int) -> tuple[int, int] | None:
    """The vantage point and bound that divide part most evenly and thinly; None if all are equal to each point."""
    best, found = None, np.inf
    for point in points:
        d = np.bincount(np.bitwise_count(part ^ point), minlength=34)
        below = np.cumsum(d) / len(part)
        bound = int(np.argmin(np.abs(below - 0.5)))
        share = below[bound]
        if 0 < share < 1:
            near = d[max(0, bound - reach + 1) : bound + reach + 1].sum() / len(part)
            cost = abs(share - 0.5) + near / 2
            if cost < found:
                best, found = (int(point), bound), cost
    return best


def build_tree(sample: np.ndarray, most: float, reach: int = 1) -> Tree:
    """A tree whose leaves hold at most `most` of the sample, but for equal keys, which nothing divides."""
    pick = np.random.default_rng(1)
    point, bound, left, right, shards = [], [], [], [], 0
    todo: list[tuple[np.ndarray, list | None, int]] = [(sample, None, 0)]
    while todo:
        part, up, at = todo.pop()
        found = None
        if len(part) > max(most, 1):
            found = _split(part, np.concatenate([pick.choice(sample, TRIES), pick.choice(part, 2)]), reach)
        if found is None:
            name, shards = ~shards, shards + 1
        else:
            name = len(point)
            point.append(found[0])
            bound.append(found[1])
            left.append(0)
            right.append(0)
            near = np.bitwise_count(part ^ np.uint32(found[0])) <= found[1]
            todo += [(part[near], left, name), (part[~near], right, name)]
        if up is not None:
            up[at] = name
    return Tree(np.array(point, np.uint32), np.array(bound, np.int64), np.array(left, np.int64), np.array(right, np.int64), shards)


def shards_of(key: np.ndarray, tree: Tree, reach: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, at home) for every shard that a ball of radius reach around a row overlaps."""
    rows, home = np.arange(len(key)), np.ones(len(key), bool)
    node = np.full(len(key), 0 if len(tree.point) else ~0, np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(rows):
        leaf = node < 0
        done.append((rows[leaf], ~node[leaf], home[leaf]))
        rows, node, home = rows[~leaf], node[~leaf], home[~leaf]
        d, bound = np.bitwise_count(key[rows] ^ tree.point[node]).astype(np.int64), tree.bound[node]
        near = d <= bound
        to_left, to_right = d <= bound + reach, d > bound - reach
        rows, node, home = (
            np.concatenate([rows[to_left], rows[to_right]]),
            np.concatenate([tree.left[node[to_left]], tree.right[node[to_right]]]),
            np.concatenate([(home & near)[to_left], (home & ~near)[to_right]]),
        )
    return tuple(np.concatenate(x) for x in zip(*done)) if done else (rows, node, home)


def span_pairs(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the sets of a[i] and b[i] in place; returns the i that do so, the first ones preferred, without cycles."""
    used, at = [np.zeros(0, np.int64)], np.arange(len(a))
    while len(at):
        x, y = find(parent, a[at]), find(parent, b[at])
        apart = x != y
        at, x, y = at[apart], x[apart], y[apart]
        high, first = np.unique(np.maximum(x, y), return_index=True)
        parent[high] = np.minimum(x, y)[first]
        used.append(at[first])
    return np.concatenate(used)


class Joined:
    """Takes pairs by joining their sets in parent."""

    def __init__(self, parent: np.ndarray):
        self.parent = parent

    def take(self, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> None:
        union_pairs(self.parent, a, b)


class Candidates(Joined):
    """Takes pairs that are to be tried: up to `most` one by one, then only those that join two sets.

    refused has the sorted codes (lesser * rows + greater) of pairs that were tried before.
    """

    def __init__(self, parent: np.ndarray, refused: np.ndarray, most: int):
        super().__init__(parent)
        self.refused, self.most, self.held = refused, most, 0
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = []

    def take(self, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> None:
        if len(self.refused):
            code = np.minimum(a, b) * len(self.parent) + np.maximum(a, b)
            at = np.minimum(np.searchsorted(self.refused, code), len(self.refused) - 1)
            new = self.refused[at] != code
            a, b, distance = a[new], b[new], distance[new]
        if spanning := self.held + len(a) > self.most:
            order = np.argsort(distance, kind="stable")
            a, b, distance = a[order], b[order], distance[order]
            used = span_pairs(self.parent, a, b)
            a, b, distance = a[used], b[used], distance[used]
        else:
            self.held += len(a)
        if len(a):
            self.pairs.append((a, b, distance, spanning))


def search(key: np.ndarray, full: np.ndarray, home: np.ndarray, found: Joined, radius: int, reach: int = 1) -> None:
    """Gives found every query with the rows at home whose keys are within reach and whose bits are within radius.

    full has 64-bit words by row. Rows that are in one set already are not compared again.
    """
    parent = found.parent
    stack = [(np.flatnonzero(home), np.arange(len(full)))]
    while stack:
        h, q = stack.pop()
        if not len(h) or not len(q):
            continue
        if len(h) > LEAF:
            point = key[h[len(h) // 2]]
            dh, dq = np.bitwise_count(key[h] ^ point), np.bitwise_count(key[q] ^ point).astype(np.int64)
            middle = int(np.median(dh))
            left = dh <= middle
            same = bool(left.all())
            if same and middle:
                middle -= 1  # most lie at the median: split below it
                left = dh <= middle
                same = not left.any()
            if not same:
                stack += [(h[left], q[dq <= middle + reach]), (h[~left], q[dq > middle - reach])]
                continue
        for j in range(0, len(h), LEAF):
            part = h[j : j + LEAF]
            own, asked = find(parent, part), q
            if (own == own[0]).all():
                asked = q[find(parent, q) != own[0]]
            for i in range(0, len(asked), 4096):
                some = asked[i : i + 4096]
                x, y = np.nonzero(np.bitwise_count(key[some, None] ^ key[None, part]) <= reach)
                for k in range(0, len(x), 65536):
                    a, b = some[x[k : k + 65536]], part[y[k : k + 65536]]
                    apart = find(parent, a) != find(parent, b)
                    a, b = a[apart], b[apart]
                    if len(a):
                        distance = np.bitwise_count(full[a] ^ full[b]).sum(axis=1, dtype=np.int64)
                        near = distance <= radius
                        found.take(a[near], b[near], distance[near])


def _entry(words: int) -> np.dtype:
    """A dealt fingerprint: its key, node and class, whether it is at home, and the 64-bit words that pairs are compared by."""
    return np.dtype([("key", "<u4"), ("home", "?"), ("node", "<i8"), ("class", "<i8"), ("bits", "<u8", (words,))])


Parts = Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def _halves(prints: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of a tree and the compared words of 64-bit fingerprints."""
    return np.ascontiguousarray(prints[:, 4 * tree : 4 * tree + 4]).view("<u4").ravel(), prints.view("<u8")


def _words(prints: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of wide fingerprints: a word, and the words after it."""
    word = prints.view("<u4")
    after = (tree + 1 + np.arange(CHECK // 32)) % word.shape[1]
    return np.ascontiguousarray(word[:, tree]), np.ascontiguousarray(word[:, after]).view("<u8")


_DEALT = "tree int, shard long, data binary, refusals binary, refused binary"


def _dealt(fps: DataFrame, trees: range, parts: Parts, words: int, shard_rows: int, reach: int) -> DataFrame:
    """Packed entries by (tree, shard), for every shard that a row's balls overlap.

    fps has (fp, node), and may have its class and a list of refused nodes, which go along.
    """
    n, classed, more = fps.count(), "class" in fps.columns, "refused" in fps.columns
    wanted = max(4096, 64 * n // shard_rows)
    some = fps.select("fp")
    if n > wanted:
        some = some.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(wanted / n * (1 << 30)))
    width = 8 if parts is _halves else WIDE // 8
    sample = some.limit(min(2 * wanted, SAMPLE_BYTES // width)).toArrow().column("fp")  # SAMPLE_BYTES at most
    prints = _bytes(sample)
    most = len(prints) * shard_rows / max(n, 1)
    grown = {k: build_tree(parts(prints, k)[0] if len(prints) else np.zeros(0, np.uint32), most, reach) for k in trees}
    shared, dtype = fps.sparkSession.sparkContext.broadcast(grown), _entry(words)  # a node for about 32 of the sample

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            prints, node = _bytes(batch.column(0)), batch.column(1).to_numpy()
            classes = batch.column(2).to_numpy() if classed else node
            for k in trees:
                key, bits = parts(prints, k)
                rows, shard, home = shards_of(key, shared.value[k], reach)
                order = np.argsort(shard, kind="stable")
                rows, shard = rows[order], shard[order]
                made = np.empty(len(rows), dtype)
                for name, x in (("key", key[rows]), ("home", home[order]), ("node", node[rows]), ("class", classes[rows]), ("bits", bits[rows])):
                    made[name] = x
                out = []
                cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
                for lo, hi in zip(cuts, cuts[1:]):
                    row = {"tree": k, "shard": int(shard[lo]), "data": made[lo:hi].tobytes(), "refusals": b"", "refused": b""}
                    if more:
                        lists = batch.column(3).take(pa.array(rows[lo:hi]))
                        row |= {"refusals": lists.value_lengths().fill_null(0).to_numpy().astype("<i4").tobytes(), "refused": lists.flatten().to_numpy().tobytes()}
                    out.append(row)
                yield pa.RecordBatch.from_pylist(out, schema=_DEALT_SCHEMA)

    return fps.select("fp", "node", *(["class"] if classed else []), *(["refused"] if more else [])).mapInArrow(deal, _DEALT)


_DEALT_SCHEMA = pa.schema([("tree", pa.int32()), ("shard", pa.int64()), ("data", pa.binary()), ("refusals", pa.binary()), ("refused", pa.binary())])


def _held(group: pa.Table, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a shard in the order of their nodes, and that order."""
    data = np.frombuffer(b"".join(group.column("data").to_pylist()), _entry(words))
    order = np.argsort(data["node"], kind="stable")
    return data[order], order


def links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD) -> DataFrame:
    """Spanning links (a, b) between the nodes of distinct 64-bit fingerprints within radius (3 at most).

    fps has (fp, node), one row a fingerprint.
    """

    def join(group: pa.Table) -> pa.Table:
        held, _ = _held(group, 1)
        node, parent = held["node"], np.arange(len(held))
        search(np.ascontiguousarray(held["key"]), held["bits"], held["home"], Joined(parent), radius)
        root = find(parent, np.arange(len(node)))
        moved = root != np.arange(len(node))
        return pa.table({"a": node[moved], "b": node[root[moved]]})

    return _dealt(fps.select("fp", "node"), range(2), _halves, 1, shard_rows, 1).groupBy("tree", "shard").applyInArrow(join, "a long, b long")


def candidates(nodes: DataFrame, similarity: float, trees: range = range(TREES)) -> DataFrame:
    """(a, b, apart, spanning) of pairs of nodes that may reach the similarity, a < b; apart is the distance of their compared bits.

    nodes has (fp, node), in a later search the class that it is in, and when a class is searched again
    `refused`, an array of larger nodes that it was compared with; then pairs are of different classes.
    Where spanning is false nothing was left out on account of the pair.
    """
    radius, words = radius_at(similarity), CHECK // 64
    again = "refused" in nodes.columns

    def join(group: pa.Table) -> pa.Table:
        held, order = _held(group, words)
        node, refused = held["node"], np.zeros(0, np.int64)
        _, first, at = np.unique(held["class"], return_index=True, return_inverse=True)
        parent = first[at]
        if again:
            many = np.frombuffer(b"".join(group.column("refusals").to_pylist()), "<i4")
            other = np.frombuffer(b"".join(group.column("refused").to_pylist()), np.int64)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            owner = np.repeat(place, many)
            at = np.minimum(np.searchsorted(node, other), len(node) - 1)
            here = node[at] == other
            refused = np.sort(owner[here] * len(node) + at[here])
        found = Candidates(parent, refused, int((TRIED if again else AT_FIRST) * len(node)))
        search(np.ascontiguousarray(held["key"]), held["bits"], held["home"], found, radius, REACH)
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), False), *found.pairs]
        a, b, apart = (np.concatenate(x) for x in list(zip(*parts))[:3])
        spanning = np.repeat([p[3] for p in parts], [len(p[0]) for p in parts])
        return pa.table({"a": node[np.minimum(a, b)], "b": node[np.maximum(a, b)], "apart": apart.astype(np.int32), "spanning": spanning})

    dealt = _dealt(nodes, trees, _words, words, WIDE_SHARD, REACH)
    pairs = dealt.groupBy("tree", "shard").applyInArrow(join, "a long, b long, apart int, spanning boolean")
    return pairs.groupBy("a", "b").agg(F.min("apart").alias("apart"), F.max("spanning").alias("spanning"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, grams) of the wanted (node, tid)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(sizes, PART_BYTES):
                sets = [shingles(t.as_py(), words).view(np.int64) for t in batch.column(1).slice(lo, hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.list_(pa.int64()))], names=["node", "grams"])

    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.select(F.xxhash64("text").alias("tid"), "text").join(few, "tid").dropDuplicates(["node"])
    return texts.select("node", "text").mapInArrow(run, "node long, grams array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b, spanning) with whether the exact Jaccard similarity of their sets is reached."""
    a, b = (sets.select(F.col("node").alias(x), F.col("grams").alias(f"_{x}")) for x in "ab")
    both = F.size(F.array_intersect("_a", "_b"))
    joined = pairs.join(a, "a").join(b, "b")
    return joined.select("a", "b", "spanning", (both / (F.size("_a") + F.size("_b") - both) >= similarity).alias("good"))


def _between(pairs: DataFrame, classes: DataFrame | None) -> DataFrame:
    """pairs of different classes, with the classes as ca and cb; at first each node is a class."""
    if classes is None:
        return pairs.withColumn("ca", F.col("a")).withColumn("cb", F.col("b"))
    for end in "ab":
        own = classes.select(F.col("node").alias(end), F.col("component").alias("_c"))
        pairs = pairs.join(own, end, "left").withColumn(f"c{end}", F.coalesce("_c", end)).drop("_c")
    return pairs.where("ca <> cb")


def _closest(pairs: DataFrame) -> DataFrame:
    """Of each class, the pair that is least apart; one aggregation with map-side minima."""
    pair = F.struct("apart", "a", "b", "spanning")
    ends = pairs.select(F.explode(F.array("ca", "cb")).alias("c"), pair.alias("p"))
    return ends.groupBy("c").agg(F.min("p").alias("p")).select("p.*").distinct()


def similar_sets(docs: DataFrame, prints: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, component) of the distinct shingle sets that are linked to others.

    A few trees are searched first, and the others between the classes that these gave, so that a
    large group of copies is not linked anew by every tree. Candidates of the first are verified in
    rounds: the closest of each class, then all that still lie between two classes; a group of copies
    costs about two comparisons a text. The others find what is left of such groups, at once.
    """
    nodes = materialize(prints.where("n > 0").dropDuplicates(["node"]).select("fp", "node", "tid"))
    pairs = sets = tried = classes = None
    for trees, rounds in ((range(FIRST), (False, False, True)), (range(FIRST, TREES), (True,))):
        asked = nodes.select("fp", "node")
        if classes is not None:
            asked = materialize(asked.join(classes, "node", "left").select("fp", "node", F.coalesce("component", "node").alias("class")))
        new = materialize(candidates(asked, similarity, trees))
        ends = new.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if sets is not None:
            ends = ends.join(sets, "node", "left_anti")
        made = materialize(shingle_sets(docs, materialize(nodes.join(ends, "node", "left_semi").select("node", "tid")), words))
        sets = made if sets is None else sets.unionAll(made)
        rest = new
        for whole in rounds:
            rest = _between(rest if tried is None else rest.join(tried, ["a", "b"], "left_anti"), classes)
            if not whole:
                rest = materialize(rest)  # classes only grow, so later rounds need no more than this
            found = materialize(verified(rest if whole else _closest(rest), sets, similarity))
            tried = found if tried is None else tried.unionAll(found)
            classes = materialize(connected_components(tried.where("good")))
        pairs = new if pairs is None else pairs.unionAll(new)
    open_ones = None
    while tried.where("not good and spanning").limit(1).count():
        if open_ones is None:  # what candidates link with a pair that is not similar
            reached = materialize(connected_components(pairs))
            refusing = tried.where("not good and spanning").join(reached, tried["a"] == reached["node"]).select("component").distinct()
            open_ones = materialize(nodes.join(reached.join(refusing, "component", "left_semi").select("node"), "node", "left_semi"))
        refused = tried.where("not good").groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("refused"))
        asked = open_ones.join(classes, "node", "left").join(refused, "node", "left")
        asked = materialize(asked.select("fp", "node", F.coalesce("component", "node").alias("class"), "refused"))
        new = materialize(verified(candidates(asked, similarity), sets, similarity))
        # only what a new spanning pair stood for is open
        tried = materialize(tried.withColumn("spanning", F.lit(False)).unionAll(new))
        classes = materialize(connected_components(tried.where("good")))
    return classes


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs.

    component_id is the least doc_id reachable through links of at most 3 differing bits, copies
    included. Null and empty texts have fingerprint 0 and link like any other; repeated rows stay;
    a row with a null doc_id keeps its fingerprint, links nothing and has a null component_id. An
    empty table gives an empty result; other columns of docs are not read.
    """
    prints = materialize(fingerprints(docs, words))
    distinct = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = connected_components(links(distinct))
    classes = distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, tid, component_id) of every row of docs; a component is a class of similar texts.

    Texts are linked whose sets of word shingles have the Jaccard similarity or more; the pairs that
    are compared are those that the trees find. Classes are what links reach. Null and empty texts are
    one class. component_id is a number of the class, made of its shingles; ids take no part in it,
    so rows with a null or repeated doc_id link like others through their text alone. Repeated rows
    stay; an empty table gives no rows; other columns of docs are not read.
    """
    prints = materialize(wide_fingerprints(docs, words))
    found = similar_sets(docs, prints, words, similarity)
    return prints.join(found, "node", "left").select("doc_id", "tid", F.coalesce("component", "node").alias("component_id"))


def drop_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each class of similar texts: the least by doc_id (null last), then text hash.

    All columns of docs stay, whatever their names. Ids may be null or repeated; rows of one text are
    one class; null and empty texts are one class; texts of any length count whole.
    """
    classes = materialize(similar_documents(docs, words, similarity))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tid"))
    kept = classes.groupBy("component_id").agg(first.alias("k"))
    same = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("tid") == F.col("k.tid"))
    gone = materialize(classes.join(kept, "component_id").where(~same).select(F.col("doc_id").alias("_gone_id"), F.col("tid").alias("_gone_tid")).distinct())
    few = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    own = unused(docs.columns, "_tid")
    rows = docs.withColumn(own, F.xxhash64("text"))
    stay = rows.join(few, rows["doc_id"].cast("long").eqNullSafe(few["_gone_id"]) & (rows[own] == few["_gone_tid"]), "left_anti")
    repeated = classes.groupBy("doc_id", "tid").count().where("count > 1").limit(1).count()
    return (stay.dropDuplicates(["doc_id", own]) if repeated else stay).drop(own)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
