"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' normalised words make one automaton; each document's words stream through it, and the
automaton tells after every word the length of the longest run, ending there, that some item
holds. A run of 13 words is a window of an item; an item of fewer words is one window by itself.
Words inside an occurrence of a window are hit.

Items are built into automata of at most `CHUNK_WORDS` words each, so that what is broadcast has
a fixed bound; a larger benchmark takes one pass over the documents for each automaton, and the
passes' hits are united.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, unused
from quarry.plans.session import materialize

WINDOW = 13
#: Words of one broadcast automaton; a single longer item is cut into parts that overlap by WINDOW - 1 words.
CHUNK_WORDS = 200_000

#: Letters in lower case, digits and bytes from 0x80 on are parts of words; all else separates.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


class Automaton:
    """Suffix automaton over word numbers of many items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.windows: dict[tuple[int, ...], set[str]] = {}
        shorts: dict[int, int] = {}
        for item, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            last = 0
            for c in ids:
                last = self._extend(last, c)
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1):
                self.windows.setdefault(tuple(ids[i : i + n]), set()).add(item)
        for gram in self.windows:
            if len(gram) < window:
                state = 0
                for c in gram:
                    state = self.next[state][c]
                shorts[state] = shorts.get(state, 0) | 1 << len(gram)  # lengths within one state differ
        self.short = [shorts.get(s, 0) for s in range(len(self.link))]
        #: The nearest state up the suffix links, itself included, that ends a short item; 0 for none.
        self.above = [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.above[s] = s if self.short[s] else self.above[self.link[s]]
        self.has_short = bool(shorts)

    def _extend(self, last: int, c: int) -> int:
        to = self.next[last].get(c)
        if to is not None:
            return to if self.length[to] == self.length[last] + 1 else self._clone(last, to, c)
        state = self._add(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p != -1:
            to = self.next[p][c]
            self.link[state] = to if self.length[to] == self.length[p] + 1 else self._clone(p, to, c)
        return state

    def _clone(self, p: int, to: int, c: int) -> int:
        copy = self._add(self.length[p] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = copy
        while p != -1 and self.next[p].get(c) == to:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _add(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal hit ranges of the words, and the items whose windows occur."""
        spans: list[list[int]] = []
        items: set[str] = set()
        following, link, length, window = self.next, self.link, self.length, self.window
        state = run = 0
        ids = list(map(self.vocab.get, words))
        for i, c in enumerate(ids):
            if c is None:
                state = run = 0
                continue
            to = following[state].get(c)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = following[state].get(c)
            if to is None:
                continue
            state, run = to, run + 1
            found = 0
            if run >= window:
                found = window
                items |= self.windows.get(tuple(ids[i + 1 - window : i + 1]), set())
            if self.has_short:
                s = self.above[state]
                while s:
                    for n in range(min(run, window - 1), 0, -1):
                        if self.short[s] >> n & 1:
                            items |= self.windows[tuple(ids[i + 1 - n : i + 1])]
                            found = max(found, n)
                    s = self.above[link[s]]
            if found:
                lo = i + 1 - found
                while spans and lo <= spans[-1][1]:
                    lo = min(lo, spans.pop()[0])
                spans.append([lo, i + 1])
        return [(a, b) for a, b in spans], items


def chunks(items: DataFrame, item: str, text: str, limit: int = CHUNK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Item words in lists of at most limit words; rows come to the driver one partition at a time."""
    some: list[tuple[str, list[bytes]]] = []
    total = 0
    step = max(limit - WINDOW + 1, WINDOW)
    for row in items.select(F.col(item).cast("string"), text).where(f"{item} is not null and {text} is not null").toLocalIterator():
        words = words_of(row[1])
        for i in range(0, max(len(words) - WINDOW + 1, 1), step):
            part = words[i : i + step + WINDOW - 1]
            if part:
                some.append((row[0], part))
                total += len(part)
            if total >= limit:
                yield some
                some, total = [], 0
    if some:
        yield some


def scan(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """(doc_id, text, n_words, spans, items): spans are flat pairs of word offsets."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            n, spans, items = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                hit, found = machine.hits(words)
                n.append(len(words))
                spans.append([x for s in hit for x in s])
                items.append(sorted(found))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_words", "spans", "items"])

    return docs.mapInArrow(run, "row struct<doc_id:bigint,tid:bigint>, n_words long, spans array<bigint>, items array<string>")


def _spans_udf(spark: SparkSession, automaton: Automaton):
    shared = spark.sparkContext.broadcast(automaton)

    @F.arrow_udf("struct<n_words:bigint,spans:array<bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            n, spans = [], []
            for text in texts:
                words = words_of(text.as_py())
                n.append(len(words))
                spans.append([x for s in shared.value.hits(words)[0] for x in s])
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64()))], ["n_words", "spans"])

    return run


def _union_spans(flat: list[list[int]]) -> list[int]:
    out: list[int] = []
    for lo, hi in sorted((s[i], s[i + 1]) for s in flat for i in range(0, len(s), 2)):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


def _united(spans):
    """One list of flat pairs made of several."""

    @F.arrow_udf("array<bigint>")
    def run(lists: pa.Array) -> pa.Array:
        return pa.array([_union_spans(x) for x in lists.to_pylist()], pa.list_(pa.int64()))

    return run(spans)


def contamination(docs: DataFrame, items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, tid, n_words, spans, items): the hit word ranges and item ids of every document.

    tid is xxhash64 of the text, so that rows that share a doc_id stay apart. Null texts have no
    words; empty items and null ids are no items; equal items are all named; an empty benchmark
    hits nothing. Other columns of either table are not read.
    """
    asked = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid")).alias("row"), "text")
    first: DataFrame | None = None
    more: list[DataFrame] = []
    for part in chunks(items, item, text):
        found = scan(asked, Automaton(part))
        if first is None:
            first = found
        else:
            more.append(materialize(found.where("size(spans) > 0").distinct()))
    if first is None:
        first = scan(asked, Automaton([]))
    if more:
        extra = more[0]
        for x in more[1:]:
            extra = extra.unionAll(x)
        extra = extra.groupBy("row").agg(F.collect_list("spans").alias("s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("i"))
        both = F.array_append(F.coalesce("s", F.array().cast("array<array<bigint>>")), F.col("spans"))
        ids = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("i", F.array().cast("array<string>")))))
        first = first.join(extra.withColumnRenamed("row", "r"), F.col("row").eqNullSafe(F.col("r")), "left").select("row", "n_words", _united(both).alias("spans"), ids.alias("items"))
    return first.select("row.doc_id", "row.tid", "n_words", "spans", "items")


def hit_words(spans: str = "spans"):
    """The number of words in flat pairs of offsets."""
    signed = F.transform(F.col(spans), lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)


def decontaminate(docs: DataFrame, items: DataFrame, share: float = 0.05, action: str = "drop") -> DataFrame:
    """docs without the contaminated rows (`drop`), or without their hit passages (`cut`).

    A document is contaminated if at least one word and at least share of its words are hit. `cut`
    leaves the other words in place, joined by the text between them. All columns of docs stay.
    """
    parts = chunks(items, "item_id", "text")
    first = next(parts, None)
    if first is None:
        return docs
    found_, hit_, tid_, spans_, id_ = (unused(docs.columns, c) for c in ("_found", "_hit", "_tid", "_spans", "_id"))
    if next(parts, None) is None:  # one automaton: decided row by row, without a join
        spans = _spans_udf(docs.sparkSession, Automaton(first))
        counted = docs.withColumn(found_, spans("text")).withColumn(hit_, hit_words(f"{found_}.spans"))
        bad = (F.col(hit_) > 0) & (F.col(hit_) >= share * F.col(f"{found_}.n_words"))
        if action == "drop":
            return counted.where(~bad).select(*docs.columns)
        return counted.withColumn("text", F.when(bad, _cut("text", f"{found_}.spans")).otherwise(F.col("text"))).select(*docs.columns)
    found = contamination(docs, items).withColumn("n_hit", hit_words())
    bad = found.where((F.col("n_hit") > 0) & (F.col("n_hit") >= share * F.col("n_words")))
    bad = bad.dropDuplicates(["doc_id", "tid"]).select(F.col("doc_id").alias(id_), F.col("tid").alias(f"{id_}_text"), F.col("spans").alias(spans_))
    keyed = docs.withColumn(tid_, F.xxhash64("text"))
    on = keyed["doc_id"].cast("long").eqNullSafe(bad[id_]) & (keyed[tid_] == bad[f"{id_}_text"])
    if action == "drop":
        return keyed.join(bad, on, "left_anti").drop(tid_)
    marked = keyed.join(bad, on, "left")
    text = F.when(F.col(spans_).isNull(), F.col("text")).otherwise(_cut("text", spans_))
    return marked.withColumn("text", text).select(*docs.columns)


def _cut(text: str, spans: str):
    """A text column without the words of its spans."""

    @F.arrow_udf("string")
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([t if t is None or s is None else cut_words(t, s) for t, s in zip(texts.to_pylist(), lists.to_pylist())], pa.string())

    return run(text, spans)


def cut_words(text: str, spans: list[int]) -> str:
    """text without the words in flat pairs of word offsets, and without what stands between them."""
    data = text.encode()
    marks = data.translate(WORDS)
    at, places = 0, []
    for w in marks.split():
        at = marks.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    out, end = [], 0
    for i in range(0, len(spans), 2):
        out.append(data[end : places[spans[i]][0]])
        end = places[spans[i + 1] - 1][1]
    return b"".join([*out, data[end:]]).decode()


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("n_hit", hit_words())
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


ORACLE = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM item, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS r(i) WHERE len(w) > 0
), size AS (SELECT DISTINCT n FROM win
), gram AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM doc, size, unnest(range(1, len(w) - n + 2)) AS r(i)
), occ AS (
  SELECT gram.doc_id, gram.n, gram.i, win.item_id FROM gram JOIN win ON gram.n = win.n AND gram.g = win.g
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, n, i FROM occ), unnest(range(i, i + n)) AS r(p) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM occ GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
