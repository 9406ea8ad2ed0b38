"""Alignments against a plain model that walks the bytes of both encodings."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from oracle import SF

from quarry.llm import align, queries, tokens

RNG = random.Random(13)
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def told(rows):
    """Rows of the contract, by whole-text encodings and byte offsets."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_path, b_path = tokens.public_path(tokens.BYTE_BPE), tokens.public_path(tokens.PIECE_BPE)
    model_a, model_b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
    model_a.encode_special_tokens = True
    bytes_a, bytes_b = tokens.byte_bpe_entries(tokens.file_bytes(a_path)), tokens.piece_entries(tokens.file_bytes(b_path))
    found, seen = [], Counter()
    for _, t in rows:
        a, b = (model_a.encode(f" {t}", add_special_tokens=False).ids, model_b.encode(t)) if t else ([], [])
        if b"".join(bytes_a[i] for i in a) != f" {t}".encode() or b"".join(bytes_b[i] for i in b) != f" {t}".encode():
            a = b = []
        ends = []
        for ids, known in ((a, bytes_a), (b, bytes_b)):
            at = 0
            ends.append([at := at + len(known[i]) for i in ids])
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        seen.update(links.keys())
        found.append((a, b, groups, links))
    most = defaultdict(int)
    for (x, _), n in seen.items():
        most[x] = max(most[x], n)
    out = []
    for (i, _), (a, b, groups, links) in zip(rows, found):
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(groups), sum(links.values()), sum(n for p, n in links.items() if seen[p] == most[p[0]]), sum(n * seen[p] for p, n in links.items()), digest))
    return out


def aligned(df, path, hot):
    found = align.align(df, f"{path}/d")
    sums = align.linked_counts(found, f"{path}/p", hot)
    got = found.join(sums, "row", "left").fillna(0, ["n_best", "count_sum"]).select(COLUMNS)
    return sorted(map(tuple, got.collect()), key=str)


def test_alignment_matches_a_plain_model(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op12_align"](spark, SF)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == sorted(told(rows))


@pytest.mark.parametrize("hot", [1, 20, 100_000])
def test_alignment_of_odd_rows(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(align, "PART_BYTES", 200)
    parts = ["word", "é", "\U00010348", " ", "  ", "\n", "<s>", "<|endoftext|>", "▁", "123", "'s", "über", "\0", "aaaaaaaaaaaa", "日本語", "́"]
    rows = [(i, "".join(RNG.choice(parts) for _ in range(RNG.randrange(30)))) for i in range(60)]
    rows += [(None, "no id"), (3, None), (3, ""), (3, " "), (3, "same same"), (3, "same same"), (9, "long word " * 3000), (10, "x" * 5000 + "日" * 3000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row int, n int")
    assert aligned(df, tmp_path, hot) == sorted(told(rows), key=str)


def test_alignment_of_nothing(spark, tmp_path):
    assert aligned(spark.createDataFrame([], "doc_id long, text string"), tmp_path, 10) == []
    assert aligned(spark.createDataFrame([(1, None)], "doc_id long, text string"), f"{tmp_path}/n", 10) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_wide_groups_count_equal_ids_first(monkeypatch):
    import numpy as np

    values = np.array([RNG.randrange(4) for _ in range(300)])
    start, size, doc = np.array([[0, 20], [50, 100]]), np.array([[20, 30], [50, 200]]), np.array([0, 1])
    before = [x.tolist() for x in align.Fold.pairs(values, start, size, doc)]
    monkeypatch.setattr(align, "WIDE_GROUP", 1)
    assert [x.tolist() for x in align.Fold.pairs(values, start, size, doc)] == before and sum(before[3]) == 20 * 30 + 50 * 200


def test_documents_are_shuffled_once_before_the_cuts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    enc = align.encoded(docs, tokens.public_path(tokens.BYTE_BPE), tokens.public_path(tokens.PIECE_BPE)).repartition(4, "row")
    sizes = [spark.createDataFrame([(0, 1)], "id smallint, size int")] * 2
    with align.documents_stay_together(spark):
        cuts = align.cuts_of(enc, sizes).groupBy("row").count()
        made = enc.join(cuts, "row", "left")
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 2 and plan.count("ReusedExchange") >= 2, plan
    assert plan.count("+- MapInArrow") == 1 and "SortMergeJoin" in plan  # all three readers of the documents share one shuffle
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
