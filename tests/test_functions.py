"""Column functions, readers and helpers in the cases that queries over the tables do not hold."""

import itertools
import json
import random
from collections import Counter

from pyspark.sql import functions as F

from quarry.functions import text as T


def one(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_globs_end_with_the_path(spark):
    c = F.col("p")
    got = one(spark, "p string", [("ab\n",), ("ab",), ("a/x/b",), ("a.b",)], T.glob(c, "a*b"), T.glob(c, "a[!.]b"), T.glob(c, "a?"))
    assert got == [(False, False, False), (True, False, True), (True, False, False), (True, False, False)]


def test_weakness_ids_have_one_to_seven_digits(spark):
    rows = [("cwe-99999999999999999999 CWE: 79, cwe_079 xcwe-5 CWE 22b CWE22",), ("none",)]
    assert one(spark, "t string", rows, F.array_join(T.cwe_ids(F.col("t")), ",")) == [("CWE-22,CWE-79",), ("",)]


def test_cells_are_no_formulas(spark):
    cells = ["=1", "＝1", " ＋1", "－x", "＠x", "\tx", "x=1", "", " x"]
    got = [r[0] for r in one(spark, "c string", [(c,) for c in cells], T.guarded_cell(F.col("c")))]
    assert got == [f"'{c}" if i < 6 else c for i, c in enumerate(cells)]


def test_fingerprints_hash_the_algorithm_too(spark):
    import hashlib

    got = one(spark, "a string, b string", [("t", None)], T.fingerprint(F.col("a"), F.lit("r"), F.lit("x"), F.col("b")))
    assert got == [(f"{T.ALGORITHM}:sha256:" + hashlib.sha256(f"{T.ALGORITHM}\0t\0r\0x\0".encode()).hexdigest(),)]


def test_byte_prefixes_end_between_characters(spark):
    rows = [("aé" * 30,), ("€" * 20,), ("😀" * 11,), ("short",)]
    got = [r[0] for r in one(spark, "t string", rows, T.byte_prefix(F.col("t"), 40))]
    assert got == [t.encode()[:40].decode(errors="ignore") for (t,) in rows]


def test_paths_below_their_root(spark):
    rows = ["a/b", "./a/./b", "a//b", "/a", "C:\\a", "a\\..\\b", "..", "a/..b", "", "a\0b"]
    got = [r[0] for r in one(spark, "p string", [(r,) for r in rows], T.relative_path(F.col("p")))]
    assert got == ["a/b", "a/b", "a/b", None, None, None, None, "a/..b", None, None]


def test_remotes_give_host_and_path(spark):
    rows = ["https://H.example/a/b.git", "ssh://git@h.example:22/a", "git@h.example:a/b.git", "https://h.example:8443/a", "https://h.example/a?x", "file:///a", "nonsense"]
    got = [r[0] and tuple(r[0]) for r in one(spark, "r string", [(r,) for r in rows], T.git_origin(F.col("r")))]
    assert got == [("h.example", "a/b"), ("h.example", "a"), ("h.example", "a/b"), ("h.example:8443", "a"), None, None, None]


def test_row_numbers_of_many_ranges_are_those_of_one(spark):
    from quarry.operators.ordering import numbered

    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.7 else rnd.choice([None, "a"]), rnd.choice([None, *range(40)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v long, i long")
    few, many = (sorted((r.i, r.nth) for r in numbered(df, ["k"], [F.col("v"), F.col("i")], F.col("v"), range_rows=n).collect()) for n in (10**6, 30))
    assert few == many


def test_line_hashes_match_their_definition(spark):
    """Each line by the plain definition: 100 units from its first on, by powers of 37, over a list of units and marks."""
    from quarry.functions import linehash

    rnd = random.Random(31)
    texts = ["", "\n", "a b\nc\n", "a\r\nb\rc\r \nd", " \t\n\n", "x\U0001f600é\n" * 3, "abc" * 60 + "\n" + "q", "same\n" * 250]
    texts += ["".join(rnd.choice("ab \t\r\n\U0001f600é") for _ in range(rnd.randrange(400))) for _ in range(50)]
    for text in texts:
        units, starts, fresh, data = [], [], True, text.encode("utf-16-be")
        codes = [int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data), 2)]
        for i, c in enumerate([*codes, 65535]):
            if c in (32, 9) or (c == 10 and i and codes[i - 1] == 13):
                continue
            if fresh:
                starts.append(len(units))
            fresh = c in (10, 13)
            units.append(10 if c == 13 else c)
        told, seen = [], Counter()
        for s in starts:
            h = sum(u * 37 ** (99 - k) for k, u in enumerate(units[s : s + 100])) % 2**64
            seen[h] += 1
            told.append(f"{h:x}:{seen[h]}")
        assert linehash.line_hashes_of(text) == told
    assert linehash.line_hashes_of("\n" * 99_999) is not None and linehash.line_hashes_of("\n" * 100_000) is None
    got = spark.createDataFrame([("a b\n",), (None,)], "t string").select(linehash.line_hashes(F.col("t")).alias("h")).collect()
    assert [r.h and len(r.h) for r in got] == [2, None]


def test_bounded_json_keeps_its_budget(spark):
    from quarry.functions import bounded

    rnd = random.Random(32)

    def tree(depth):
        kind = rnd.randrange(7 if depth < 6 else 4)
        if kind < 4:
            return ["te\"xt é" * rnd.randrange(9), rnd.randrange(10**6), None, True][kind]
        size = rnd.randrange(30)
        return [tree(depth + 1) for _ in range(size)] if kind == 4 else {"k" * rnd.randrange(4) + str(i): tree(depth + 1) for i in range(size)}

    def levels(v):
        parts = v.values() if isinstance(v, dict) else v if isinstance(v, list) else []
        return 1 + max(map(levels, parts), default=0) if isinstance(v, (dict, list)) else 0

    rows = [(json.dumps(tree(0)), most) for most in (1, 2, 5, 40, 300, 5000) for _ in range(30)]
    for most in {m for _, m in rows}:
        df = spark.createDataFrame([(t,) for t, m in rows if m == most] + [("{",), (None,)], "t string")
        got = df.select("t", bounded.bounded_json(F.col("t"), most).alias("j")).collect()
        assert [r.j for r in got[-2:]] == [None, None]
        for r in got[:-2]:
            whole, cut = json.loads(r.t), json.loads(r.j)
            assert len(r.j) <= most + 8 and levels(cut) <= 4  # a last number, null or empty text
            if len(json.dumps(whole, separators=(",", ":"))) <= most and levels(whole) <= 4 and "," not in r.t:
                assert cut == whole


def test_bounded_json_cases(spark):
    from quarry.functions.bounded import bounded_json

    cases = [
        ('{"a":1,"b":"long text here"}', dict(most=16), '{"a":1,"b":"lo"}'),
        ('{"a":"é\\n\\ud83d\\ude00x"}', dict(most=17), '{"a":"\\u00e9\\n"}'),
        ("[1,[2,[3,[4,[5]]]]]", dict(most=99), "[1,[2,[3,[null,null]]]]"),
        (json.dumps(list(range(30))), dict(most=999), json.dumps(list(range(20)), separators=(",", ":"))),
        ('{"z":"zzzz","note":"abcdef","evidence":"0123456789"}', dict(most=99, reserved=[(("proof", "evidence"), 6)], priority=["note"]), '{"evidence":"0123","note":"abcdef","z":"zzzz"}'),
        ('{"codeA":[{"code":"abcdef","n":1},2,3],"codeB":[]}', dict(most=99, snippets=[(("codeA", "codeB"), 2, "code", 5)]), '{"codeA":[{"code":"abc","n":1},2]}'),
        ('"text"', dict(most=99, priority=["x"]), '"text"'),
    ]
    for given, how, told in cases:
        (got,) = spark.createDataFrame([(given,)], "t string").select(bounded_json(F.col("t"), **how)).first()
        assert got == told


def test_readers_tell_what_is_wrong(spark, tmp_path):
    from quarry.sources import files

    (tmp_path / "a.jsonl").write_text('{"id":"X","s":"1"}\n\n{"id":\n{"id":"x","s":"2"}\n{"id":"x","s":"torn"}')
    found = files.json_lines(spark, f"{tmp_path}/a.jsonl", "id string, s string")
    assert sorted((r.line, r.fault) for r in found.collect()) == [(1, None), (2, "blank line"), (3, "not JSON"), (4, None), (5, None)]
    assert [(r.receipt, r.s) for r in files.receipts(spark, f"{tmp_path}/a.jsonl", "id string, s string", "id").collect()] == [("x", "2")]
    (tmp_path / "b.csv").write_text(f"id,x,rev\na,1,{'0' * 40}\n\nA,2,{'1' * 40}\nb,2\nc,3,main\n")
    rows, faults = files.csv_inventory(spark, f"{tmp_path}/b.csv", ["id", "x", "rev"])
    assert sorted((r.line, r.fault) for r in faults.collect()) == [(2, "repeated id"), (4, "repeated id"), (5, "width"), (6, "revision")]
    assert rows.count() == 3
    (tmp_path / "c.json").write_bytes(b'\xef\xbb\xbf{"a": 1}')
    assert [tuple(r) for r in files.json_documents(spark, f"{tmp_path}/c.json", "a int").select("doc.a", "fault").collect()] == [(1, None)]
    moved = spark.createDataFrame([("M\0a\0R100\0old\0new\0D\0c\0",)], "z string")
    assert [tuple(r) for r in files.name_status(moved).collect()] == [("M", "a"), ("R", "new"), ("D", "c")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "n.py").write_bytes(b"a\0b")
    (tmp_path / "d" / "t.py").write_bytes(b"ab")
    kept = files.repository_files(spark, f"{tmp_path}/d", F.lit(False), [".py"]).collect()
    assert [r.path.rsplit("/", 1)[1] for r in kept] == ["t.py"]
