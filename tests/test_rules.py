"""Rules of paths, patterns, inventories, SARIF and names in the cases where a simpler rule goes wrong."""

import fnmatch
import random

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import compare, ordering
from quarry.sources import files

RNG = random.Random(41)


def test_shell_patterns_of_a_column_match_whole_paths(spark):
    letters = ["a", "b", "/", ".", "*", "?", "[", "]", "!", "-", "^", "\\", "&", "+", "(", "$", "\n", "é"]
    rows = [("".join(RNG.choice(letters) for _ in range(RNG.randrange(6))), "".join(RNG.choice(letters) for _ in range(RNG.randrange(7)))) for _ in range(3000)]
    rows += [("src/a.test.js", "*.test.js"), ("a]b", "a[]]b"), ("a-b", "a[!x]b"), ("b", "[z-a]"), ("x\ny", "x?y")]
    df = spark.createDataFrame(rows, "path string, pattern string")
    got = df.select("path", "pattern", F.rlike("path", T.glob_regex(F.col("pattern"))).alias("m")).collect()
    wrong = [r for r in got if r.m != fnmatch.fnmatchcase(r.path, r.pattern) and r.pattern.count("[") < 2 and "-" not in r.pattern]
    assert not wrong and sum(r.m for r in got) > 50


def test_coverage_knows_patterns_and_missing_lists(spark):
    rows = [
        ("src/a.test.js", True, ["."], ["*.test.js"], [], False), ("src/a.js", True, ["."], ["*.test.js"], [], True), ("src/a.js", True, ["src/"], [], [], True),
        ("src/a.js", True, ["./src"], ["lib"], ["src/[ab].js"], False), ("src/a.js", True, ["sr"], [], [], False), ("src/a.js", True, None, [], [], False),
        ("src/a.js", True, ["."], None, [], False), ("src/a.js", True, ["."], [], None, False), (None, True, ["."], [], [], False), ("", True, ["."], [], [], False),
        ("src/a.js", False, ["."], [], [], False), ("src/a.js", True, ["."], [None], [], True), ("src", True, ["src"], ["src/*"], [], True),
    ]
    df = spark.createDataFrame(rows, "path string, complete boolean, i array<string>, x array<string>, e array<string>, told boolean")
    got = df.select(compare.covers(*[F.col(c) for c in ("path", "complete", "i", "x", "e")]).alias("got"), "told").collect()
    assert [r.got for r in got] == [r.told for r in got]


def test_uris_stay_below_their_root(spark):
    rows = [
        ("file:///srv/app/a%20b.py", "a b.py"), ("file:///etc/passwd", None), ("..%2F..%2Fetc/passwd", None), ("https://evil.example/a.py", None), ("file://evil.example/srv/app/a.py", None),
        ("file://localhost/srv/app/x/y.py?q#f", "x/y.py"), ("file:/srv/app/a", "a"), ("/srv/app/z+1.py", "z+1.py"), ("/srv/application/z.py", None), ("/srv/app/../etc", None),
        ("src//a.py#L1", "src/a.py"), ("C:/a.py", None), ("a%00b", None), ("a%2", None), ("a%5Cb.py", "a/b.py"), ("//host/a", None), ("", None), (None, None), ("/srv/app/", None), ("./a/./b", "a/b"),
    ]
    got = spark.createDataFrame(rows, "u string, told string").select("u", T.decoded_path(F.col("u"), "/srv/app").alias("got"), "told").collect()
    assert [(r.u, r.got) for r in got] == [(r.u, r.told) for r in got]


def test_packages_excuse_only_folders_below_their_root(spark):
    rows = [
        ("node_modules/x/src/main/java/A.java", True), ("src/main/java/build/A.java", False), ("src/main/java/org/build/A.java", False), ("build/src/main/java/A.java", True),
        ("src/main/java/A/build", True), ("src/main/java/node_modules/A.java", True), ("a/build.py", False), ("a/lock.json", True), ("a.min.js", True), ("m/src/test/java/build/x/build/T.java", False),
    ]
    got = spark.createDataFrame(rows, "p string, told boolean").select("p", T.is_excluded(F.col("p"), ["node_modules", "build"], [".min.js"], ["lock.json"], ["build"]).alias("got"), "told").collect()
    assert [(r.p, r.got) for r in got] == [(r.p, r.told) for r in got]


def test_weakness_zero_is_none(spark):
    assert spark.createDataFrame([("CWE-0 cwe_79 CWE-079 CWE 0000",)], "t string").select(T.cwe_ids(F.col("t"))).first()[0] == ["CWE-79"]


def test_severity_of_sarif_scores_and_defaults(spark):
    import json

    rules = [{"id": str(i), "properties": {"security-severity": s}} if s is not None else {"id": str(i), "defaultConfiguration": {"level": "warning"}} for i, s in enumerate(["7.125", "1e1", "9", "NaN", "Infinity", "0", None])]
    results = [{"ruleId": str(i), "message": {"text": "m"}, "level": "note" if i < 6 else None, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a"}, "region": {"startLine": 1}}}]} for i in range(7)]
    doc = json.dumps({"runs": [{"tool": {"driver": {"rules": rules}}, "results": results}]})
    df = spark.createDataFrame([("p", doc)], "path string, t string").select("path", F.from_json("t", files.SARIF).alias("doc"))
    assert [r.severity for r in files.sarif_results(df).orderBy("result").collect()] == ["high", "critical", "high", "low", "low", "low", "medium"]


def test_inventories_with_quotes(spark, tmp_path):
    sha, long = "A" * 40, "0" * 64
    (tmp_path / "i.csv").write_text(f'id,"own, er",revision\nok,"a,b ""c""",{sha}\n"q.1",x,{long}\n,,\nbad id,x,{sha}\nw,{sha}\nt"o,x,{sha}\nr1,x,main\nR1,x,{sha}\n')
    rows, faults = files.csv_inventory(spark, f"{tmp_path}/i.csv", ["id", "own, er", "revision"])
    assert sorted((r.line, r.fault) for r in faults.collect()) == [(5, "unsafe id"), (6, "width"), (7, "quotes"), (8, "repeated id"), (8, "revision"), (9, "repeated id")]
    got = {r.id: (r["own, er"], r.revision) for r in rows.collect()}
    assert got["ok"] == ('a,b "c"', sha.lower()) and got["q.1"] == ("x", long)


def test_names_are_unique_as_if_given_one_by_one(spark):
    bases = ["a", "a", "a-2", "a-2-2", "b", "a-2", "a", "a-3", "b-2", "b", "b", "a"] + [RNG.choice(["x", "x-2", "x-3", "x-2-2", "y"]) for _ in range(60)]
    taken, told = set(), []
    for base in bases:
        name, n = base, 2
        while name in taken:
            name, n = f"{base}-{n}", n + 1
        taken.add(name)
        told.append(name)
    df = spark.createDataFrame(list(enumerate(bases)), "i long, base string")
    got = ordering.uniquely_named(df, "base", ["i"], F.col("i"))
    assert [r.name for r in got.orderBy("i").collect()] == told


def test_consumers_of_folders_and_names(spark):
    from quarry.operators import evidence, history

    made = spark.createDataFrame([(1, "w", "out/a/x.bin"), (2, "w", "out"), (3, "v", "out/a/x.bin"), (4, "w", None)], "producer int, workflow string, artifact string")
    used = spark.createDataFrame([(7, "w", "out/a"), (8, "w", "out/a/x.bin"), (9, "w", "out/a/x"), (10, "w", "out"), (11, "w", None)], "consumer int, workflow string, wanted string")
    found = evidence.consumers(made, used)
    assert sorted((r.producer, r.consumer) for r in found.collect()) == [(1, 7), (1, 8), (1, 10), (2, 10)]
    scans, rows = spark.createDataFrame([(1,), (2,)], "scan_id int"), spark.createDataFrame([(1, 3), (1, 0), (1, 3)], "scan_id int, sev int")
    assert sorted(map(tuple, history.severity_mix(scans, rows).collect())) == [(1, "critical: 1, low: 2"), (2, "none")]
