"""Near intervals, matchings and outcomes against plain loops."""

import itertools
import random

from pyspark.sql import functions as F

from quarry.operators import evaluation, matching

RNG = random.Random(51)


def test_near_intervals_match_all_pairs_at_every_width(spark):
    def some(n):
        for i in range(n):
            start = RNG.choice([RNG.randrange(400), RNG.randrange(20_000), RNG.randrange(10**9)])
            yield i, RNG.choice("pq"), start, start + RNG.choice([0, 3, 127, 128, 200, 9_000, 10**6, 10**9])

    a, b, reach = list(some(120)), list(some(120)), 4
    left = spark.createDataFrame(a, "a long, path string, s0 long, e0 long")
    right = spark.createDataFrame([*b, (900, None, 1, 2)], "b long, path string, s1 long, e1 long")
    got = sorted((r.a, r.b, r.gap) for r in matching.near_intervals(left, right, ["path"], F.lit(reach)).collect())
    told = sorted((i, j, g) for i, p, s, e in a for j, q, t, f in b if p == q for g in [max(0, s - f, t - e)] if g <= reach)
    assert got == told and len(told) > 100


def test_a_hot_path_has_linear_candidates(spark):
    n = 4000
    rows = spark.range(n).select(F.col("id"), F.lit("p").alias("path"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 3).alias("e"))
    left, right = rows.toDF("a", "path", "s0", "e0"), rows.toDF("b", "path", "s1", "e1")
    wide, narrow = matching.binned(left, F.col("s0"), F.col("e0")), matching.binned(right, F.col("s1"), F.col("e1"))
    own = wide.join(narrow.drop("_first", "_own"), ["path", "_level", "_bin"]).where("_level = 0").count()
    assert own < 20 * n and matching.near_intervals(left, right, ["path"]).count() == n


def most_pairs(pairs):
    """The size of the largest matching, by trying all."""
    if not pairs:
        return 0
    (a, b, _), rest = pairs[0], pairs[1:]
    return max(most_pairs(rest), 1 + most_pairs([p for p in rest if p[0] != a and p[1] != b]))


def test_matchings_are_largest_and_one_to_one(spark):
    rows = []
    for unit in range(40):
        edges = RNG.sample(list(itertools.product(range(5), range(5))), RNG.randrange(1, 11))
        rows += [(unit, a, b, RNG.randrange(100, 160)) for a, b in edges]
    got = {}
    for r in matching.matching(spark.createDataFrame(rows, "unit long, a long, b long, score long"), ["unit"]).collect():
        got.setdefault(r.unit, []).append((r.a, r.b, r.score))
    for unit in range(40):
        pairs, found = [r[1:] for r in rows if r[0] == unit], got[unit]
        assert set(found) <= set(pairs) and len({a for a, _, _ in found}) == len({b for _, b, _ in found}) == len(found) == most_pairs(pairs)
        assert sorted(found) == matching.best_matching(pairs)  # components apart give what the unit gives as a whole


def test_matching_prefers_scores_and_survives_long_paths():
    assert matching.best_matching([(1, 1, 5), (1, 2, 9), (2, 2, 1)]) == [(1, 1, 5), (2, 2, 1)]
    assert matching.best_matching([(1, 1, 5), (1, 2, 5), (1, 3, 4)]) == [(1, 1, 5)]
    chain = [(i, i, 10) for i in range(5000)] + [(i, i + 1, 11) for i in range(4999)] + [(5000, 0, 1), (5000, 1, 1), (5000, 2, 1)]
    assert len(matching.best_matching(chain)) == 5000


def test_outcomes_of_failed_runs_and_spare_findings(spark):
    expected = spark.createDataFrame([("c", 1, ["CWE-1", "CWE-2"], "p", 10, 12, None, ["high"]), ("c", 1, ["CWE-1", "CWE-2"], "q", 1, None, 0, ["high"]), ("c", 2, ["CWE-3"], "p", 50, None, 0, None)], "case_id string, a long, cwes array<string>, path string, start_line long, end_line long, near int, severities array<string>")
    found = spark.createDataFrame(
        [("c", 0, 7, ["CWE-2", "CWE-1"], "p", 17, None, True, False, True, "low"), ("c", 0, 7, ["CWE-2", "CWE-1"], "q", 1, 4, True, False, True, "low"), ("c", 0, 8, ["CWE-3"], "p", 51, None, True, True, True, "high"), ("c", 1, 9, ["CWE-1"], "p", 12, 12, True, True, True, "high"), ("c", 2, 5, ["CWE-3"], "p", 50, 50, True, True, False, None)],
        "case_id string, run int, b long, cwes array<string>, path string, start_line long, end_line long, validated boolean, attack_path boolean, evidence boolean, severity string",
    )
    runs = spark.createDataFrame([("c", 0, True), ("c", 1, False), ("c", 2, True), ("d", 0, True)], "case_id string, run int, completed boolean")
    pairs = matching.candidates(expected, found)
    assert sorted((r.run, r.a, r.b, r.score) for r in pairs.collect()) == [(0, 1, 7, 170), (1, 1, 9, 160), (2, 2, 5, 160)]
    rows = matching.outcomes_of(expected.dropDuplicates(["a"]), found.dropDuplicates(["run", "b"]), runs, matching.matching(pairs, ["case_id", "run"]))
    got = {(r.case_id, r.run): (r.completed, r.expected, r.reported, r.tp, r.fp, r.fn, r.validated, r.judged, r.severity_ok) for r in evaluation.run_results(rows).collect()}
    assert got == {("c", 0): (True, 2, 2, 1, 1, 1, 1, 1, 0), ("c", 1): (False, 2, 0, 0, 0, 2, 0, 0, 0), ("c", 2): (True, 2, 1, 1, 0, 1, 1, 0, 0), ("d", 0): (True, 0, 0, 0, 0, 0, 0, 0, 0)}
