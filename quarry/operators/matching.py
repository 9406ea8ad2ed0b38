"""One-to-one matches of expected and reported findings, and the outcomes of runs that follow from them.

Candidates share a path and a weakness and lie near each other. Intervals meet in bins: each is put
into the bins of the narrowest level that is no narrower than itself, and of all wider ones that
the other side's intervals are of, two a level at most; a pair is taken in the first bin that both have at the wider of their levels, so a path with very many
findings is no quadratic group. Candidates are matched by connected component, never a whole run
at a time; pairs that have no rival are matched at once.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph import connected_components
from quarry.plans.session import materialize

#: Fixed: points of a candidate, of each weakness that is shared and of equal places, and lines between that are still near.
BASE_SCORE, SHARED_SCORE, PLACE_SCORE, NEAR_LINES = 100, 10, 50, 5
#: Lines of the narrowest bins, how many times wider each level is, and the levels.
BIN_LINES, WIDER, LEVELS = 128, 64, 5
WIDTHS = [BIN_LINES * WIDER**i for i in range(LEVELS)]


def own_level(start: Column, end: Column) -> Column:
    """The narrowest level that is no narrower than the interval."""
    own = F.lit(LEVELS - 1)
    for i in reversed(range(LEVELS - 1)):
        own = F.when(end - start + 1 <= WIDTHS[i], i).otherwise(own)
    return own


def binned(rows: DataFrame, start: Column, end: Column, others: Iterable[int] = range(LEVELS)) -> DataFrame:
    """rows with (_own, _level, _bin): the bins of the interval at its own level and every wider one of others."""
    own, others = own_level(start, end), set(others)
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(w).cast("long").alias("width")) for i, w in enumerate(WIDTHS)])
    meets = lambda x: (x["level"] == own) | ((x["level"] > own) & x["level"].isin(*others))
    at = rows.withColumn("_own", own).withColumn("_l", F.explode(F.filter(levels, meets)))
    floor = lambda c: F.floor(c / F.col("_l.width"))
    return at.withColumn("_first", floor(start)).withColumn("_bin", F.explode(F.sequence(floor(start), floor(end)))).withColumn("_level", F.col("_l.level")).drop("_l")


def near_intervals(left: DataFrame, right: DataFrame, keys: list[str], reach: Column | None = None) -> DataFrame:
    """Pairs of left (keys, a, s0, e0) and right (keys, b, s1, e1) with equal keys and at most reach lines between, as `gap`.

    reach (0 if not given) is a column of left. Null keys meet nothing; other columns stay. The
    levels that the intervals are of are asked for first, LEVELS numbers a side at most, so that
    no row is put into bins where nothing can meet it; both tables are read twice.
    """
    left = left.withColumn("_reach", F.lit(0) if reach is None else reach)
    at0, at1 = (F.col("s0") - F.col("_reach"), F.col("e0") + F.col("_reach")), (F.col("s1"), F.col("e1"))
    levels0, levels1 = ([r[0] for r in t.select(own_level(*at)).distinct().collect()] for t, at in ((left, at0), (right, at1)))
    wide = binned(left, *at0, levels1).withColumnsRenamed({"_own": "_own0", "_first": "_first0"})
    narrow = binned(right, *at1, levels0)
    met = wide.join(narrow, [*keys, "_level", "_bin"])
    first = (F.col("_level") == F.greatest("_own0", "_own")) & (F.col("_bin") == F.greatest("_first0", "_first"))
    gap = F.greatest(F.lit(0), F.col("s0") - F.col("e1"), F.col("s1") - F.col("e0"))
    return met.where(first).withColumn("gap", gap).where(F.col("gap") <= F.col("_reach")).drop("_reach", "_own0", "_own", "_first0", "_first", "_level", "_bin")


def candidates(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(case_id, run, a, b, score) of expected (case_id, a, cwes, path, start_line, end_line, near) and found (case_id, run, b, cwes, path, start_line, end_line).

    A row is one location; a finding with several has several rows, and its best place counts. A
    missing end is the start, a missing near NEAR_LINES.
    """
    left = expected.select("case_id", "path", "a", F.col("cwes").alias("cwes0"), F.col("start_line").alias("s0"), F.coalesce("end_line", "start_line").alias("e0"), F.coalesce("near", F.lit(NEAR_LINES)).alias("near"))
    right = found.select("case_id", "path", "run", "b", F.col("cwes").alias("cwes1"), F.col("start_line").alias("s1"), F.coalesce("end_line", "start_line").alias("e1"))
    near = near_intervals(left, right, ["case_id", "path"], F.col("near"))
    shared = F.size(F.array_intersect("cwes0", "cwes1"))
    score = BASE_SCORE + SHARED_SCORE * shared + PLACE_SCORE - F.col("gap")
    return near.where(shared > 0).groupBy("case_id", "run", "a", "b").agg(F.max(score).cast("long").alias("score"))


def best_matching(pairs: list[tuple[object, object, int]]) -> list[tuple[object, object, int]]:
    """A matching of (a, b, score) of the most pairs: those a with the fewest choices first, each trying its best b first.

    Ties go to the lesser b. Where a b is taken, its owner looks for another first (augmenting
    paths, depth first), without recursion.
    """
    choices: dict = {}
    for a, b, score in pairs:
        choices.setdefault(a, []).append((-score, b))
    for options in choices.values():
        options.sort()
    owner: dict = {}
    for start in sorted(choices, key=lambda a: (len(choices[a]), a)):
        tried: set = set()
        walk = [(start, iter(choices[start]), None)]  # who looks, what is left to try, and the b it would give up
        while walk:
            a, rest, _ = walk[-1]
            b = next((b for _, b in rest if b not in tried), None)
            if b is None:
                walk.pop()
                continue
            tried.add(b)
            if b in owner:
                walk.append((owner[b], iter(choices[owner[b]]), b))
                continue
            for a, _, gives in reversed(walk):
                owner[b], b = a, gives
            break
    score = {(a, b): s for a, b, s in pairs}
    return sorted((a, b, score[a, b]) for b, a in owner.items())


def matching(pairs: DataFrame, unit: list[str]) -> DataFrame:
    """(unit, a, b, score): a one-to-one matching of the most candidates in each unit; a and b are numbers, each pair one row."""
    pairs = materialize(pairs.select(*unit, "a", "b", "score"))
    rivals = [pairs.groupBy(*unit, side).agg(F.count("*").alias(f"_{side}")) for side in "ab"]
    counted = pairs.join(rivals[0], [*unit, "a"]).join(rivals[1], [*unit, "b"])
    alone = (F.col("_a") == 1) & (F.col("_b") == 1)
    lone = counted.where(alone).select(*unit, "a", "b", "score")
    rest = materialize(counted.where(~alone).select(*unit, "a", "b", "score"))
    if not rest.take(1):
        return lone
    node = lambda side: F.to_json(F.struct(F.lit(side).alias("s"), *unit, F.col(side).alias("n")))
    edges = rest.select("*", node("a").alias("_u"), node("b").alias("_v"))
    parts = connected_components(edges, "_u", "_v")
    grouped = edges.join(parts, F.col("_u") == F.col("node")).select(*unit, "a", "b", "score", "component")
    fields = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}

    def match(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = best_matching(list(zip(group["a"].tolist(), group["b"].tolist(), group["score"].tolist())))
        return pd.DataFrame({**{u: [group[u].iloc[0]] * len(found) for u in unit}, **{c: [r[i] for r in found] for i, c in enumerate(("a", "b", "score"))}})

    schema = ", ".join(f"`{c}` {fields[c]}" for c in (*unit, "a", "b", "score"))
    return lone.unionAll(grouped.groupBy("component").applyInPandas(match, schema))


def outcomes_of(expected: DataFrame, found: DataFrame, runs: DataFrame, matches: DataFrame) -> DataFrame:
    """(case_id, run, item, completed, expected, found, validated, attack_path, evidence, severity_ok): what each run made of each expectation and finding.

    runs is (case_id, run, completed); a run that failed misses all that is expected and reports
    nothing. expected is (case_id, a, severities; null: any), found (case_id, run, b, validated, attack_path,
    evidence, severity), one row each. item is a, or b for findings that match nothing; a row with a
    null item, neither expected nor found, says that a run took place.
    """
    told = found.select("case_id", "run", "b", "validated", "attack_path", "evidence", "severity")
    held = matches.select("case_id", "run", "a", "b").join(told, ["case_id", "run", "b"])
    asked = runs.join(expected.select("case_id", "a", "severities"), "case_id")
    judged = asked.join(held, ["case_id", "run", "a"], "left")
    hit = F.col("completed") & F.col("b").isNotNull()
    fine = F.when(hit & F.col("severities").isNotNull(), F.coalesce(F.array_contains("severities", F.col("severity")), F.lit(False)))
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("validated", "attack_path", "evidence")]
    rows = judged.select("case_id", "run", F.col("a").alias("item"), "completed", F.lit(True).alias("expected"), hit.alias("found"), *flags, fine.alias("severity_ok"))
    spare = told.join(runs.where("completed"), ["case_id", "run"]).join(matches.select("case_id", "run", "b"), ["case_id", "run", "b"], "left_anti")
    took_place = runs.select("case_id", "run", F.lit(None).cast("long").alias("item"), "completed", *[F.lit(False).alias(c) for c in ("expected", "found", "validated", "attack_path", "evidence")], F.lit(None).cast("boolean").alias("severity_ok"))
    return rows.unionAll(took_place).unionAll(spare.select("case_id", "run", F.col("b").alias("item"), "completed", F.lit(False).alias("expected"), F.lit(True).alias("found"), *flags, F.lit(None).cast("boolean").alias("severity_ok")))
