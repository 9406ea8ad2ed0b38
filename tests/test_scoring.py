"""What findings of consecutive scans carry to their pairs."""

from pyspark.sql import functions as F

from quarry.operators import matching, scoring
from quarry.plans import views
from tests.oracle import SF


def test_rows_lie_in_no_bins_where_nothing_can_meet_them(spark, monkeypatch):
    made, plain = [], matching.binned
    monkeypatch.setattr(matching, "binned", lambda *a: made.append(plain(*a)) or made[-1])
    rows = spark.range(50).select("id", F.lit("p").alias("path"), (F.col("id") * 1280).alias("s"), (F.col("id") * 1280 + 9).alias("e"))
    assert matching.near_intervals(rows.toDF("a", "path", "s0", "e0"), rows.toDF("b", "path", "s1", "e1"), ["path"]).count() == 50
    assert [m.count() for m in made] == [50, 50]  # one bin a row, none of the four wider levels


def test_only_findings_with_a_neighbour_are_kept(spark):
    loc = views.located(views.occurrences(spark, SF), spark, SF).where("path IS NOT NULL")
    keys = {(r.target_id, r.yr, r.path): 1 for r in loc.collect()}
    told = sorted(k for k in keys if {(k[0], k[1] - 1, k[2]), (k[0], k[1] + 1, k[2])} & keys.keys())
    got = scoring.adjacent(spark, SF)
    assert sorted((r.target_id, r.yr, r.path) for r in got.collect()) == told and 0 < len(told) < len(keys)
    assert "o_orderkey" not in scoring.interval_matches(spark, SF)._jdf.queryExecution().optimizedPlan().toString()  # read back, not joined for each side
