from quarry.operators import compare


def test_a_comparison_joins_lines_and_orders_once(spark):
    plan = compare.compare_status_by_target(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan  # read back, not joined for each use
