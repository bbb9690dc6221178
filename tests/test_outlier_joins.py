"""Outliers of few keys: no task sorts all rows of a key."""

from silt.operators import ranks


def test_rows_of_few_keys_are_not_shuffled_by_key(spark):
    df = spark.range(3000).selectExpr("id", "CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS k", "CAST(id % 50 + IF(id = 7, 1e6, 0) AS double) AS x")
    got = ranks.mad_outliers(df, ["k"], "x")
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in got.collect()] == [7]
