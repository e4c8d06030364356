from fieldweave.scratch import Scratch


def test_packed_tables_are_not_collected_for_broadcasts(spark):
    """A file of a megabyte may hold rows of many: the driver must not gather them."""
    scratch = Scratch(spark)
    big = scratch.write(spark.range(200_000).selectExpr("id", "'a' as folder", "'b' as scope", "concat('F', id) as field"), "big")
    small = scratch.write(spark.range(10), "small")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(big.join(big.select("id"), "id"))
    assert "Broadcast" in plan(big.join(small, "id"))
