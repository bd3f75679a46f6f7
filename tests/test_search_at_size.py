"""Search over word lists that are much larger than the tables they come from."""

from memlake.operators import search as X


def test_spelling_sends_no_keys_through_the_driver(spark, tmp_path):
    """Some 80 keys a word, which the planner takes for as few as the words: the tables are small, the join must be a merge all the same."""
    spark.createDataFrame([("deploy",), ("deplyo",), ("storrage",), ("unheard",)], "word string").write.parquet(f"{tmp_path}/words")
    spark.createDataFrame([("deploy",), ("storage",)], "v string").write.parquet(f"{tmp_path}/vocabulary")
    df = X.spelling(spark.read.parquet(f"{tmp_path}/words"), spark.read.parquet(f"{tmp_path}/vocabulary"))
    assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
    assert {(r.word, r.fixed) for r in df.collect()} == {("deplyo", "deploy"), ("storrage", "storage")}
