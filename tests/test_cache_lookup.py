"""Requests against cached questions, questions against documents: pairs stay where they are made, in tasks of a bounded number."""

from pyspark.sql import functions as F

from quarrylight.operators import match


def test_pairs_are_not_shuffled(spark, monkeypatch):
    asked = [(n, "user" if n % 3 else "assistant", f"turbine number {n} of the northern coast in winter {n % 4}") for n in range(60)]
    asked += [(5, "user", "turbine number 5 of the northern coast in winter 1"), (100, None, "turbine"), (101, "user", None), (102, "user", ""), (103, "user", "don't turn"), (104, "user", "unlike all")]
    r = spark.createDataFrame(asked, "rid long, scope string, question string")
    e = r.where("rid % 2 = 1").withColumnRenamed("rid", "eid")
    new = match.cache_lookup(r, e)
    few = {tuple(x) for x in new.collect()}
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(match, "MOST_ENTRIES", 0)
    many = {tuple(x) for x in match.cache_lookup(r, e).collect()}
    assert few == many and {x[0] for x in few} >= {1, 3, 103}, few ^ many
    assert not {100, 101, 102} & {x[0] for x in few}


def test_tasks_follow_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(match, "TASK_PAIRS", 100, raising=False)
    docs = spark.range(300).select(F.col("id").alias("document"), (F.col("id") % 7).alias("size"), F.concat(F.lit("wind tower "), (F.col("id") % 5).cast("string"), F.lit("x")).alias("about"))
    asked = spark.createDataFrame([(1, "wind"), (2, "tower 3x"), (3, "nothing")], "qid int, question string")
    found = match.metadata_matches(asked, docs, 2)
    assert "hashpartitioning(document#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 9), REPARTITION_BY_NUM" in plan
    assert sorted(tuple(r) for r in found.collect()) == [(1, 6, 0.37, 1), (1, 13, 0.37, 2), (2, 13, 0.49, 1), (2, 48, 0.49, 2)]
