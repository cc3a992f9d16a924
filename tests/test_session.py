import random

from vellumspark.operators.folds import fold_groups
from vellumspark.session import checkpointed, join_measured


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_what_was_measured_is_broadcast(spark):
    big = spark.range(100).selectExpr("id % 7 as k", "id")
    small = spark.createDataFrame([(k, ["seed"] * 5, "x" * 50) for k in range(7)], "k bigint, seeds array<string>, name string")
    near, far = join_measured(big, small, ["k"]), join_measured(big, small, ["k"], limit_mb=0)
    assert "broadcast" in plan(near) and "broadcast" not in plan(far)
    assert near.count() == far.count() == 100
    assert join_measured(big, small.where("false"), ["k"], "left").count() == 100


def test_checkpoint_cuts_the_lineage(spark):
    df = checkpointed(spark.range(10).selectExpr("id * 2 as x"))
    assert "Range" not in plan(df) and sorted(r["x"] for r in df.collect()) == list(range(0, 20, 2))


def test_folds_see_whole_groups_in_order(spark):
    rows = [(f"g{i % 23}", None if i % 5 == 0 else i, float(i) if i % 3 else None) for i in range(3000)]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, n int, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = fold_groups(df, ["g"], ["n"], lambda rs: [(rs[0][0], len(rs), sum(r[1] is None for r in rs), sum(r[2] or 0.0 for r in rs))], "g string, n int, nulls int, total double").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for g, n, v in rows:
        w = want.setdefault(g, [0, 0, 0.0])
        w[0] += 1
        w[1] += n is None
        w[2] += v or 0.0
    assert {r["g"]: [r["n"], r["nulls"], r["total"]] for r in got} == want
    assert fold_groups(df.where("false"), ["g"], ["n"], lambda rs: [], "g string").count() == 0
