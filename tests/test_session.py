import os

from pyspark.sql import functions as F

from quirefold import session as S


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, None, None)], "i bigint, t string, x array<double>")
    back = S.materialize(df, "t")
    assert back.schema == df.schema and sorted(r.i for r in back.collect()) == [1, 2]
    assert S.materialize(df.limit(0), "t").count() == 0


def test_shared_dir(spark):
    d = S.shared_dir(spark)
    assert os.path.isdir(d.replace("file://", "").replace("file:", ""))


def test_join_hot_both_ways(spark, monkeypatch):
    left = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "x"), (1, "y")], "k bigint, v string")
    want = sorted((r.k, r.id, r.v) for r in left.join(right, "k").collect())
    for limit in (S.BROADCAST_LIMIT, -1):
        monkeypatch.setattr(S, "BROADCAST_LIMIT", limit)
        assert sorted((r.k, r.id, r.v) for r in S.join_hot(left, right, ["k"], salt_from=["id"]).collect()) == want
        assert S.join_hot(left, right, ["k"], "left", ["id"]).count() == 100
        assert S.join_hot(left, right.select("k"), ["k"], "left_semi", ["id"]).count() == 67


def test_most_frequent(spark):
    df = spark.createDataFrame([("a", 9), ("b", 5), ("c", 5), ("d", 1)], "w string, n bigint")
    words = lambda k: sorted(r.w for r in S.most_frequent(df, "n", k).collect())
    assert words(4) == ["a", "b", "c", "d"] and words(3) == ["a", "b", "c"] and words(2) == ["a"] and words(1) == ["a"]
    assert S.most_frequent(df.filter("n = 5"), "n", 1).count() == 0 and S.most_frequent(df.limit(0), "n", 3).count() == 0
