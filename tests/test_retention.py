"""Retention of bags, empty ones included."""

from trialframe.operators import trees


def test_bag_retention(spark):
    before = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z")], "tree int, kind string")
    after = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (3, "z")], "tree int, kind string")
    bags = spark.createDataFrame([(1,), (2,), (3,), (3,)], "tree int")
    got = {r.tree: r.retention for r in trees.bag_retention(before, after, ["tree"], "kind", bags).collect()}
    assert got == {1: 2 / 3, 2: 0.0, 3: 1.0}
    assert {r.tree for r in trees.bag_retention(before, after, ["tree"], "kind").collect()} == {1, 2}
