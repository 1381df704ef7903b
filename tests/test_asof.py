"""The as-of join against a plain version: long keys over many tasks, ties, nulls and empty sides."""

import random

from tidemark.functions.asof import asof_join

LEFT, RIGHT = "k string, t long, tag string", "k string, t long, v double"


def plain(left, right):
    def last(k, t):
        found = max(((rt, v) for rk, rt, v in right if rk == k and rt is not None and t is not None and rt <= t and k is not None), default=None)
        return found and found[1]

    return sorted(((k, t, tag, last(k, t)) for k, t, tag in left), key=str)


def found(spark, left, right):
    made = asof_join(spark.createDataFrame(left, LEFT).repartition(3), spark.createDataFrame(right, RIGHT).repartition(2), "k", "t", "v")
    return sorted((tuple(r) for r in made.select("k", "t", "tag", "v").collect()), key=str)


def test_against_the_plain_version(spark):
    rng = random.Random(2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for keys in ("a", "abc"):
            left = [(rng.choice(keys), rng.randrange(300), str(i % 5)) for i in range(600)] + [(None, 1, "x"), ("a", None, "y"), ("zz", 5, "z")]
            right = [(rng.choice(keys), rng.randrange(20, 40), float(rng.randrange(9))) for _ in range(30)] + [(None, 1, 1.0), ("a", None, 2.0)]
            left += left[:50]
            assert found(spark, left, right) == plain(left, right)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_sides(spark):
    assert found(spark, [], [("a", 1, 1.0)]) == [] and found(spark, [("a", 1, "x")], []) == [("a", 1, "x", None)]
