"""Joins in which some keys are very frequent, against a plain join."""

import pytest

from termforest.operators.joins import spread_join


@pytest.mark.parametrize("hot_rows", [3, 100_000])
def test_spread_join_is_a_join(spark, hot_rows):
    rows = spark.createDataFrame([("a" if k % 3 else f"k{k % 7}", k) for k in range(300)] + [(None, 1), ("lone", 2)], "key string, v int")
    lookup = spark.createDataFrame([("a", "x"), ("a", "y"), ("k1", "z"), (None, "n"), ("unused", "u")], "key string, w string")
    got = sorted((r["key"], r["v"], r["w"]) for r in spread_join(rows, lookup, ["key"], ["v"], hot_rows).collect())
    assert got == sorted((r["key"], r["v"], r["w"]) for r in rows.join(lookup, "key").collect()) and len(got) > 400
    left = sorted((str(r["key"]), r["v"], str(r["w"])) for r in spread_join(rows, lookup, ["key"], ["v"], hot_rows, "left").collect())
    assert left == sorted((str(r["key"]), r["v"], str(r["w"])) for r in rows.join(lookup, "key", "left").collect())
    assert spread_join(rows.limit(0), lookup, ["key"], ["v"], hot_rows).count() == 0
