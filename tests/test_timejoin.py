"""Joins in time against plain versions: a hot key, ties, nulls, intervals of all lengths, nothing."""

import random

from folioscan.operators import timejoin


def test_as_of_equals_plain(spark):
    r = random.Random(7)
    left = [(i, r.choice([1] * 5 + [2, 3, None]), r.choice([None, *[r.randint(-50, 400)] * 9])) for i in range(400)] + [(7, 1, 5), (7, 1, 5)]
    right = [(r.choice([1] * 5 + [2, None]), r.choice([None, *[r.randint(-80, 380)] * 9]), i, r.choice([None, "x", "y"])) for i in range(300)]
    a = spark.createDataFrame(left, "id long, k long, at long").repartition(3)
    b = spark.createDataFrame(right, "k long, since long, no long, value string").repartition(3)
    want = []
    for i, k, t in left:
        best = max(((s, n, v) for rk, s, n, v in right if None not in (k, t, s) and rk == k and s <= t), key=lambda x: x[:2], default=(None, None, None))
        want.append((i, k, t, best[1], best[2]))
    for width in (1, 16, 10_000):
        got = timejoin.as_of(a, b, "k", "at", "since", ["no", "value"], "no", width)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert timejoin.as_of(a.limit(0), b, "k", "at", "since", ["no"], "no", 16).count() == 0
    assert {x["no"] for x in timejoin.as_of(a, b.limit(0), "k", "at", "since", ["no"], "no", 16).collect()} == {None}


def test_overlaps_equal_plain(spark):
    r = random.Random(8)

    def side(n):
        return [(i, r.choice([1] * 4 + [2, None]), lo, lo + r.choice([-1, 0, 1, 3, 17, 200, 5000]) if r.random() < 0.95 else None) for i in range(n) for lo in [r.randint(-3000, 3000)]]

    left, right = side(200), side(150)
    a, b = spark.createDataFrame(left, "x long, k long, lo long, hi long"), spark.createDataFrame(right, "y long, k long, lo long, hi long")
    want = sorted((i, j) for i, k, lo, hi in left for j, m, low, high in right if None not in (k, hi, high) and k == m and lo <= hi and low <= high and lo <= high and low <= hi)
    got = timejoin.overlapping(a, b, "k", ("lo", "hi"), ("lo", "hi")).select("left.x", "right.y")
    assert sorted(map(tuple, got.collect())) == want and len(set(want)) == len(want)
    assert timejoin.overlapping(a.limit(0), b, "k", ("lo", "hi"), ("lo", "hi")).count() == 0
