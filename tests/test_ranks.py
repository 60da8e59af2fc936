"""Percentiles by splitters against sorted lists."""

import math
import random

import pytest

from skylattice.operators import ranks


def linear(values, q):
    v = sorted(values)
    at = q * (len(v) - 1)
    low, high = math.floor(at), math.ceil(at)
    return v[low] + (v[high] - v[low]) * (at - low)


def made(seed, n):
    rnd = random.Random(seed)
    kinds = [lambda: rnd.random(), lambda: rnd.choice([0.0, 0.5]), lambda: rnd.gauss(0, 1e6), lambda: 7.25]
    return [(k, None if rnd.random() < 0.1 else kinds[k % 4](), rnd.random() if k != 2 else None) for k in [rnd.randrange(6) for _ in range(n)]]


WANTED = {"low": ("a", 0.0), "p1": ("a", 0.01), "mid": ("a", 0.5), "p99": ("a", 0.99), "high": ("a", 1.0), "other": ("b", 0.5)}


@pytest.mark.parametrize("accuracy", [10, 10_000])
@pytest.mark.parametrize("most", [0, 50_000])
def test_by_key(spark, monkeypatch, accuracy, most):
    """Whatever the sketch is worth, and however its splitters travel."""
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    monkeypatch.setattr(ranks, "MOST_GROUPS", most)
    rows = [*made(1, 8000), (None, 4.0, 5.0), (None, None, 6.0), (9, None, None)]
    df = spark.createDataFrame(rows, "zone int, a double, b double").repartition(5)
    got = {r["zone"]: r for r in ranks.percentiles(df, WANTED, "zone").collect()}
    assert set(got) == {None, *range(6)}
    for zone, r in got.items():
        for name, (c, q) in WANTED.items():
            values = [x["ab".index(c) + 1] for x in rows if x[0] == zone and x["ab".index(c) + 1] is not None]
            assert r[name] is None if not values else r[name] == pytest.approx(linear(values, q), rel=1e-12, abs=1e-12), (zone, name)


def test_ratios_of_less_than_one(spark):
    rnd = random.Random(2)
    values = [rnd.random() for _ in range(40_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    r = ranks.percentiles(df, {"p10": ("v", 0.1), "p50": ("v", 0.5), "p9999": ("v", 0.9999)}).first()
    for name, q in (("p10", 0.1), ("p50", 0.5), ("p9999", 0.9999)):
        assert r[name] == pytest.approx(linear(values, q), rel=1e-12)


def test_empty_and_joined(spark):
    none = spark.createDataFrame([], "zone int, a double, b double")
    assert ranks.percentiles(none, WANTED).collect() == [] and ranks.percentiles(none, WANTED, "zone").collect() == []
    df = spark.createDataFrame([(1, 2.0, 1.0), (None, 3.0, 1.0), (2, None, 1.0)], "zone int, a double, b double")
    got = ranks.with_percentiles(df.groupBy("zone").count(), df, {"mid": ("a", 0.5)}, "zone")
    assert {r["zone"]: (r["count"], r["mid"]) for r in got.collect()} == {1: (1, 2.0), None: (1, 3.0), 2: (1, None)}
    whole = ranks.with_percentiles(df.selectExpr("count(*) as n"), df, {"mid": ("a", 0.5)})
    assert whole.columns == ["n", "mid"] and tuple(whole.first()) == (3, 2.5)
