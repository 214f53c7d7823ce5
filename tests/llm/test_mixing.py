import math
import random

import pytest

from quirefold.llm.mixing import balance, solve


def run(spark, docs, targets):
    d = spark.createDataFrame(docs, "id int, source string, n_tokens bigint")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    given, report = balance(d, "id", t)
    return {r["id"]: r for r in given.collect()}, {r["source"]: r for r in report.collect()}


def test_shares_and_caps(spark):
    rng = random.Random(2)
    docs = [(i, s, rng.randrange(20, 400)) for i, s in enumerate(rng.choices([" Big ", "big", "mid", "small"], [50, 20, 25, 5], k=3000))]
    docs += [docs[0], (5001, None, 10), (5002, "other", 10), (5003, "big", 0), (5004, "big", None), (None, "big", 5)]
    given, report = run(spark, docs, [("BIG", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("absent", 0.05, 3)])
    assert report["absent"]["actual_share"] == 0
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert report[s]["actual_share"] == pytest.approx(share / 0.95, abs=0.004)
        assert report[s]["most_copies"] <= report[s]["max_repeats"]
    assert not {5001, 5002, 5003, 5004} & set(given)
    by = {}
    for r in given.values():
        by[r["source"]] = by.get(r["source"], 0) + r["n_tokens"] * r["copies"]
        assert abs(r["copies"] - r["rate"]) < 1
    assert all(by[s] == report[s]["tokens_used"] for s in by)


def test_tilt_solves_the_dual(spark):
    sizes = [("a", t, n) for t, n in ((10, 50), (100, 20), (1000, 3))]
    df = spark.createDataFrame(sizes, "source string, n_tokens bigint, n bigint")
    for wanted in (500.0, 5000.0, 9000.0):
        a = solve(df, {"a": wanted}, {"a": 3}, 100.0)["a"]
        assert sum(n * t * min(3.0, math.exp(a * t / 100)) for _, t, n in sizes) == pytest.approx(wanted, rel=1e-6)


def test_empty(spark):
    given, report = run(spark, [], [("a", 1.0, 2)])
    assert given == {} and report["a"]["tokens_used"] == 0
    assert run(spark, [(1, "a", 5)], [])[1] == {}


def test_scarce_source_limits_the_mix(spark):
    docs = [(i, "a", 100) for i in range(100)] + [(1000, "b", 100)]
    given, report = run(spark, docs, [("a", 0.5, 1), ("b", 0.5, 3)])
    assert report["b"]["most_copies"] == 3 and report["a"]["tokens_used"] == pytest.approx(300, abs=100)
