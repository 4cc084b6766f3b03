"""Order statistics against sorted lists."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pairlake.operators import quantiles as Q

TARGETS = {
    "p50": (0.5, lambda n: F.floor((n - 1) / 2)),
    "p95": (0.95, lambda n: F.floor(F.lit(0.95) * (n - 1))),
    "last": (1.0, lambda n: n - 1),
}


def places(n):
    return (n - 1) // 2, int(0.95 * (n - 1)), n - 1


@pytest.mark.parametrize("whole", [50_000, 0])
def test_order_statistics(spark, monkeypatch, whole):
    """Wide groups, ties, one value for most rows; with and without narrowing."""
    monkeypatch.setattr(Q, "WHOLE", whole)
    rnd = random.Random(1)
    groups = {
        "wide": [rnd.lognormvariate(0, 40) for _ in range(3000)],
        "ties": [float(rnd.randrange(4)) for _ in range(3000)],
        "hot": [7.0] * 2900 + [rnd.random() for _ in range(100)],
        "signs": [rnd.choice([-1, 1]) * rnd.random() for _ in range(500)] + [float("inf"), -float("inf")],
        "one": [3.5],
        "two": [2.0, 1.0],
        None: [1.0, 2.0, 3.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("two", None), ("none", None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: (r["n"], (r["p50"], r["p95"], r["last"])) for r in Q.order_statistics(df, ["g"], "v", TARGETS).collect()}
    want = {g: (len(vs), tuple(sorted(vs)[i] for i in places(len(vs)))) for g, vs in groups.items()}
    assert got == want


def test_a_missed_place_is_found_all_the_same(spark, monkeypatch):
    """Margins and accuracy so small that the sketch's range misses the place."""
    monkeypatch.setattr(Q, "WHOLE", 0)
    monkeypatch.setattr(Q, "MARGIN", 0.0)
    monkeypatch.setattr(Q, "ACCURACY", 2)
    values = list(range(2**62, 2**62 + 999)) + [0]
    random.Random(2).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = Q.order_statistics(df, [], "v", TARGETS).first()
    assert (got["p50"], got["p95"], got["last"]) == tuple(sorted(values)[i] for i in places(1000))


def test_nan_and_nothing(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", 0.0)], "g string, v double")
    got = Q.order_statistics(df, ["g"], "v", TARGETS).first()
    assert got["p50"] == 1.0 and str(got["last"]) == "nan"
    assert Q.order_statistics(df.limit(0), ["g"], "v", TARGETS).collect() == []


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_percentile(spark, q):
    rnd = random.Random(3)
    df = spark.createDataFrame([(rnd.choice("ab"), rnd.random()) for _ in range(301)], "g string, v double")
    want = {r["g"]: r["p"] for r in df.groupBy("g").agg(F.percentile("v", q).alias("p")).collect()}
    got = {r["g"]: r["p"] for r in Q.percentile(df, ["g"], "v", q, "p").collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
