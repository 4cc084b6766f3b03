import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlake.operators import positions as P


def rows(spark):
    rnd = random.Random(2)
    # Group "hot" holds most rows; one group is NULL.
    groups = ["hot"] * 60 + ["x", "y", None]
    data = [(rnd.choice(groups), rnd.randint(0, 5), i) for i in range(1500)]
    return data, spark.createDataFrame(data, "g string, v int, id int").repartition(5)


def grouped(data):
    out = {}
    for g, v, i in sorted(data, key=lambda r: (r[1], r[2])):
        out.setdefault(g, []).append((g, v, i))
    return out


def test_positions_and_running_totals(spark):
    data, df = rows(spark)
    want = {r[2]: p for rs in grouped(data).values() for p, r in enumerate(rs, 1)}
    got = P.with_positions(df, ["g"], ["v", "id"])
    assert {r["id"]: r["pos"] for r in got.collect()} == want
    totals = {}
    for rs in grouped(data).values():
        s = 0
        for _, v, i in rs:
            s += v
            totals[i] = s
    got = P.with_running_total(df, ["g"], ["v", "id"], "v")
    assert {r["id"]: r["running"] for r in got.collect()} == totals


def test_positions_without_groups(spark):
    df = spark.range(0, 1000, 1, 7)
    got = P.with_positions(df, [], [F.desc("id")])
    assert {r["id"]: r["pos"] for r in got.collect()} == {i: 1000 - i for i in range(1000)}


def test_rank_and_previous(spark):
    data, df = rows(spark)
    data = [r for r in data if r[0] is not None]
    df = df.filter("g is not null")
    want, before = {}, {}
    for rs in grouped(data).values():
        for p, (_, v, i) in enumerate(rs):
            want[i] = 1 + sum(w < v for _, w, _ in rs)
            before[i] = rs[p - 1][2] if p else None
    got = P.with_rank(df, ["g"], "v", ["v", "id"], "r")
    assert {r["id"]: r["r"] for r in got.collect()} == want
    got = P.with_previous(df, ["g"], ["v", "id"], "id", "before")
    assert {r["id"]: r["before"] for r in got.collect()} == before


@pytest.mark.parametrize("batch", [3, 10_000])
def test_rank_and_previous_go_on_over_tasks(spark, batch):
    """Groups and ties that span tasks, NULL and NaN among them, against windows."""
    rnd = random.Random(batch)
    values = [None, float("nan"), 1.0, 2.0, 2.0, 2.0, 3.0]
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice(values), i) for i in range(400)]
    rows += [("a", 2.0, 1000 + i) for i in range(300)] + [(f"g{i}", 1.0, 2000 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, v double, id int").repartition(5)
    window = Window.partitionBy("g").orderBy("v", "id")
    want = df.select("id", F.rank().over(Window.partitionBy("g").orderBy("v")).alias("r"), F.lag("v").over(window).alias("p"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.set("spark.sql.shuffle.partitions", 13)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        ranked = P.with_rank(df, ["g"], "v", ["v", "id"], "r").select("id", "r").collect()
        previous = P.with_previous(df, ["g"], ["v", "id"], "v", "p").select("id", "p").collect()
        alone = P.with_previous(df, [], ["id"], "id", "p").select("id", "p").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    assert {r["id"]: r["r"] for r in ranked} == {r["id"]: r["r"] for r in want.collect()}
    assert {r["id"]: str(r["p"]) for r in previous} == {r["id"]: str(r["p"]) for r in want.collect()}
    ids = sorted(r[2] for r in rows)
    assert dict(map(tuple, alone)) == dict(zip(ids, [None, *ids[:-1]], strict=True))


def test_rank_and_previous_of_nothing(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert P.with_rank(none, ["g"], "v", ["v"]).collect() == P.with_previous(none, ["g"], ["v"], "v", "p").collect() == []


def test_first_per_group(spark):
    data, df = rows(spark)
    for n in (3, 1200):
        got = {r["id"] for r in P.first_per_group(df, ["g"], ["v", "id"], n).collect()}
        assert got == {r[2] for rs in grouped(data).values() for r in rs[:n]}


def test_rows_are_cut_before_they_move(spark, monkeypatch):
    _, df = rows(spark)
    few = P.first_per_group(df, ["g"], ["v", "id"], 3)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    monkeypatch.setattr(P, "GROUP_LIMIT", 2)
    many = P.first_per_group(df, ["g"], ["v", "id"], 3)
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))


def test_copies_get_their_own_positions(spark):
    rnd = random.Random(8)
    data = [("hot", 5)] * 700 + [(rnd.choice("xyz"), rnd.randint(0, 9)) for _ in range(300)]
    df = spark.createDataFrame(data, "g string, v int").repartition(6)
    got = P.with_copy_positions(df, ["g"], ["v"], chunk=64).collect()
    want = {}
    for g, v in sorted(data):
        want.setdefault(g, []).append(v)
    assert sorted((r["g"], r["pos"], r["v"]) for r in got) == sorted(
        (g, p, v) for g, vs in want.items() for p, v in enumerate(vs, 1)
    )
