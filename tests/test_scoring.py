import random

import pytest
from pyspark.sql import functions as F

from pairlake.functions.numbers import exact_round, percent
from pairlake.operators import release as G
from pairlake.operators import scoring as E


def test_rounding_agrees_with_python(spark):
    rnd = random.Random(4)
    xs = [0.03125, 0.5, 2.675, 0.82345, 1e-7, 0.0, -0.03125, -1.5, 12.35, 3.0, 1e18]
    xs += [k / n for n in range(1, 40) for k in range(n)] + [rnd.random() * 10**e for e in range(-3, 6) for _ in range(40)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    for digits in (1, 4, 6):
        got = {r["i"]: r["y"] for r in df.select("i", exact_round(F.col("x"), digits).alias("y")).collect()}
        assert got == {i: round(x, digits) for i, x in enumerate(xs)}
    shown = {r["i"]: r["y"] for r in df.filter("x between 0 and 1").select("i", percent(F.col("x")).alias("y")).collect()}
    assert shown == {i: f"{x:.1%}" for i, x in enumerate(xs) if 0 <= x <= 1}


def test_outcomes(spark):
    items = spark.createDataFrame(
        [("a", "easy", "SELECT x FROM u;"), ("b", "easy", "SELECT 2;"), ("c", "hard", "SELECT 3;"), ("d", "hard", "S;")],
        "id string, difficulty string, gold_sql string",
    )
    preds = spark.createDataFrame(
        [("a", "```sql\nselect x  from u\n```", 5.0, 3), ("b", "SELECT 9", 6.0, 4), ("c", "", 7.0, None)],
        "id string, sql string, latency_ms double, tokens_out bigint",
    )
    verdicts = spark.createDataFrame(
        [("a", True, True, None), ("b", False, None, "boom"), ("c", True, True, None)],
        "id string, ran boolean, matched boolean, error string",
    )
    got = {r["id"]: r for r in E.outcomes(items, preds, verdicts).collect()}
    flags = {i: (r["valid"], r["ex"], r["exact"], r["missing"]) for i, r in got.items()}
    assert flags == {
        "a": (True, True, True, False),
        "b": (False, False, False, False),
        "c": (False, False, False, False),
        "d": (False, False, False, True),
    }
    assert got["d"]["sql"] == "" and got["b"]["error"] == "boom"


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 200])
def test_latency_percentiles(spark, n):
    rnd = random.Random(n)
    xs = [rnd.randint(0, 4000) / 100 for _ in range(n)]
    df = spark.createDataFrame([("m", x) for x in xs] + [("m", None), ("none", None)], "model string, latency_ms double")
    got = E.latency_percentiles(df, ["model"]).collect()
    assert len(got) == 1
    s = sorted(xs)
    assert got[0]["latency_ms_p50"] == round(s[min(n - 1, int(0.5 * n))], 1)
    assert got[0]["latency_ms_p95"] == round(s[min(n - 1, int(0.95 * n))], 1)


def test_cost(spark):
    log = spark.createDataFrame([("m", 100, 50), ("m", None, 10), ("free", 5, 5)], "model string, tokens_in bigint, tokens_out bigint")
    prices = spark.createDataFrame([("m", 0.15, 0.6)], "model string, price_in double, price_out double")
    got = {r["model"]: r["cost_per_query_usd"] for r in E.cost_per_query(log, prices).collect()}
    assert got == {"m": round((100 * 0.15 + 60 * 0.6) / 1e6 / 2, 6), "free": 0.0}


def test_examples_must_be_right(spark):
    rows = spark.createDataFrame([("a", True, None), ("b", False, "other"), ("c", False, "other")], "id string, ex boolean, tag string")
    chosen = spark.createDataFrame([("a",)], "id string")
    assert E.pick_examples(chosen, rows).count() == 1
    with pytest.raises(ValueError, match="not answered correctly"):
        E.pick_examples(chosen.union(spark.createDataFrame([("b",)], "id string")), rows)
    assert [r["id"] for r in E.first_failures(rows).collect()] == ["b"]


def test_unstable_gold(spark):
    df = spark.createDataFrame([(True, False), (False, True), (False, False)], "ok boolean, tied boolean")
    got = [r[0] for r in df.select(E.stable_verdict(F.col("ok"), F.col("tied"))).collect()]
    assert got == ["ok", "reran", "stale"]


def cascade(spark, rows):
    return spark.createDataFrame(rows, "reason string, local_ex boolean, big_ex boolean, big_cost double")


def test_cascade_summary(spark):
    rows = cascade(
        spark,
        [
            (None, True, False, 3e-4), (None, False, True, 3e-4), (None, True, True, 3e-4),
            ("disagree", True, False, 3e-4), ("disagree", False, True, 3e-4),
            ("error", False, True, 3e-4), ("error", False, False, 3e-4), ("empty", False, True, 6e-4),
        ],
    )
    got = {r["rule"]: r for r in G.cascade_summary(rows).collect()}
    valid, agree = got["valid"], got["agree"]
    assert (valid["answered_locally"], valid["local_precision"], valid["ex"]) == (0.625, 0.6, 0.625)
    assert (valid["api_calls_per_100"], valid["cost_per_query_usd"]) == (37.5, 0.00015)
    assert (valid["escalated_error"], valid["escalated_empty"], valid["escalated_disagree"]) == (2, 1, 0)
    assert (agree["answered_locally"], agree["local_precision"], agree["ex"]) == (0.375, 0.6667, 0.625)
    assert (agree["escalated_error"], agree["escalated_empty"], agree["escalated_disagree"]) == (2, 1, 2)
    assert (agree["local_ex"], agree["big_ex"], agree["n"]) == (0.375, 0.625, 8)
    nothing_local = G.cascade_summary(cascade(spark, [("error", True, True, 0.0)])).first()
    assert nothing_local["local_precision"] is None


def test_escalation_reasons(spark):
    rows = [
        (False, False, True, True), (True, True, True, True), (True, False, True, False),
        (True, False, False, None), (True, False, None, None), (True, False, True, True),
    ]
    df = spark.createDataFrame(rows, "r boolean, n boolean, sr boolean, sm boolean")
    got = [x[0] for x in df.select(G.escalation_reason(*[F.col(c) for c in ("r", "n", "sr", "sm")])).collect()]
    assert got == ["error", "empty", "disagree", "disagree", "disagree", None]


def test_retry_choice(spark):
    rows = [
        ("a", None, "b", None), ("a", "bad", "b", None), ("a", "bad", "b", "bad2"), ("", None, "b", "bad2"), ("a", "bad", None, "empty"),
    ]
    df = spark.createDataFrame(rows, "sql string, problem string, sql2 string, problem2 string")
    got = [(r["retried"], r["chosen_sql"], r["chosen_problem"]) for r in G.retry_choice(df).collect()]
    assert got == [(False, "a", None), (True, "b", None), (True, "a", "bad"), (True, "b", "bad2"), (True, "a", "bad")]


RESULT = "model string, runtime string, `set` string, ex double, missing bigint"


def gate_world(rnd):
    """Random families, scores and previous releases for the gate."""
    runtimes = rnd.sample(["phone", "tablet", "desk", "rack"], rnd.randint(1, 4))
    families = [f"fam{i}" for i in range(rnd.randint(1, 3))]
    registry = [(f, None, None) for f in families]
    registry += [(f"{f}-small", f, None) for f in families if rnd.random() < 0.7]
    tuned = [(f"{f}-tuned{k}", f, f"r{k}") for f in families for k in range(rnd.randint(1, 2))]
    grid = [k / 20 for k in range(4, 17)]
    scores = [
        (model, runtime, rnd.choice(["fresh", "fresh", "stale"]), rnd.choice(grid), rnd.choice([0, 0, 0, 4]))
        for model, _, _ in registry + tuned
        for runtime in runtimes
        if rnd.random() < 0.85
    ]
    previous = {r: rnd.choice(grid) for r in runtimes if rnd.random() < 0.5}
    wanted = [(model, r) for model, _, _ in tuned for r in runtimes]
    return registry + tuned, scores, previous, wanted


def floors_of(registry, scores):
    """The best score of any untuned member of a family, per runtime, on the gate's set."""
    family = {m: base or m for m, base, run in registry if run is None}
    best = {}
    for model, runtime, name, ex, _ in scores:
        if name == "fresh" and model in family:
            key = (family[model], runtime)
            best[key] = max(best.get(key, 0.0), ex)
    return best


def judge(registry, scores, previous, wanted):
    """The gate's rules, one line per wanted (model, runtime): ok, or the reasons against."""
    base = {m: b for m, b, _ in registry}
    floors = floors_of(registry, scores)
    got = {(m, r): (ex, missing) for m, r, name, ex, missing in scores if name == "fresh"}
    lines = {}
    for model, runtime in wanted:
        ex, missing = got.get((model, runtime), (None, 0))
        floor = floors.get((base[model], runtime))
        if ex is None or missing:
            lines[model, runtime] = ["no complete fresh predictions"]
        elif floor is None:
            lines[model, runtime] = [f"no fresh result for {base[model]} here"]
        else:
            bars = [("base", floor), ("previous release", previous.get(runtime))]
            lines[model, runtime] = [name for name, bar in bars if bar is not None and ex < bar]
    return lines


@pytest.mark.parametrize("seed", range(8))
def test_gate_follows_its_rules(spark, seed):
    registry, scores, previous, wanted = gate_world(random.Random(seed))
    frames = (
        spark.createDataFrame(wanted, "model string, runtime string"),
        spark.createDataFrame(scores, RESULT),
        spark.createDataFrame(registry, "model string, base string, run_id string"),
        spark.createDataFrame(list(previous.items()), "runtime string, prev_ex double"),
    )
    got = G.release_gate(*frames, "fresh").collect()
    want = judge(registry, scores, previous, wanted)
    assert {(r["model"], r["runtime"]): r["ok"] for r in got} == {k: not v for k, v in want.items()}
    for r in got:
        reasons = want[r["model"], r["runtime"]]
        assert all(reason in r["message"] for reason in reasons)
        assert r["message"].endswith("ok") == (not reasons)
        assert r["passed"] == all(not v for (m, _), v in want.items() if m == r["model"])
    floors = G.base_floor(frames[1], frames[2], "fresh").collect()
    assert {(r["base"], r["runtime"]): r["floor"] for r in floors} == floors_of(registry, scores)


def test_regression_check(spark):
    fresh = spark.createDataFrame(
        [("m", "cpu", "s", 0.48, 0), ("m", "gpu", "s", 0.47, 0), ("m", "new", "s", 0.9, 0), ("m", "part", "s", 0.5, 2)], RESULT
    )
    want = spark.createDataFrame([("m", r, "s", 0.5) for r in ("cpu", "gpu", "part")], "model string, runtime string, `set` string, want double")
    got = {r["runtime"]: r["ok"] for r in G.regression_check(fresh, want).collect()}
    assert got == {"cpu": True, "gpu": False, "new": False, "part": False}


def test_parity_and_baseline(spark):
    rows = spark.createDataFrame(
        [(" a", "a ", True, True, True), ("a", "b", False, False, None), ("a", "b", True, False, None), ("a", "b", True, True, False)],
        "ref_sql string, cand_sql string, ref_ran boolean, cand_ran boolean, matched boolean",
    )
    got = G.parity(rows, min_match=2).first()
    assert (got["n"], got["same_output"], got["same_result"], got["passed"]) == (4, 1, 2, False)
    rows = [("m", "phone", "day", 0.25, 0), ("m", "rack", "day", 0.75, 0), ("m", "rack", "night", 0.5, 0), ("n", "rack", "day", 1.0, 0)]
    record = G.baseline_record(spark.createDataFrame(rows, RESULT), "m", ["day", "night"])
    assert {r["set"]: r["ex"] for r in record.collect()} == {"day": {"phone": 0.25, "rack": 0.75}, "night": {"rack": 0.5}}
