from __future__ import annotations

import random
import re
from fractions import Fraction

import pytest
from helpers import documents, prose
from pyspark.sql import functions as F

from pairlake.llm.mixing import mix, repeat, water_fill


def fill(sizes, weights, share, epochs):
    """Water-filling as told: clamp, deal the excess to the others by weight, repeat."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    total, clamped = Fraction(share) * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in clamped]
        if not open_:
            return clamped
        level = (total - sum(clamped.values())) / sum(w[s] for s in open_)
        above = [s for s in open_ if level * w[s] > epochs * sizes[s]]
        if not above:
            return clamped | {s: level * w[s] for s in open_}
        clamped |= {s: Fraction(epochs * sizes[s]) for s in above}


@pytest.mark.parametrize("seed", range(4))
def test_water_fill_is_the_iterated_clamping(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 50, 1000]) for i in range(9)} | {None: 40}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in water_fill(rows, (3, 1, 2), 1.5, 2).collect()}
    want = fill(sizes, (3, 1, 2), Fraction(3, 2), 2)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(float(want[s]))


def test_mix_meets_targets_and_limits(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(1, 80)), f"s{i % 4 if i % 3 else 0}") for i in range(300)]
    rows += [(900, None, "s1"), (901, "", None), (902, " \t\n", "s9"), (903, "a b", None), (903, "a b", None)]
    docs = documents(spark, rows)
    got = mix(docs, (3, 1, 2), 1.5, 2).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mix(docs, (3, 1, 2), 1.5, 2).collect()))
    largest, taken, target = {}, {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    for s in taken:
        assert abs(taken[s] - target[s]) <= largest[s]
    assert target["s9"] == 0
    repeated = repeat(docs, mix(docs, (3, 1, 2), 1.5, 2))
    assert repeated.columns == docs.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in repeated.collect())
    assert words == sum(taken.values())


def test_empty_table(spark):
    docs = documents(spark, [(1, "a", "s")]).filter(F.lit(False))
    assert mix(docs, (3, 1, 2), 1.5, 2).collect() == []


def test_repeated_rows_share_their_copies(spark):
    rows = [(1, "a b", "s"), (1, "c d", "s"), (1, "a b", "s"), (2, "e f", "s"), (2, "e f", "s"), (3, "g", "s")]
    rows += [(None, f"x{i}", None) for i in range(40)]
    docs = documents(spark, rows)
    told = [(1, "s", 2, n) for n in (1, 1, 2)] + [(2, "s", 2, 2)] * 2 + [(3, "s", 1, 2)]
    told += [(None, None, 1, int(i == 0)) for i in range(40)]
    mixed = spark.createDataFrame(told, "doc_id long, source string, size long, copies long")
    got = [r["doc_id"] for r in repeat(docs, mixed).collect()]
    assert {i: got.count(i) for i in set(got)} == {1: 4, 2: 4, 3: 2, None: 1}


def test_repeated_rows_meet_the_targets(spark):
    rows = [(i // 7, f"w{i} v", f"s{i % 3}") for i in range(210)]
    docs = documents(spark, rows)
    mixed = mix(docs, (3, 1, 2), 1.5, 2)
    taken = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    got = {r["source"]: 2 * r["count"] for r in repeat(docs, mixed).groupBy("source").count().collect()}
    assert got == taken
