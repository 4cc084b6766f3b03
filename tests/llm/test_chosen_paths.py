from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
import pytest
from helpers import documents, prose
from pyspark.sql import functions as F

from pairlake.llm import chosen_paths
from pairlake.llm.chosen_paths import near_duplicates
from pairlake.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    group = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if a < b and sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                    low = min(group[a], group[b])
                    if group[a] != low or group[b] != low:
                        group[a] = group[b] = low
                        changed = True
    return sorted((i, len(sets[i]), group[i], group[i] == i) for i in ids)


def corpus(rng, n=120):
    rows, base = [], [prose(rng, rng.randrange(30, 120)) for _ in range(6)]
    for i in range(n):
        words = rng.choice(base).split() if rng.random() < 0.7 else prose(rng, 40).split()
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    return rows


EDGES = [(500, None), (501, ""), (502, " \t "), (503, "One two"), (504, "one  TWO"), (505, "one two three"), (506, "a\x0bb c d e"), (507, "a b c d e")]


@pytest.mark.parametrize("seed", range(2))
def test_components_are_exact(spark, seed):
    rows = corpus(random.Random(seed)) + EDGES
    got = sorted(map(tuple, near_duplicates(documents(spark, rows)).collect()))
    assert got == brute(rows)


def test_large_nodes_branch_and_blocks_meet(spark, monkeypatch):
    """With tiny nodes every group is branched to the end and compared block by block."""
    monkeypatch.setattr(chosen_paths, "SMALL", 4)
    monkeypatch.setattr(chosen_paths, "DEPTH", 3)
    rows = corpus(random.Random(9), 80)
    assert sorted(map(tuple, near_duplicates(documents(spark, rows)).collect())) == brute(rows)


def test_repeats_and_empty(spark):
    rows = corpus(random.Random(3), 30)
    again = documents(spark, rows + rows[:7] + [(None, "x y z")])
    assert sorted(map(tuple, near_duplicates(again).collect())) == brute(rows)
    assert near_duplicates(again.filter(F.lit(False))).collect() == []


def test_every_text_of_an_id_links(spark):
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(5, a), (5, b + " end"), (9, a + " more"), (3, b), (7, c), (7, c), (8, c + " x"), (6, d), (5, None)]
    got = {r["doc_id"]: (r["component_id"], r["kept"], r["n_shingles"]) for r in near_duplicates(documents(spark, rows)).collect()}
    assert {i: g[0] for i, g in got.items()} == {3: 3, 5: 3, 9: 3, 7: 7, 8: 7, 6: 6}
    assert got[5][1:] == (False, 57) and got[6] == (6, True, 56)


def test_tokens_that_nobody_shares_rule_pairs_out(monkeypatch):
    """Texts of one template: every pair may reach the threshold by signature, none does."""
    rng = np.random.default_rng(5)
    common = rng.integers(0, 2**63, 900).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, 100).astype(np.uint64)])) for _ in range(60)]
    near = np.unique(np.concatenate([sets[0][:-20], common[:1]]))
    sets.append(near)
    shared = chosen_paths.sharable(sets)
    for i, s in enumerate(sets):
        others = np.concatenate([t for j, t in enumerate(sets) if j != i])
        assert np.isin(s, others).sum() <= shared[i] <= len(s)
    counted = []
    monkeypatch.setattr(chosen_paths.np, "searchsorted", lambda a, v, f=np.searchsorted: counted.append(len(v)) or f(a, v))
    frame = pd.DataFrame(
        {"unit": 1, "block": 0, "set_id": range(61), "tokens": [s.tobytes() for s in sets],
         "signature": [m.tobytes() for m in chosen_paths.signatures(sets)]}
    )
    links = chosen_paths.do_link(40, 85)(frame)
    assert links.to_numpy().tolist() == [[0, 60]] and sum(counted) < 60 * 2000


def test_long_text(spark):
    rng = random.Random(4)
    text = prose(rng, 60_000)
    rows = [(1, text), (2, text + " tail"), (3, prose(rng, 60_000))]
    assert [r["component_id"] for r in sorted(near_duplicates(documents(spark, rows)).collect())] == [1, 1, 3]


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 500), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(201)} | {400: 400, 500: 400}
