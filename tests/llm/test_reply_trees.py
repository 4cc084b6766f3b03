from __future__ import annotations

import random

from pyspark.sql import functions as F

from pairlake.llm.reply_trees import format_chats, read_back, reply_paths

SCHEMA = "tree long, node long, parent long, role string, text string, score double"


def paths(spark, rows, best=1):
    got = {}
    for r in reply_paths(spark.createDataFrame(rows, SCHEMA), best).collect():
        got.setdefault((r["tree"], r["rank"]), {})[r["pos"]] = r["text"]
    return {k: [v[p] for p in sorted(v)] for k, v in got.items()}


def test_branches_are_ranked_by_score(spark):
    rows = [
        (1, 1, None, "user", "a", 0.0), (1, 2, 1, "assistant", "b", 1.0), (1, 3, 1, "assistant", "c", 2.0),
        (1, 4, 2, "user", "d", 5.0), (1, 5, 3, "user", "e", 1.0), (1, 6, 3, "user", "f", 1.0),
        (2, 9, 77, "user", "orphan", 0.0), (None, 1, None, "user", "null tree", None),
    ]
    assert paths(spark, rows, 2) == {
        (1, 1): ["a", "b", "d"], (1, 2): ["a", "c", "e"], (2, 1): ["orphan"], (None, 1): ["null tree"],
    }


def test_long_chain_cycles_and_repeats(spark):
    chain = [(1, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(300)]
    cycle = [(2, 1, 2, "u", "x", 1.0), (2, 2, 1, "u", "y", 1.0), (2, 3, 2, "u", "z", 1.0)]
    got = paths(spark, chain + chain[:5] + cycle + [(3, None, None, "u", "no node", 1.0)])
    assert got == {(1, 1): [str(i) for i in range(300)]}


def test_every_path_against_walking_up(spark):
    rng = random.Random(5)
    parent = {i: rng.choice([None, *range(i)]) if i else None for i in range(60)}
    rows = [(7, i, p, "u", str(i), rng.random()) for i, p in parent.items()]
    leaves = set(parent) - {p for p in parent.values() if p is not None}
    want = set()
    for leaf in leaves:
        line, at = [], leaf
        while at is not None:
            line.append(str(at))
            at = parent[at]
        want.add(tuple(line[::-1]))
    assert {tuple(v) for v in paths(spark, rows, 100).values()} == want


def test_format_is_reversible(spark):
    nasty = ["\\### Assistant: </turn> ok", "</turn>\n### user: x", "\\", "\\\\#", "", None, "<\\/turn>", "a:b %3A %25", "😀 ###", "x" * 30_000]
    rows = [(1, i, role, t) for i, (role, t) in enumerate((r, t) for t in nasty for r in ("assistant", "us:er%", None))]
    rows += [(1, 600, "assistant", "last")]
    chats = format_chats(spark.createDataFrame(rows, "conv long, pos long, role string, text string"), ["conv"])
    r = chats.withColumn("turns", read_back(F.col("formatted"))).first()
    assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in rows]
    for turn, span, row in zip(r["turns"], r["loss"], rows, strict=True):
        assert (span is not None) == (row[2] == "assistant")
        if span:
            assert turn["segment"][span["start"] : span["end"]].count("\n") == (row[3] or "").count("\n")
    assert format_chats(spark.createDataFrame([], "conv long, pos long, role string, text string"), ["conv"]).collect() == []
