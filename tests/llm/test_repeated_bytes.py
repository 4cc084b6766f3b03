from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import documents, prose
from pyspark.sql import functions as F

from pairlake.llm import repeated_bytes
from pairlake.llm.repeated_bytes import COVER, MODULUS, pack_keys, remove_repeats, unpack_keys


def brute(rows, length=50):
    first, out = {}, []
    rows = [(i, (t or "").encode()) for i, t in rows]
    for i, b in rows:
        if i is not None:
            for p in range(len(b) - length + 1):
                key = b[p : p + length]
                first[key] = min(first.get(key, i), i)
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        if i is not None:
            for p in range(len(b) - length + 1):
                if first[b[p : p + length]] < i:
                    gone[p : p + length] = True
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0, append=0)).reshape(-1, 2)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), [tuple(e) for e in edges.tolist()], kept))
    return sorted(out, key=str)


def run(spark, rows, **sizes):
    got = remove_repeats(documents(spark, rows), **sizes).collect()
    return sorted(((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in got), key=str)


def corpus(seed):
    rng = random.Random(seed)
    passages = [prose(rng, 12) for _ in range(4)] + ["é" * 40, "ab" * 60]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(3, 25))]
        parts += [rng.choice(passages) for _ in range(rng.randrange(3))]
        rng.shuffle(parts)
        rows.append((rng.randrange(1000) * 100 + i, "".join(parts)))
    rows += [(rows[0][0] + 7, rows[3][1]), (1, rows[4][1]), (999999, "é" * 60 + passages[1][:49]), (999998, passages[0][:50])]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "short"), (10**6 + 3, "short")]
    rows += [rows[5], (rows[6][0], rows[5][1]), (None, passages[0]), (None, None)]
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 700, "bucket_keys": 300}])
def test_against_brute_force(spark, seed, sizes):
    rows = corpus(seed)
    assert run(spark, rows, **sizes) == brute(rows)


def test_with_second_keys(spark, monkeypatch):
    """The wide keys of a very large corpus, on a small one."""
    monkeypatch.setattr(repeated_bytes, "key_bits", lambda total: (64, 40))
    rows = corpus(7)
    assert run(spark, rows, chunk_bytes=700, bucket_keys=300) == brute(rows)


def test_long_copies_and_empty(spark):
    rng = random.Random(8)
    text = prose(rng, 20_000)
    rows = [(5, text), (6, "x" + text), (7, text[: len(text) // 2]), (8, "y" * 5000)]
    assert run(spark, rows, chunk_bytes=50_000) == brute(rows)
    assert remove_repeats(documents(spark, rows).filter(F.lit(False))).collect() == []


def test_cover_and_keys():
    assert {(a - b) % MODULUS for a in COVER for b in COVER} == set(range(MODULUS))
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    for part in (keys, keys[:1], keys[:0], np.array([0, 1, 2**64 - 1], np.uint64)):
        assert (unpack_keys(pack_keys(part), len(part)) == part).all() if len(part) else True
