"""Registered queries against their SQL counterparts on the smallest sample."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pairlake.llm.queries import ORACLES, QUERIES

SAMPLE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SAMPLE}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    expected = sorted(tuple(r[i] for i in order) for r in want.fetchall())
    got = QUERIES[name](spark, SAMPLE)
    assert sorted(got.columns) == columns
    found = sorted(tuple(r) for r in got.select(*columns).collect())
    assert len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        assert a == tuple(pytest.approx(x) if isinstance(x, float) else x for x in b)


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SAMPLE}/documents.parquet").collect()]


def test_repeated_bytes_query(spark):
    from test_repeated_bytes import brute

    want = {
        (i, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
        for i, n, spans, kept in brute(documents(spark))
    }
    assert set(map(tuple, QUERIES["op1_repeated_bytes"](spark, SAMPLE).collect())) == want
    assert any(removed for _, _, removed, _, _ in want)


def test_token_count_query(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in documents(spark):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.add((i, len((t or "").encode()), n, n > 2048))
    assert set(map(tuple, QUERIES["op10_token_counts"](spark, SAMPLE).collect())) == want


def test_sampled_pieces_query(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = {i: model.decode(model.encode(t or "")) for i, t in documents(spark)}
    rows = QUERIES["op3_sampled_pieces"](spark, SAMPLE).collect()
    assert {r["doc_id"] for r in rows} == set(plain) and len(rows) <= 2 * len(plain)
    ranks = {}
    for r in rows:
        assert r["text_sha256"] == hashlib.sha256(plain[r["doc_id"]].encode()).hexdigest()
        ranks.setdefault(r["doc_id"], []).append((r["rank"], r["ids_hash"]))
    for told in ranks.values():
        assert sorted(k for k, _ in told) == list(range(1, len(told) + 1)) and len({h for _, h in told}) == len(told)


def test_nearest_neighbours_query(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SAMPLE}/embeddings.parquet").collect()}
    ids = sorted(i for i, v in rows.items() if v and any(v))
    m = np.array([rows[i] for i in ids], np.float64)
    m /= np.sqrt((m**2).sum(axis=1, keepdims=True))
    got = {}
    for r in QUERIES["op5_nearest_neighbours"](spark, SAMPLE).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        sims = m @ m[ids.index(q)]
        sims[ids.index(q)] = -2
        assert [k for k, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(sims[ids.index(i)], abs=1e-9) for _, i, s in found)
        hits += sum(s >= np.sort(sims)[-5] - 1e-12 for _, _, s in found)
    assert hits >= 0.9 * 5 * len(got)


def test_toxicity_query(spark):
    rows = QUERIES["op9_toxicity"](spark, SAMPLE).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in documents(spark))
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
