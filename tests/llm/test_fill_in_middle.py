"""Fill-in-middle against plain splitting."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from helpers import documents, prose
from pyspark.sql import functions as F

from pairlake.llm import fill_in_middle as fim

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return doc_id, len(tokens), "plain", None, None, text, text
    low, high = sorted((a % (len(tokens) + 1), b % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if d % 100 < 20:
        return doc_id, len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def sample(rng):
    pool = [*"abcXYZ  \n.é中😀1<>|", "hello", "World "]
    shared = "".join(rng.choice(pool) for _ in range(9000))
    made = ["".join(rng.choice(pool) for _ in range(rng.randrange(3000))) + shared * (i % 3 == 0) for i in range(60)]
    made += [None, "", "a", "é", " ", "a" * 60_000, "é" * 40_000, "x<P>y", "<M>", "<S", "|", "\r\n\x00", prose(rng, 20_000)]
    return [(i, t) for i, t in enumerate(made)] + [(None, "some words here"), (-5, "again it"), (-5, "again it")]


def test_outputs_and_round_trip(spark):
    rows = sample(random.Random(6))
    made = fim.fill_in_middle(documents(spark, rows).repartition(3))
    made = made.withColumn("restored", fim.restore(F.col("output"), F.col("form")))
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(repr(brute(*r)) for r in rows)


def test_chunks_follow_content():
    rng = random.Random(8)
    shared = prose(rng, 5000).encode()
    cache = fim.ChunkCache()
    fim.Chunked(b"one beginning " + shared, cache)
    before = cache.summed
    other = fim.Chunked(b"quite another beginning, and longer " + shared, cache)
    assert len(other.ends) > 8 and cache.summed - before <= 3
    sizes = np.diff(np.concatenate([[0], other.ends]))
    assert sizes.max() <= fim.MOST and sizes[:-1].min() >= fim.LEAST


def test_equal_hashes_are_told_apart_by_content(monkeypatch):
    monkeypatch.setattr(fim.ChunkCache, "key", lambda self, chunk: 0)
    rng = random.Random(9)
    cache = fim.ChunkCache()
    for text in [prose(rng, 2000) for _ in range(4)] * 2:
        assert fim.Chunked(text.encode(), cache).n == len(TOKEN.findall(text))
    assert len(cache.known) == 1 and cache.summed == sum(map(len, cache.known.values()))


def test_forgotten_chunks_are_summed_again():
    text = prose(random.Random(3), 4000)
    cache = fim.ChunkCache(most=5000)
    for _ in range(3):
        chunked = fim.Chunked(text.encode(), cache)
        assert chunked.n == len(TOKEN.findall(text)) and cache.held <= 5000 + fim.MOST + 200


def test_empty_table_and_clashing_names(spark):
    made = fim.fill_in_middle(documents(spark, []))
    assert made.collect() == [] and made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    odd = documents(spark, [(1, "some text")]).withColumnsRenamed({"rank": "n", "vector": "output", "node": "_text"})
    assert fim.fill_in_middle(odd).first()["n"] == 3


def test_rates(spark):
    docs = documents(spark, [(i, "a few words") for i in range(400)])
    assert fim.fill_in_middle(docs, rate=0).filter("form <> 'plain'").count() == 0
    assert fim.fill_in_middle(docs, rate=100, suffix_first=100).filter("form <> 'spm'").count() == 0
