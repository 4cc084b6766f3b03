from __future__ import annotations

import math
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from helpers import documents
from pyspark.sql import functions as F

from pairlake.llm import segmentations
from pairlake.llm.segmentations import Lookup, Vocabulary, decode, encode_samples, sample_batch

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    (1, "Hello  world\n\tfoo ﬁ Ⅳ   x"), (2, None), (3, ""), (4, " "), (5, "   lead and trail   "),
    (6, "a▁b ▁▁ literal"), (7, "😀😀 é \x00 �"), (8, "x"), (9, "<s> </s> <0x41> <unk>"),
    (10, "word " * 3000), (11, "y" * 5000), (8, "x"), (None, "no key"),
]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(MODEL, 0.4)


def every(m, node, stop):
    if node == stop:
        yield (), 0.0
        return
    for edge in range(m.first[node], m.first[node + 1]):
        for rest, p in every(m, m.end[edge], stop):
            yield (edge, *rest), p + m.log_p[edge]


def test_samples_follow_the_distribution_without_replacement(vocabulary):
    n = 8000
    m, searches = sample_batch(vocabulary, np.arange(n), ["then"] * n, 3)
    listed = dict(every(m, 0, m.node[1]))
    total = math.log(sum(map(math.exp, listed.values())))
    p = {s: math.exp(x - total) for s, x in listed.items()}
    drawn = Counter(tuple(tuple(x.edges.tolist()) for x in s.paths) for s in searches)
    assert all(len(set(d)) == 3 for d in drawn)
    likely = sorted(p, key=p.get)[-4:]
    for a, b, c in permutations(likely, 3):
        want = p[a] * p[b] / (1 - p[a]) * p[c] / (1 - p[a] - p[b])
        assert abs(drawn[a, b, c] / n - want) < 5 * math.sqrt(want / n) + 1e-3
    for s in searches[:200]:
        values = [x.perturbed for x in s.paths]
        assert values == sorted(values, reverse=True) and s.best()[0] <= values[-1]
        for x in s.paths:
            assert x.log_prob == pytest.approx(listed[tuple(x.edges.tolist())] - total)


def test_inclusion_scores_estimate_without_bias(vocabulary):
    """Sums weighted by 1 / inclusion come out right: the mass of everything is 1."""
    m, searches = sample_batch(vocabulary, np.arange(6000), ["then"] * 6000, 2)
    sums = []
    for s in searches:
        kappa = s.best()[0]
        sums.append(sum(math.exp(x.log_prob) / -math.expm1(-math.exp(x.log_prob - kappa)) for x in s.paths))
    assert np.mean(sums) == pytest.approx(1.0, abs=0.03)


def test_words_share_lattices_but_not_noise(vocabulary):
    m, searches = sample_batch(vocabulary, np.array([1, 2]), ["then then then", "then"], 4)
    assert len(m.node) - 1 == 1
    assert {len(s.paths) for s in searches} == {4}


def test_round_trip_and_edges(spark):
    docs = documents(spark, TEXTS)
    sampled = encode_samples(docs, MODEL, k=4, sharpness=0.5)
    rows = decode(sampled.withColumn("kept", F.col("ids")), MODEL).collect()
    want = {i: t or "" for i, t in TEXTS}
    by_id = {}
    for r in rows:
        assert r["text"] == want[r["doc_id"]]
        by_id.setdefault(r["doc_id"], []).append((r["rank"], tuple(r["kept"]), r["log_inclusion"]))
    assert by_id[2] == by_id[3] == [(1, (), 0.0)]
    for i, found in by_id.items():
        distinct = {ids for _, ids, _ in found}
        assert len(found) == len(distinct) * (2 if i == 8 else 1)
        assert all(x <= 0 for _, _, x in found)
    assert len(by_id[10]) == 4
    again = decode(encode_samples(docs.repartition(7), MODEL, k=4, sharpness=0.5), MODEL).drop("text")
    assert sorted(map(str, again.collect())) == sorted(map(str, sampled.drop("ids").collect()))
    assert encode_samples(docs.filter(F.lit(False)), MODEL).collect() == []


def test_lookup_finds_every_key_and_no_other():
    rnd = np.random.default_rng(3)
    for size in (1, 2, 50, 5000):
        keys = np.unique(np.append(rnd.integers(0, 2**64, size, np.uint64), np.uint64(2**64 - 1)))
        if size == 50:
            keys = keys >> np.uint64(40)  # all of them share one slot
        values = rnd.permutation(len(keys)).astype(np.int32)
        asked = np.concatenate([keys[::2], rnd.integers(0, 2**64, 3000, np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        known = dict(zip(keys.tolist(), values.tolist()))
        places, found = Lookup(keys[::-1], values[::-1]).find(asked)
        assert places.tolist() == [i for i, a in enumerate(asked.tolist()) if a in known]
        assert found.tolist() == [known[a] for a in asked[places].tolist()]


def test_noise_is_drawn_for_all_texts_of_a_batch_at_once(vocabulary, monkeypatch):
    calls = []
    for name in ("uniform", "_truncated", "noise_keys"):
        def counted(*args, f=getattr(segmentations, name)):
            calls.append(name)
            return f(*args)

        monkeypatch.setattr(segmentations, name, counted)
    made = []
    for n in (5, 500):
        calls.clear()
        _, searches = sample_batch(vocabulary, np.arange(n), ["some words then"] * n, 2)
        assert all(len(s.paths) == 2 for s in searches)
        made.append(len(calls))
    assert made[1] <= made[0] + 10


def test_subtrees_left_without_noise_cannot_win(vocabulary, monkeypatch):
    texts = ["then", "word " * 800, "y" * 3000, "😀" * 800 + " then and then", "😀" * 50, "", "a b c " * 300]
    keys = np.arange(len(texts))

    def found():
        m, searches = sample_batch(vocabulary, keys, texts, 4)
        paths = [[(p.edges.tolist(), p.log_prob, p.perturbed) for p in s.paths] for s in searches]
        return paths, [s.best() for s in searches], sum(len(p.value) for s in searches for p in s.paths)

    paths, best, few = found()
    monkeypatch.setattr(segmentations, "FAR", 1e12)
    every_path, every_best, many = found()
    assert (paths, best) == (every_path, every_best) and few < many


def test_lattices_hold_every_way_to_write_a_word(vocabulary):
    texts = ["then a  then", "😀x", "", "an then"]
    m = segmentations.Lattices(vocabulary, [segmentations._codes(t) if t else np.zeros(0, np.uint32) for t in texts])
    pieces = {b.decode(): i for i, b in enumerate(vocabulary.bytes_of) if b and i not in vocabulary.byte_ids}
    for word in range(len(m.word_of)):
        text = "".join(f" {t}" for t in texts if t)[m.word_begin[word] : m.word_end[word]]
        node = m.node[m.word_of[word]]
        for at in range(len(text)):
            edges = np.arange(m.first[node], m.first[node + 1])
            held = {(int(m.length[e]), tuple(m.ids(np.array([e]))[1].tolist())) for e in edges}
            begun = [text[at:end] for end in range(at + 1, len(text) + 1)]
            want = {(len(b), (pieces[b],)) for b in begun if b in pieces}
            if text[at] not in pieces:
                want.add((1, tuple(vocabulary.byte_ids[list(text[at].encode())].tolist())))
            assert held == want
            assert np.exp(m.log_chance[edges]).sum() == pytest.approx(1.0)
            node = m.next[node]
        assert node == m.node[-1]
