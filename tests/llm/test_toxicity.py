from __future__ import annotations

import random
import zlib

from helpers import documents, prose
from pyspark.sql import functions as F

from pairlake.llm.toxicity import FEATURES, Features, score_toxicity


def corpus(n=1200):
    rng, rows, labels = random.Random(2), [], []
    for i in range(n):
        text, toxic = prose(rng, rng.randrange(5, 60)), i % 6 == 0
        if toxic:
            words = text.split()
            words.insert(rng.randrange(len(words)), rng.choice(["blarghead", "blarghs", "zounder!", "Z0under"]))
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    extra = [(5001, None), (5002, ""), (None, "x"), (3, rows[3][1]), (5003, "zounder " * 30_000)]
    told = spark.createDataFrame([*labels, (None, 1), (7, None), (7, 0), (99999, 1)], "doc_id long, toxic int")
    got = score_toxicity(documents(spark, rows + extra), told).collect()
    assert len(got) == len(rows) + len(extra)
    held = {r["doc_id"]: r for r in got if r["held_out"]}
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in held)
    right = [r["predicted"] == labels[i][1] for i, r in held.items() if i is not None and i < 1200]
    assert len(right) > 300 and sum(right) / len(right) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[5003]["predicted"] == 1 and by_id[5001]["score"] == by_id[5002]["score"] < 0.7


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = corpus(400)
    docs = documents(spark, rows)
    odd = [(i, t if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - t) for i, t in labels]
    scores = [
        {r["doc_id"]: r["score"] for r in score_toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()}
        for x in (labels, odd)
    ]
    assert scores[0] == scores[1]


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = documents(spark, [(1, "a"), (2, None)])
    assert [r["score"] for r in score_toxicity(docs, none).collect()] == [0.0, 0.0]
    assert score_toxicity(docs.filter(F.lit(False)), none).collect() == []
    kept = score_toxicity(docs, none, keep=docs.columns)
    assert set(docs.columns) <= set(kept.columns)


def test_spaced_letters_count_in_every_text(spark):
    rows, labels = corpus()
    spaced = [(6001, "alpha1 beta2 z o u n d e r gamma3 delta4"), (6002, "you are a B l a r g h s kappa7 mu8")]
    told = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = score_toxicity(documents(spark, rows + spaced), told).collect()
    assert {r["doc_id"]: r["predicted"] for r in got if r["doc_id"] > 6000} == {6001: 1, 6002: 1}


def test_runs_of_spaced_letters():
    features = Features({"zounder": 2.0, "blar*": 1.0})

    def of(text):
        return dict(zip(FEATURES, features.of(text), strict=True))

    plain, hidden = of("oh you zounder !"), of("oh you z o u n d e r !")
    assert hidden["hits"] == plain["hits"] == 1 and hidden["strongest"] == plain["strongest"] == 2
    assert hidden["obfuscated"] > 0 and hidden["opened"] > 0 and hidden["near_you"] > 0
    assert of("x z.o.u.n.d.e.r y")["hits"] == 1  # opened as one word, not twice
    assert of("no l e t t e r s here")["hits"] == 0 < of("no l e t t e r s here")["obfuscated"]
    far = "you " + "word " * 9 + "b l a r g h"  # no letter of it is a second person
    assert of(far)["near_you"] == 0 and of(far + " word you and b l a r g h")["near_you"] > 0
    for n in (199_990, 200_010):
        long = of("word " * n + "z o u n d e r")
        assert long["hits"] == 1 and long["obfuscated"] > 0
    assert of("i " * 1_000_000)["hits"] == 0


def test_repeated_rows_of_a_labelled_id_weigh_as_one(spark):
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:3]
    told = spark.createDataFrame([(i, int(i == ids[0])) for i in ids], "doc_id long, toxic int")
    rows = [(i, "a b c") for i in ids] + [(ids[0], f"a b {n}") for n in range(50)]
    assert {r["score"] for r in score_toxicity(documents(spark, rows), told).collect()} == {1 / 3}
