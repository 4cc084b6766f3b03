"""The pipeline's stages, each against a plain version on its own input."""

from __future__ import annotations

import re

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from pairlake.llm.secrets import RULES, find_spans
from pairlake.llm.toxicity import score_toxicity

SAMPLE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    seen = [docs]
    for n, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SAMPLE).write.parquet(f"file://{folder}/{n}")
        docs = spark.read.parquet(f"file://{folder}/{n}")
        seen.append(docs)
    return seen


def plain(df):
    return sorted(map(str, df.select(*cp.COLUMNS).collect()))


def test_shapes(stages):
    for docs in stages[:-1]:
        assert tuple(docs.columns) == cp.COLUMNS and docs.dtypes == stages[0].dtypes
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "segmentations"]


def test_toxic_documents_go_and_no_others(spark, stages):
    labels = spark.read.parquet(f"{SAMPLE}/labels.parquet")
    scored = score_toxicity(stages[0], labels)
    kept = {r["doc_id"] for r in scored.filter("predicted = 0").collect()}
    assert {r["doc_id"] for r in stages[1].collect()} == kept


def test_one_of_each_group_stays(stages):
    from test_chosen_paths import brute

    before = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    assert sorted(r["doc_id"] for r in stages[2].collect()) == [i for i, _, _, kept in brute(before, 80) if kept]


def test_secrets_are_masked_and_nothing_else(stages):
    rules = [(k, re.compile(p), g, n) for k, p, g, n in RULES]
    after = {r["doc_id"]: r for r in stages[3].collect()}
    assert len(after) == stages[2].count()
    for r in stages[2].collect():
        text, at, spans = "", 0, find_spans(r["text"] or "", rules)
        for start, _, end in spans:
            if start > at or not text and start == 0:
                text += r["text"][at:start] + "[SECRET]"
            at = max(at, end)
        want = text + r["text"][at:] if spans else r["text"]
        assert after[r["doc_id"]]["text"] == want
        assert after[r["doc_id"]]["n_chars"] == (len(want) if spans else r["n_chars"])


def test_mix_repeats_whole_rows(stages):
    before = plain(stages[3])
    after = plain(stages[4])
    assert set(after) <= set(before) and max(map(after.count, set(after))) <= cp.EPOCHS


def test_the_whole_is_its_stages(spark, stages):
    assert sorted(map(str, cp.run(spark, SAMPLE).collect())) == sorted(map(str, stages[-1].collect()))


def test_copies_draw_samples_of_their_own(spark):
    text = "a few words that can be cut in very many ways"
    docs = spark.createDataFrame(
        [(1, text, "en", "s", 9)] * 3 + [(1, "other text", "en", "s", 9), (2, text, "en", "s", 9), (None, None, None, None, None)] * 2,
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    rows = cp.sample_pieces(spark, docs, SAMPLE).collect()
    first = [(r["copy"], len(r["ids"]), r["log_inclusion"]) for r in rows if r["doc_id"] == 1 and r["rank"] == 1]
    assert sorted(c for c, _, _ in first) == [1, 1, 2, 2, 3]
    assert len({chance for _, n, chance in first if n > 2}) == 3  # drawn anew for each copy
    assert sorted(r["copy"] for r in rows if r["doc_id"] is None) == [1, 2]
    again = cp.sample_pieces(spark, docs.orderBy(F.desc("text")), SAMPLE).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_last_stage_has_samples_of_every_row(stages):
    rows = stages[5].groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    copies = {r["doc_id"]: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert {r["doc_id"]: r["n"] for r in rows} == {i: cp.SAMPLES * n for i, n in copies.items()}
