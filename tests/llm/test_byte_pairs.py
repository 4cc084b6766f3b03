"""BPE ids against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from helpers import documents, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairlake.llm.byte_pairs import SHORT, Encoder, Merger, decode, encode
from pairlake.llm.queries import QUERIES

BPE = public_tokenizers.path("word_bpe_49k.json")
POOL = [*"abcdefgh '’.,-<|>ÄéßΣςİıﬁ𝔘é́ \u0085\x1c\x1f\n\t0123٣中文한\x00", "<|endoftext|>", "'ll", "'S", "ing "]


def texts(rng: random.Random) -> list[str | None]:
    mixed = ["".join(rng.choice(POOL) for _ in range(rng.randrange(90))) for _ in range(300)]
    return [*mixed, None, "", " \n\t ", "z" * 20_000, "á" * 300, "ab" * 400 + "<|endoftext|>", prose(rng, 3000)]


@pytest.mark.parametrize(("name", "drops"), [("word_bpe_49k.json", True), ("word_bpe_49k.json", False), ("byte_bpe_50k.json", False)])
def test_ids_and_text_are_the_librarys(spark, name, drops):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    rows = list(enumerate(texts(random.Random(5)))) + [(None, "no id"), (3, "again"), (3, "again")]
    docs = documents(spark, rows).repartition(3)
    coded = encode(docs, public_tokenizers.path(name), drops)
    got = decode(coded, public_tokenizers.path(name)).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(repr, want)) == sorted(
        repr((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["text"])) for r in got
    )


def test_scan_and_queue_agree():
    encoder = Encoder(BPE, True)
    rng = random.Random(2)
    words = ["".join(rng.choice("aeinrst") for _ in range(n)).encode() for n in range(1, SHORT + 1) for _ in range(5)]
    words += [b"a" * n for n in (1, 2, 3, SHORT)]
    assert encoder.merger.encode(words) == [np.array(encoder.merger._queue(w), "<u4").tobytes() for w in words]


def test_forgotten_words_are_encoded_again():
    small, large = Encoder(BPE, True, known=10), Encoder(BPE, True)
    rng = random.Random(4)
    batches = [[prose(rng, 50) for _ in range(3)] for _ in range(5)]
    assert [small.encode(b) for b in batches] == [large.encode(b) for b in batches]


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        Merger({"model": {"type": "WordPiece", "vocab": {}}})


def test_empty_table_and_clashing_names(spark):
    none = encode(documents(spark, []), BPE, True)
    assert none.collect() == [] and none.columns == ["doc_id", "n_tokens", "ids"]
    odd = documents(spark, [(1, "some text")]).withColumnsRenamed({"rank": "ids", "vector": "_text", "node": "n_tokens"})
    row = decode(encode(odd, BPE, True).withColumn("text", F.lit("old")), BPE).first()
    assert row["text"] == "some</w> text</w>" and row["n_tokens"] == 2


def test_query_equals_the_library(spark):
    folder = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(BPE)
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        packed = np.array(ids, "<u4").tobytes()
        want.add((r["doc_id"], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert {tuple(r) for r in QUERIES["op11_word_pieces"](spark, folder).collect()} == want
