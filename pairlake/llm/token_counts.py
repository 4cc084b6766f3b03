"""Token counts through a cache keyed by content digest and tokenizer version.

Texts are normalised only where that cannot change a count (null counts as empty), and
addressed by SHA-256. Counts known for (digest, version) come from the cache; of the rest
every distinct text is encoded once and appended. Rows of one text share a count, however
many there are: only digests are shuffled for them.

Defined cases: null and empty texts have 0 tokens and 0 bytes; repeated rows are counted
alike and kept; an empty table gives an empty result and leaves the cache as it is; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from pairlake.llm.digests import digest, read_ledger, texts_behind
from pairlake.session import scratch

CACHE = StructType(
    [
        StructField("digest", BinaryType()),
        StructField("version", StringType()),
        StructField("n_tokens", LongType()),
    ]
)
KNOWN_WORDS = 400_000  # words whose counts a worker remembers; beyond, it starts afresh
_SPACE = re.compile(r"[\x09-\x0d\x20]+")


def tokenizer_version(path: str) -> str:
    """SHA-256 of the tokenizer file: a changed file never meets old counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class WordCounter:
    """Counts of a tokenizer that drops white space, summed over the words of a text.

    Such a tokenizer cuts at white space before it merges, so a text has as many tokens as
    its words have together, and a word seen before needs no encoding.
    """

    def __init__(self, path: str, known: int = KNOWN_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known, self.limit = {}, known

    def count(self, texts: list[str]) -> list[int]:
        split = [[w for w in _SPACE.split(t) if w] for t in texts]
        if len(self.known) > self.limit:
            self.known = {}
        known = self.known
        new = list({w for words in split for w in words if w not in known})
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            encoded = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            known.update(zip(part, map(len, encoded), strict=True))
        return [sum(map(known.__getitem__, words)) for words in split]


class PieceCounter:
    """Counts of a SentencePiece model, text by text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]


class TextCounter:
    """Counts of any other tokenizer file, text by text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def count(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _counter(path: str, drops_space: bool):
    if path.endswith(".model"):
        return PieceCounter(path)
    return WordCounter(path) if drops_space else TextCounter(path)


def encode_counts(texts: DataFrame, path: str, drops_space: bool) -> DataFrame:
    """(digest, n_tokens) for (digest, text); a worker loads the tokenizer once per task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = _counter(path, drops_space)
        for frame in frames:
            rows = []
            for at in range(0, len(frame), 256):
                rows += counter.count(frame["text"].iloc[at : at + 256].tolist())
            yield pd.DataFrame({"digest": frame["digest"], "n_tokens": pd.Series(rows, dtype="int64")})

    return texts.select("digest", "text").mapInPandas(run, "digest binary, n_tokens long")


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    cache: str | None = None,
    limit: int = 2048,
    drops_space: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit), one row per row of ``docs``.

    ``tokenizer`` is a file that every executor can open. ``cache`` is the folder of the
    cache table, kept between calls; without it a fresh one is begun. ``drops_space`` says
    that the tokenizer cuts at white space and drops it, as word_bpe_49k.json does.
    """
    spark = docs.sparkSession
    cache = cache or scratch(spark, "token-counts")
    version = tokenizer_version(tokenizer)
    named = docs.select(
        F.col(id_col).alias("row_id"),
        digest(text_col).alias("digest"),
        F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
    )
    stored = read_ledger(spark, cache, CACHE).filter(F.col("version") == version)
    misses = named.select("digest").distinct().join(stored, "digest", "left_anti")
    counted = encode_counts(texts_behind(docs, misses, text_col), tokenizer, drops_space)
    (
        counted.select("digest", F.lit(version).alias("version"), "n_tokens")
        .write.mode("append")
        .parquet(cache)
    )
    known = (
        read_ledger(spark, cache, CACHE)
        .filter(F.col("version") == version)
        .groupBy("digest")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )
    return named.join(known, "digest").select(
        F.col("row_id").alias(id_col),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
