"""Secret scans through a ledger of content-addressed blobs.

Every text is a blob, addressed by SHA-256; the paths (document ids, versions) that hold
it are rows that name the digest. A ledger remembers which (blob, rule version) pairs have
been scanned and what was found. A run scans only pairs that the ledger lacks, one copy of
each blob, appends the findings, and joins them back to all paths.

Defined cases: null and empty texts hold nothing; repeated rows and copies get the same
findings; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

from pairlake.llm.digests import digest, read_ledger, texts_behind
from pairlake.session import scratch

SPAN = StructType(
    [
        StructField("kind", StringType()),
        StructField("start", IntegerType()),
        StructField("end", IntegerType()),
    ]
)
LEDGER = StructType(
    [
        StructField("digest", BinaryType()),
        StructField("version", StringType()),
        StructField("spans", ArrayType(SPAN)),
    ]
)

# kind, pattern, group that must be long enough, its least length. Matches are leftmost and
# do not overlap within a kind; a match that is too short is dropped but uses up its text.
RULES = (
    (
        "assign",
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
        r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?"""
        r"""([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)


def rules_version(rules=RULES) -> str:
    return hashlib.sha256(repr(tuple(rules)).encode()).hexdigest()


def find_spans(text: str, rules) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start, then in the order of the rules."""
    found = []
    for place, (kind, pattern, group, least) in enumerate(rules):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), place, kind, m.end()))
    found.sort()
    return [(start, kind, end) for start, _, kind, end in found]


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(digest, spans) for (digest, text)."""
    out = StructType([f for f in LEDGER.fields if f.name != "version"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(k, re.compile(p), g, n) for k, p, g, n in rules]
        for frame in frames:
            spans = [
                [{"kind": k, "start": s, "end": e} for s, k, e in find_spans(text, compiled)]
                for text in frame["text"]
            ]
            yield pd.DataFrame({"digest": frame["digest"], "spans": spans})

    return blobs.select("digest", "text").mapInPandas(run, out)


def scan_secrets(
    docs: DataFrame,
    ledger: str | None = None,
    rules=RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id_col, digest, spans), one row per row of ``docs``; spans in order of start.

    ``ledger`` is the ledger's folder, kept between runs; without it a fresh one is begun.
    """
    spark = docs.sparkSession
    ledger = ledger or scratch(spark, "secret-ledger")
    version = rules_version(rules)
    paths = docs.select(F.col(id_col).alias("row_id"), digest(text_col).alias("digest"))
    seen = read_ledger(spark, ledger, LEDGER).filter(F.col("version") == version)
    unseen = paths.select("digest").distinct().join(seen.select("digest"), "digest", "left_anti")
    found = scan_blobs(texts_behind(docs, unseen, text_col), rules)
    (
        found.select("digest", F.lit(version).alias("version"), "spans")
        .write.mode("append")
        .parquet(ledger)
    )
    hits = (
        read_ledger(spark, ledger, LEDGER)
        .filter((F.col("version") == version) & (F.size("spans") > 0))
        .groupBy("digest")
        .agg(F.max("spans").alias("spans"))
    )
    return paths.join(hits, "digest", "left").select(
        F.col("row_id").alias(id_col),
        "digest",
        F.coalesce("spans", F.array().cast(ArrayType(SPAN))).alias("spans"),
    )


def redact(text: F.Column, spans: F.Column, mask: str = "[SECRET]") -> F.Column:
    """``text`` with every stretch covered by spans replaced by ``mask``, as an expression.

    Spans may touch or overlap; a stretch they cover together gets one mask.
    """
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: F.Column, span: F.Column) -> F.Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(span["start"] - acc["at"], F.lit(0)))
        fresh = (span["start"] > acc["at"]) | (acc["out"] == "")
        return F.struct(
            F.concat(acc["out"], gap, F.when(fresh, F.lit(mask)).otherwise(F.lit(""))).alias("out"),
            F.greatest(acc["at"], span["end"]).alias("at"),
        )

    def end(acc: F.Column) -> F.Column:
        return F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, step, end)).otherwise(text)
