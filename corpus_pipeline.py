"""From documents to training pieces: five operators, one after the other.

Every stage reads all that its predecessor kept, and all but the last return the columns of
documents. Stages 1 and 2 drop documents, stage 3 masks secrets in the text, stage 4 drops
or repeats documents as the mix asks, stage 5 writes each document as sampled pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlake.llm.chosen_paths import near_duplicates
from pairlake.llm.digests import digest
from pairlake.llm.mixing import mix, repeat
from pairlake.llm.secrets import redact, scan_secrets
from pairlake.llm.segmentations import encode_samples
from pairlake.llm.toxicity import score_toxicity
from pairlake.session import cut, tune

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
SAMPLES = 2
SIMILAR = 80  # per cent of the shingles that near copies share


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7; the others go."""
    labels = tune(spark).read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, labels, threshold=0.7, keep=docs.columns)
    return scored.filter(F.col("predicted") == 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (four fifths of the shingles of both) the document with
    the smallest id.

    Rows without an id are in no group and stay; rows of one id are one document.
    """
    tune(spark)
    found = near_duplicates(docs, percent=SIMILAR)
    dropped = found.filter(~F.col("kept")).select("doc_id").hint("merge")  # as many as there are
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; every secret in a text is masked, and n_chars follows the text."""
    tune(spark)
    found = (
        scan_secrets(docs)
        .filter(F.size("spans") > 0)
        .dropDuplicates(["doc_id", "digest"])
        .withColumnsRenamed({"doc_id": "_id", "digest": "_digest", "spans": "_spans"})
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (digest("text") == F.col("_digest"))
    joined = docs.join(found.hint("merge"), same, "left")
    hit = F.col("_spans").isNotNull()
    masked = joined.withColumn(
        "text", F.when(hit, redact(F.col("text"), F.col("_spans"))).otherwise(F.col("text"))
    )
    chars = F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", chars).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    tune(spark)
    return repeat(docs, mix(docs, WEIGHTS, SHARE, EPOCHS))


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, copy, rank, n_pieces, log_prob, log_inclusion, ids): sampled segmentations.

    Equal rows are copies 1, 2, … of a document, and each copy draws samples of its own.
    """
    tune(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    rest = [c for c in docs.columns if c != "text"]
    same = docs.withColumn("_digest", digest("text")).groupBy(*rest, "_digest")
    counted = same.agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("_copies"))
    # Copies are dealt by their number: however many there are, no task has them all.
    copies = (
        counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
        .repartition("doc_id", "copy")
        .select("doc_id", "copy", F.xxhash64("doc_id", "copy").alias("seed"), "text")
    )
    sampled = encode_samples(copies, model, k=SAMPLES, key_col="seed", keep=("doc_id", "copy"))
    return sampled.select("doc_id", "copy", "rank", "n_pieces", "log_prob", "log_inclusion", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("segmentations", sample_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
