"""Content digests and append-only tables keyed by them, shared by the scan and the counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def digest(text: str) -> F.Column:
    """SHA-256 of a text's UTF-8 bytes, 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def texts_behind(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(digest, text) of the texts whose digests ``wanted`` names, each exactly once.

    Copies of a text collapse where they are read, whatever their ids, so of a text that a
    third of all rows hold one copy per task moves, and one reaches whoever reads this.
    """
    texts = docs.select(digest(text_col).alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    once = texts.groupBy("digest").agg(F.first("text").alias("text"))
    return once.join(wanted.select("digest").hint("merge"), "digest", "left_semi")


def read_ledger(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at ``path``, or an empty one if nothing has been appended yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
