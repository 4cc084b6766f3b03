"""JSONL, CSV and Parquet files in and out, prediction logs, digests of files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlake.operators.repair import table_name

PAIRS = (
    "id string, db_id string, schema_text string, question string, sql string, "
    "source string, difficulty string"
)
TEST_ITEMS = (
    "id string, db_id string, question string, gold_sql string, gold_result_hash string, "
    "difficulty string"
)
PREDICTIONS = "id string, sql string, latency_ms double, tokens_out bigint, tokens_in bigint"
PREDICTION_FIELDS = tuple(f.split()[0] for f in PREDICTIONS.split(", "))
LOG_ORDER = ("_written", "_path", "_block", "_line")
# Stands for a quoted empty field while a CSV file is read; no text holds it.
_QUOTED_EMPTY = "\x00empty\x00"
# Bytes of a file that Spark reads as one row (it can hold up to 2 GB), and of a streamed piece.
WHOLE_FILE, PIECE = 256 << 20, 8 << 20
# ``model__runtime__set.jsonl``, as a file or as the folder that Spark writes.
_STEM = r"([^/=]+?)__([^/]+?)__([^/]+?)\.jsonl"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One JSON object per line; blank lines are skipped, broken ones fail the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def read_log_lines(lines: DataFrame) -> DataFrame:
    """Lines read as ``PREDICTIONS`` with ``model, runtime, set`` from the file name, and where
    they stand: ``numbered`` completes ``LOG_ORDER``, by which an id's last line is greatest."""
    named = (
        lines.withColumn("_path", F.url_decode(F.col("_metadata.file_path")))
        .withColumn("_written", F.col("_metadata.file_modification_time"))
        .withColumn("_block", F.col("_metadata.file_block_start"))
    )
    for i, column in enumerate(("model", "runtime", "set"), 1):
        named = named.withColumn(column, F.regexp_extract("_path", _STEM, i))
    return named


def numbered(lines: DataFrame) -> DataFrame:
    return lines.withColumn("_line", F.monotonically_increasing_id())


def read_predictions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Prediction logs with ``model, runtime, set`` from the file name.

    A resumed run may append an id again: the last line of a log counts.
    """
    lines = spark.read.schema(PREDICTIONS).option("recursiveFileLookup", "true").json(path)
    last = F.max_by(F.struct(*PREDICTION_FIELDS), F.struct(*LOG_ORDER))
    return (
        numbered(read_log_lines(lines))
        .groupBy("model", "runtime", "set", F.col("id").alias("_id"))
        .agg(last.alias("p"))
        .select("p.*", "model", "runtime", "set")
    )


def read_csv(spark: SparkSession, path: str, null: str = "NA") -> DataFrame:
    """A CSV file with a header, inferred types, and a marker for NULL."""
    return spark.read.csv(path, header=True, nullValue=null, inferSchema=True)


def read_loose_csv(
    spark: SparkSession, path: str, columns: list[str], line_breaks: bool = False
) -> DataFrame:
    """A headless CSV as text: a bare empty field is NULL, a quoted one is ''.

    ``line_breaks`` says that quoted fields may hold some; such a file is read by one task.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.csv(
        path, schema=schema, nullValue="", emptyValue=_QUOTED_EMPTY, escape='"', multiLine=line_breaks
    )
    return rows.select(
        *[
            F.when(F.col(f"`{c}`") == _QUOTED_EMPTY, F.lit("")).otherwise(F.col(f"`{c}`")).alias(c)
            for c in columns
        ]
    )


def open_upload(spark: SparkSession, path: str) -> str:
    """Register a CSV or Parquet file as a view named after it; returns the name."""
    name = re.split(r"[/\\]", path.rstrip("/"))[-1]
    if name.lower().endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.csv(path, header=True, inferSchema=True)
    view = spark.range(1).select(table_name(F.lit(name))).first()[0]
    df.createOrReplaceTempView(view)
    return view


def file_digests(
    spark: SparkSession, root: str, pattern: str = "*", whole: int = WHOLE_FILE
) -> DataFrame:
    """``file, length, sha256`` of every file under ``root`` whose name fits ``pattern``.

    ``file`` is the path below ``root``, so equal names in two folders stay apart. Files of up
    to ``whole`` bytes are read by Spark, one row each. Larger ones are streamed through a
    digest in pieces, one task per file and never more than a piece in memory; they must be
    in a store that pyarrow opens too (local, HDFS, S3, GCS). Spark lists no empty files.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.option("pathGlobFilter", pattern).load(root)
    below = F.concat(F.lit("/"), F.lit(root.strip("/").split("://")[-1].strip("/")), F.lit("/"))
    name = F.substring(
        "path", F.instr("path", below) + F.length(below), F.length("path")
    ).alias("file")
    small = files.filter(F.col("length") <= whole).select(name, "length", F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > whole).select(name, "length", "path")
    # One task per file: a digest cannot be taken in parts.
    spread = large.repartition("path")
    return small.unionByName(spread.mapInArrow(_stream_digests, "file string, length bigint, sha256 string"))


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from urllib.parse import quote

    for batch in batches:
        for name, length, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            store, place = pa_fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", quote(path, safe="/:")))
            seen = hashlib.sha256()
            with store.open_input_stream(place) as stream:
                while piece := stream.read(PIECE):
                    seen.update(piece)
            yield pa.RecordBatch.from_pylist([{"file": name, "length": length, "sha256": seen.hexdigest()}])


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``file, status``: ok, changed, missing, or unpinned when no digest is recorded."""
    pinned = manifest.select("file", F.col("sha256").alias("_want"), F.lit(True).alias("_listed"))
    return files.join(pinned, "file", "full").filter(F.coalesce("_listed", F.lit(False))).select(
        "file",
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.col("_want").isNull(), "unpinned")
        .when(F.col("sha256") == F.col("_want"), "ok")
        .otherwise("changed")
        .alias("status"),
    )
