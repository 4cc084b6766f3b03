"""Prediction logs and new pairs that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairlake.operators.similarity import find_leaks, index_tests
from pairlake.session import cut, scratch_scope
from pairlake.sources.files import LOG_ORDER, PREDICTION_FIELDS, PREDICTIONS, numbered, read_log_lines
from pairlake.streaming.keyed import KeyedTable

# State grows with the number of ids, so it lives on disk next to the checkpoint.
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest_predictions(
    spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str = PREDICTIONS
) -> StreamingQuery:
    """Append new JSON prediction lines to ``sink``, one row per id; resumable.

    The first line of an id is kept here, and the state grows with the ids, which never
    expire. ``ingest_latest`` keeps the last line, as the batch reader does, and no state.
    """
    own = spark.newSession()  # the caller's state store setting stays as it is
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    lines = own.readStream.schema(schema).option("recursiveFileLookup", "true").json(source)
    return (
        lines.dropDuplicates(["id"])
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


LOG_KEYS = ("model", "runtime", "set", "id")


def ingest_latest(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Keep the last line of every id of the logs in ``source``; resumable.

    Whatever the runs and batches in which lines come, ``latest_predictions`` gives what
    ``read_predictions`` reads from the finished logs. A batch writes its own ids only.
    """
    table = _predictions(spark, sink)

    def keep(batch: DataFrame, number: int) -> None:
        table.add(numbered(batch).select(*LOG_KEYS, *[f for f in PREDICTION_FIELDS if f != "id"], *LOG_ORDER), number)

    lines = spark.readStream.schema(PREDICTIONS).option("recursiveFileLookup", "true").json(source)
    return (
        read_log_lines(lines)
        .writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _predictions(spark: SparkSession, sink: str) -> KeyedTable:
    return KeyedTable(spark, sink, LOG_KEYS, LOG_ORDER)


def latest_predictions(spark: SparkSession, sink: str) -> DataFrame | None:
    """What ``ingest_latest`` has kept so far, in the columns of ``read_predictions``."""
    found = _predictions(spark, sink).latest()
    return found if found is None else found.select(*PREDICTION_FIELDS, "model", "runtime", "set")


def filter_new_pairs(
    spark: SparkSession,
    source: str,
    tests: DataFrame,
    accepted: str,
    report: str,
    checkpoint: str,
    schema: str,
) -> StreamingQuery:
    """Leak-check arriving pairs against the test set and keep a report per batch.

    Each batch overwrites its own folder, so a repeated batch changes nothing:
    ``accepted/batch=<n>`` holds its clean pairs; ``report`` is a keyed table to which a batch
    adds its own lines (pairs and leaks per database), which replace older ones when read.
    """

    index = index_tests(tests)
    lines = _report(spark, report)

    def check(batch: DataFrame, number: int) -> None:
        with scratch_scope(spark):
            pairs = cut(batch)
            leaks = find_leaks(pairs, index).select("id").withColumn("leak", F.lit(True))
            judged = cut(
                pairs.join(leaks, "id", "left").withColumn("leak", F.coalesce("leak", F.lit(False)))
            )
            judged.filter(~F.col("leak")).drop("leak").write.mode("overwrite").parquet(
                f"{accepted}/batch={number}"
            )
            fresh = judged.groupBy("db_id").agg(
                F.count(F.lit(1)).alias("pairs"), F.count_if("leak").alias("leaks")
            )
            lines.add(fresh, number)

    arriving = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(source)
    return (
        arriving.writeStream.foreachBatch(check)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _report(spark: SparkSession, report: str) -> KeyedTable:
    return KeyedTable(spark, report, ["db_id"])


def latest_report(spark: SparkSession, report: str) -> DataFrame | None:
    """Per database the line of the last batch that brought it pairs."""
    found = _report(spark, report).latest()
    return found if found is None else found.select("db_id", "pairs", "leaks")
