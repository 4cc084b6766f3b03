"""Registered queries: incremental ingest and leak checks on arriving pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.plans import curation, roles
from pairlake.plans.registry import Tables, query
from pairlake.session import scratch
from pairlake.streaming import ingest


@query(
    "t1_incremental_ingest",
    f"WITH {roles.LOG} SELECT CAST(id AS VARCHAR) AS id, latency_ms, tokens_in, tokens_out FROM log",
)
def incremental_ingest(t: Tables) -> DataFrame:
    """Two runs over a growing log folder, the second with lines already seen."""
    source, sink, checkpoint = (scratch(t.spark, n) for n in ("log", "sink", "progress"))
    log = roles.prediction_log(t).select(
        F.col("id").cast("string").alias("id"), F.lit("SELECT 1;").alias("sql"), "latency_ms", "tokens_out", "tokens_in"
    )
    for part in (log.filter("latency_ms < 50"), log):
        part.write.mode("append").json(source)
        ingest.ingest_predictions(t.spark, source, sink, checkpoint).awaitTermination()
    return t.spark.read.parquet(sink).select("id", "latency_ms", "tokens_in", "tokens_out")


@query(
    "t1_latest_predictions",
    f"""
WITH {roles.LOG} SELECT CAST(id AS VARCHAR) AS id, latency_ms, tokens_in,
  CASE WHEN latency_ms >= 50 AND latency_ms < 70 THEN tokens_out + 1 ELSE tokens_out END AS tokens_out FROM log""",
)
def latest_predictions(t: Tables) -> DataFrame:
    """Three runs over a growing log folder; the last line of every id counts."""
    source, sink, checkpoint = (scratch(t.spark, n) for n in ("logs", "sink", "progress"))
    log = roles.prediction_log(t).select(
        F.col("id").cast("string").alias("id"), F.lit("SELECT 1;").alias("sql"), "latency_ms", "tokens_out", "tokens_in"
    )
    again = log.withColumn("tokens_out", F.col("tokens_out") + 1)
    for part in (again.filter("latency_ms < 50"), log, again.filter("latency_ms >= 50 and latency_ms < 70")):
        part.write.mode("append").json(f"{source}/m__r__s.jsonl")
        ingest.ingest_latest(t.spark, source, sink, checkpoint).awaitTermination()
    kept = ingest.latest_predictions(t.spark, sink)
    return kept.select("id", "latency_ms", "tokens_in", "tokens_out")


@query(
    "t2_arriving_pairs",
    f"""
WITH {roles.DOC_PAIRS}, {curation.LEAKS}
SELECT db_id, count(*) AS pairs, count_if(same_question OR same_sql OR near_question)::BIGINT AS leaks
FROM leaks JOIN train USING (id) GROUP BY 1""",
)
def arriving_pairs(t: Tables) -> DataFrame:
    """Unlabelled documents arrive by language and are checked against labelled ones."""
    source, accepted, report, checkpoint = (
        scratch(t.spark, n) for n in ("arriving", "accepted", "report", "progress")
    )
    pairs = roles.train_pairs(t).select("id", "db_id", "question", "sql")
    for arrival in (F.col("db_id") == "en", F.col("db_id") != "en"):
        pairs.filter(arrival).write.mode("append").json(source)
        ingest.filter_new_pairs(
            t.spark, source, roles.test_items(t), accepted, report, checkpoint,
            "id bigint, db_id string, question string, sql string",
        ).awaitTermination()
    return ingest.latest_report(t.spark, report).select("db_id", "pairs", "leaks")
