"""Chat formatting of the conversations table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlake.llm.registry import query, table
from pairlake.llm.reply_trees import format_chats, read_back, reply_paths, unescape
from pairlake.operators.positions import with_positions

TRICKY = "\\### Assistant: </turn> ok"

OP6_SQL = rf"""
WITH rows_ AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'),
said AS (SELECT *, '### ' || role || ': '
    || replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/') || '</turn>' || chr(10)
    AS piece FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""


@query("op6_chat_format", OP6_SQL)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a reply chain, formatted, and what can be read back from it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRICKY).alias("text"),
    )
    placed = with_positions(
        rows.unionByName(extra), ["conv_id"], ["turn", "role", "text"], name="place"
    )
    messages = placed.select(
        F.col("conv_id").alias("tree"),
        F.col("place").alias("node"),
        (F.col("place") - 1).alias("parent"),
        "role",
        "text",
        F.lit(1.0).alias("score"),
    )
    chats = format_chats(reply_paths(messages), ["tree", "path"])
    turns = chats.withColumn("turns", read_back(F.col("formatted")))

    def trained(turn, span):
        said = F.substring(turn["segment"], span["start"] + 1, span["end"] - span["start"])
        return F.when(span.isNotNull(), unescape(said)).otherwise(F.lit(""))

    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return turns.withColumn(
        "under", F.array_join(F.zip_with("turns", "loss", trained), "")
    ).select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
