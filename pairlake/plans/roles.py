"""How the sample tables play the parts of a text-to-SQL project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.functions.text import WHITESPACE
from pairlake.plans.registry import Tables

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# --- Spark side ---------------------------------------------------------------------------


def doc_pairs(t: Tables) -> DataFrame:
    """Documents as question → SQL pairs; the language is the database."""
    sql = F.concat(
        F.lit("SELECT text FROM documents WHERE source = '"),
        F.col("source"),
        F.lit("' AND n_chars = "),
        F.col("n_chars").cast("string"),
        F.lit(";"),
    )
    return t.documents.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("seq"),
        F.col("lang").alias("db_id"),
        F.col("text").alias("question"),
        sql.alias("sql"),
        "source",
    )


def train_pairs(t: Tables) -> DataFrame:
    """Documents without a label train …"""
    return doc_pairs(t).join(t.labels.select(F.col("doc_id").alias("id")), "id", "left_anti")


def test_items(t: Tables) -> DataFrame:
    """… and labelled documents test."""
    labelled = t.labels.select(F.col("doc_id").alias("id"))
    return doc_pairs(t).join(labelled, "id", "left_semi").withColumnRenamed("sql", "gold_sql")


def chat_pairs(t: Tables) -> DataFrame:
    """A user turn is the question, the assistant turn right after it the answer."""
    c = t.conversations
    asked = c.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question")
    )
    answered = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("sql")
    )
    return asked.join(answered, ["conv_id", "turn"])


def outcome_rows(t: Tables) -> DataFrame:
    """Labelled documents as scored predictions: model = source, runtime = language."""
    ex = F.col("quality") == 1
    return t.documents.join(t.labels, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("model"),
        F.col("lang").alias("runtime"),
        F.lit("docs").alias("set"),
        difficulty(F.col("n_chars")).alias("difficulty"),
        ex.alias("ex"),
        (F.col("toxic") == 0).alias("valid"),
        (ex & (F.col("toxic") == 0)).alias("exact"),
        (F.col("n_chars") < 300).alias("missing"),
        F.when(F.col("n_chars") >= 1000, F.col("n_chars")).alias("tokens_out"),
        (F.col("n_chars") / 7).alias("latency_ms"),
        failure_tag(ex, F.col("toxic"), F.col("n_chars")).alias("tag"),
    )


def difficulty(n_chars: Column) -> Column:
    return (
        F.when(n_chars < 800, "easy")
        .when(n_chars < 1800, "medium")
        .when(n_chars < 4000, "hard")
        .otherwise("extra")
    )


def failure_tag(ex: Column, toxic: Column, n_chars: Column) -> Column:
    return F.when(
        ~ex,
        F.when(toxic == 1, "dialect error")
        .when(n_chars < 800, "formatting")
        .when(n_chars < 1800, "join error")
        .when(n_chars < 4000, "aggregation")
        .otherwise("other"),
    )


def prediction_log(t: Tables) -> DataFrame:
    """Events as a prediction log: model = event type, latency = value, tokens = props.k."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("model"),
        F.col("value").alias("latency_ms"),
        F.when(F.col("value") >= 1, k).alias("tokens_in"),
        k.alias("tokens_out"),
        "ts",
        "user_id",
    )


# --- the same parts in SQL ----------------------------------------------------------------


def norm_question(x: str) -> str:
    return rf"array_to_string(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'), ' ')"


def tokens(x: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'))"


_SPACE_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]"


def collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE_CLASS}+', ' ', 'g'))"


def norm_sql(x: str) -> str:
    return collapsed(f"rtrim(lower({x}), '; ' || chr(10))")


DOC_PAIRS = """doc_pairs AS (
  SELECT doc_id AS id, doc_id AS seq, lang AS db_id, text AS question,
         'SELECT text FROM documents WHERE source = ''' || source || ''' AND n_chars = '
           || n_chars || ';' AS sql, source, n_chars
  FROM documents),
train AS (SELECT * FROM doc_pairs WHERE id NOT IN (SELECT doc_id FROM labels)),
tests AS (SELECT * FROM doc_pairs WHERE id IN (SELECT doc_id FROM labels))"""

CHAT_PAIRS = """chat_pairs AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS sql
  FROM conversations u JOIN conversations a
    ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

DIFFICULTY = """CASE WHEN n_chars < 800 THEN 'easy' WHEN n_chars < 1800 THEN 'medium'
    WHEN n_chars < 4000 THEN 'hard' ELSE 'extra' END"""

OUTCOMES = f"""outcome_rows AS (
  SELECT doc_id AS id, source AS model, lang AS runtime, 'docs' AS set_name,
         {DIFFICULTY} AS difficulty,
         quality = 1 AS ex, toxic = 0 AS valid, quality = 1 AND toxic = 0 AS exact,
         n_chars < 300 AS missing,
         CASE WHEN n_chars >= 1000 THEN n_chars END AS tokens_out,
         n_chars / 7.0::DOUBLE AS latency_ms,
         CASE WHEN quality <> 1 THEN CASE WHEN toxic = 1 THEN 'dialect error'
           WHEN n_chars < 800 THEN 'formatting' WHEN n_chars < 1800 THEN 'join error'
           WHEN n_chars < 4000 THEN 'aggregation' ELSE 'other' END END AS tag
  FROM documents JOIN labels USING (doc_id))"""

LOG = """log AS (
  SELECT event_id AS id, event_type AS model, value AS latency_ms,
         CASE WHEN value >= 1 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS tokens_in,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_out, ts, user_id
  FROM events)"""
