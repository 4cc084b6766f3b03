"""Registered queries: scores, error tags, latency and cost of prediction logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.functions.numbers import percent
from pairlake.operators import scoring as E
from pairlake.plans import roles
from pairlake.plans.registry import Tables, query

MODELS = ("click", "error", "purchase", "signup", "view")


def _logged(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as test items, lines' orders as predictions, prices as verdicts."""
    items = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("difficulty"),
        F.concat(F.lit("SELECT "), F.col("o_custkey").cast("string"), F.lit(" ;")).alias("gold_sql"),
    )
    predictions = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.min("l_quantity").alias("latency_ms"), F.max("l_suppkey").alias("tokens_out"), F.min("l_partkey").alias("p")
    )
    predictions = predictions.join(t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey"), "id").select(
        "id",
        F.when(F.col("latency_ms") > 30, "")
        .when(F.col("tokens_out") > F.col("latency_ms") * 3, F.concat(F.lit("```sql\nselect  "), F.col("o_custkey").cast("string"), F.lit("; -- ok\n```")))
        .otherwise(F.concat(F.lit("SELECT "), F.col("p").cast("string")))
        .alias("sql"),
        "latency_ms",
        "tokens_out",
    )
    verdicts = t.orders.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") != "P").alias("ran"),
        (F.col("o_totalprice") > 100000).alias("matched"),
        F.when(F.col("o_orderstatus") == "P", "Parser Error").alias("error"),
    )
    return items, predictions, verdicts


@query(
    "e1_outcomes",
    """
WITH preds AS (SELECT l_orderkey AS id, min(l_quantity) AS latency_ms, max(l_suppkey) AS tokens_out, min(l_partkey) AS p FROM lineitem GROUP BY 1),
texts AS (
  SELECT o.*, p.*, CASE WHEN p.id IS NULL OR latency_ms > 30 THEN 0 WHEN tokens_out > latency_ms * 3 THEN 1 ELSE 2 END AS kind
  FROM orders o LEFT JOIN preds p ON p.id = o_orderkey)
SELECT o_orderkey AS id, o_orderpriority AS difficulty,
       CASE kind WHEN 0 THEN '' WHEN 1 THEN 'select  ' || o_custkey || ';' ELSE 'SELECT ' || p || ';' END AS sql,
       kind > 0 AND o_orderstatus <> 'P' AS valid,
       kind > 0 AND o_orderstatus <> 'P' AND o_totalprice > 100000 AS ex,
       kind = 1 OR (kind = 2 AND p = o_custkey) AS exact,
       CASE WHEN o_orderstatus = 'P' THEN 'Parser Error' END AS error, latency_ms, tokens_out, id IS NULL AS missing
FROM texts""",
)
def outcomes(t: Tables) -> DataFrame:
    """Items joined with predictions: valid, correct, exact, missing."""
    return E.outcomes(*_logged(t)).drop("gold_sql")


@query(
    "e2_unstable_gold",
    """
SELECT CASE WHEN o_totalprice <= 300000 THEN 'ok' WHEN tied THEN 'reran' ELSE 'stale' END AS verdict, count(*) AS n
FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderdate) > 1 AS tied FROM orders) GROUP BY 1""",
)
def unstable_gold(t: Tables) -> DataFrame:
    """Gold results whose hash changed: accepted only where ties explain it."""
    ties = t.orders.groupBy("o_custkey", "o_orderdate").agg((F.count(F.lit(1)) > 1).alias("tied"))
    rows = t.orders.join(ties, ["o_custkey", "o_orderdate"])
    verdict = E.stable_verdict(F.col("o_totalprice") <= 300000, F.col("tied"))
    return rows.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


MESSAGES = (
    ("CREATE", "Parser Error: syntax error", "dialect error"),
    ("click", 'Binder Error: Referenced column "n" not found in FROM clause', "hallucinated schema"),
    ("error", "Catalog Error: Table with name foo does not exist", "hallucinated schema"),
    ("purchase", 'Binder Error: column "a" must appear in the GROUP BY clause', "aggregation"),
    ("signup", "Binder Error: No function matches date_trunc(VARCHAR)", "date/time functions"),
    ("view", 'Binder Error: Ambiguous reference to column name "id"', "join error"),
)


@query(
    "e3_message_tags",
    "SELECT event_id, CASE WHEN value < 1 THEN 'formatting' WHEN value > 100 THEN 'dialect error' "
    "WHEN event_type IN ('click', 'error') THEN 'hallucinated schema' WHEN event_type = 'purchase' THEN 'aggregation' "
    "WHEN event_type = 'signup' THEN 'date/time functions' ELSE 'join error' END AS tag FROM events",
)
def message_tags(t: Tables) -> DataFrame:
    """Failed predictions tagged by the engine's message."""
    error = F.when(F.col("value") > 100, MESSAGES[0][1])
    for kind, message, _ in MESSAGES[1:]:
        error = error.when(F.col("event_type") == kind, message)
    sql = F.when(F.col("value") < 1, "I cannot answer").otherwise("SELECT n FROM t;")
    gold = F.lit("SELECT a FROM t;")
    tag = E.error_tag(sql, error, gold, F.lit(None).cast("int"))
    return t.events.select("event_id", tag.alias("tag"))


@query(
    "e3_shape_tags",
    """
SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'wrong column or table' WHEN '2' THEN 'join error'
  WHEN '3' THEN 'aggregation' WHEN '4' THEN 'date/time functions'
  ELSE CASE WHEN o_orderstatus = 'F' THEN 'wrong column or table' ELSE 'other' END END AS tag FROM orders""",
)
def shape_tags(t: Tables) -> DataFrame:
    """Wrong results without an error: the shapes of both queries decide."""
    key = F.col("o_custkey").cast("string")
    gold = F.concat(F.lit("SELECT a FROM orders JOIN s ON s.k = orders.k WHERE k = "), key, F.lit(";"))
    first = F.left("o_orderpriority", F.lit(1))
    sql = (
        F.when(first == "1", F.concat(F.lit("SELECT a FROM customer JOIN s ON s.k = 1 WHERE k = "), key))
        .when(first == "2", F.concat(F.lit("SELECT a FROM orders JOIN s ON s.k = 1 JOIN s AS u ON u.k = 2 WHERE k = "), key))
        .when(first == "3", F.concat(F.lit("SELECT max(a) FROM orders JOIN s ON s.k = 1 WHERE k = "), key))
        .when(first == "4", F.concat(F.lit("SELECT a FROM orders JOIN s ON s.k = 1 WHERE year(d) = "), key))
        .otherwise(F.concat(F.lit("SELECT a FROM orders JOIN s ON s.k = 1 WHERE a <> "), key))
    )
    n_cols = F.when(F.col("o_orderstatus") == "F", 2).otherwise(1)
    tag = E.error_tag(sql, F.lit(None).cast("string"), gold, F.when(first == "5", n_cols).otherwise(1))
    return t.orders.select("o_orderkey", tag.alias("tag"))


@query(
    "e4_score_summary",
    f"""
WITH {roles.OUTCOMES}
SELECT model, runtime, set_name AS "set", count(*) AS n, count_if(missing)::BIGINT AS missing,
  CAST(printf('%.4f', count_if(ex)::DOUBLE / count(*)) AS DOUBLE) AS ex, CAST(printf('%.4f', count_if(valid)::DOUBLE / count(*)) AS DOUBLE) AS valid_sql,
  CAST(printf('%.4f', count_if(exact)::DOUBLE / count(*)) AS DOUBLE) AS exact_match, CAST(printf('%.1f', avg(tokens_out)) AS DOUBLE) AS tokens_out_mean, """
    + ", ".join(f"count_if(difficulty = '{d}')::BIGINT AS n_{d}" for d in ("easy", "medium", "hard", "extra"))
    + ", "
    + ", ".join(
        f"CAST(printf('%.4f', count_if(ex AND difficulty = '{d}')::DOUBLE / nullif(count_if(difficulty = '{d}'), 0)) AS DOUBLE) AS ex_{d}"
        for d in ("easy", "medium", "hard", "extra")
    )
    + ", "
    + ", ".join(f"count_if(NOT ex AND coalesce(tag, '') = '{x}')::BIGINT AS \"tag: {x}\"" for x in E.TAGS)
    + " FROM outcome_rows GROUP BY ALL",
)
def score_summary(t: Tables) -> DataFrame:
    """Counts, means, EX per difficulty and error tags per model and runtime."""
    return E.score_summary(roles.outcome_rows(t), ["model", "runtime", "set"])


@query(
    "e5_latency_percentiles",
    f"""
WITH {roles.LOG}, ranked AS (
  SELECT model, latency_ms, row_number() OVER (PARTITION BY model ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM log)
SELECT model, CAST(printf('%.1f', max(latency_ms) FILTER (i = least(n - 1, CAST(floor(0.5 * n) AS BIGINT)))) AS DOUBLE) AS latency_ms_p50,
       CAST(printf('%.1f', max(latency_ms) FILTER (i = least(n - 1, CAST(floor(0.95 * n) AS BIGINT)))) AS DOUBLE) AS latency_ms_p95
FROM ranked GROUP BY model""",
)
def latency_percentiles(t: Tables) -> DataFrame:
    """Median and 95th percentile latency per model."""
    return E.latency_percentiles(roles.prediction_log(t), ["model"])


_PRICES = {"click": (0.15, 0.60), "purchase": (1.0, 2.5), "view": (0.05, 0.08)}


@query(
    "e6_cost_per_query",
    f"""
WITH {roles.LOG}, prices AS (SELECT * FROM (VALUES {', '.join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, (a, b) in _PRICES.items())}) v(model, price_in, price_out)),
totals AS (SELECT model, count(*) AS n, sum(coalesce(tokens_in, 0)) AS ti, sum(coalesce(tokens_out, 0)) AS tokens FROM log GROUP BY 1)
SELECT model, n, CAST(printf('%.6f', (ti * coalesce(price_in, 0) + tokens * coalesce(price_out, 0)) / 1e6::DOUBLE / n) AS DOUBLE) AS cost_per_query_usd
FROM totals LEFT JOIN prices USING (model)""",
)
def cost_per_query(t: Tables) -> DataFrame:
    """Mean price per prediction and model."""
    prices = t.spark.createDataFrame(
        [(m, a, b) for m, (a, b) in _PRICES.items()], "model string, price_in double, price_out double"
    )
    return E.cost_per_query(roles.prediction_log(t), prices)


@query(
    "e4_report_lines",
    f"""
WITH {roles.OUTCOMES}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY model, runtime ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY model, runtime) AS c FROM outcome_rows)
SELECT model, runtime, set_name AS "set", count(*) AS n, CAST(printf('%.4f', count_if(ex)::DOUBLE / count(*)) AS DOUBLE) AS ex,
  CAST(printf('%.1f', max(latency_ms) FILTER (i = least(c - 1, CAST(floor(0.5 * c) AS BIGINT)))) AS DOUBLE) AS latency_ms_p50,
  CAST(printf('%.1f', max(latency_ms) FILTER (i = least(c - 1, CAST(floor(0.95 * c) AS BIGINT)))) AS DOUBLE) AS latency_ms_p95,
  CASE WHEN runtime = 'en' THEN 100 ELSE 0 END::INTEGER AS api_calls_per_100,
  CASE WHEN model = 'src1' THEN CAST(printf('%.6f', coalesce(sum(tokens_out), 0) * 0.6::DOUBLE / 1e6::DOUBLE / count(*)) AS DOUBLE) ELSE 0.0::DOUBLE END AS cost_per_query_usd
FROM ranked GROUP BY model, runtime, set_name""",
)
def report_lines(t: Tables) -> DataFrame:
    """Scores, latencies, API calls and cost of every run in one line."""
    rows = roles.outcome_rows(t)
    log = rows.withColumn("tokens_in", F.lit(None).cast("bigint"))
    prices = t.spark.createDataFrame([("src1", 0.15, 0.6)], "model string, price_in double, price_out double")
    return E.report_lines(rows, log, prices, ("en",)).select(
        "model", "runtime", "set", "n", "ex", "latency_ms_p50", "latency_ms_p95", "api_calls_per_100", "cost_per_query_usd"
    )


@query(
    "e7_first_failures",
    f"""
WITH {roles.OUTCOMES}
SELECT tag, min(id) AS id FROM outcome_rows WHERE NOT ex GROUP BY tag""",
)
def first_failures(t: Tables) -> DataFrame:
    """The first failing document of each tag."""
    return E.first_failures(roles.outcome_rows(t)).select("tag", "id")


@query(
    "e7_examples",
    f"""
WITH {roles.OUTCOMES}
SELECT id, model, difficulty FROM outcome_rows WHERE id IN (SELECT min(id) FROM outcome_rows WHERE ex GROUP BY model)""",
)
def examples(t: Tables) -> DataFrame:
    """One correct example per model, checked before it is shown."""
    rows = roles.outcome_rows(t)
    chosen = rows.filter("ex").groupBy("model").agg(F.min("id").alias("id")).select("id")
    return E.pick_examples(chosen, rows).select("id", "model", "difficulty")


@query(
    "e8_difficulty_by_runtime",
    f"""
WITH {roles.OUTCOMES}
SELECT difficulty, runtime, CAST(printf('%.4f', count_if(ex)::DOUBLE / count(*)) AS DOUBLE) AS ex FROM outcome_rows GROUP BY 1, 2""",
)
def difficulty_by_runtime(t: Tables) -> DataFrame:
    """EX per difficulty and language."""
    return E.comparison(roles.outcome_rows(t), "difficulty", "runtime")


@query(
    "e8_tags_by_runtime",
    f"WITH {roles.OUTCOMES} SELECT tag, runtime, count(*) AS failures FROM outcome_rows WHERE NOT ex GROUP BY 1, 2",
)
def tags_by_runtime(t: Tables) -> DataFrame:
    """Failures per tag and language."""
    return E.tag_matrix(roles.outcome_rows(t), "runtime")


@query(
    "e8_markdown_rows",
    f"""
WITH {roles.OUTCOMES}, s AS (
  SELECT set_name, model, runtime, CAST(printf('%.4f', count_if(ex)::DOUBLE / count(*)) AS DOUBLE) AS ex, CAST(printf('%.4f', count_if(valid)::DOUBLE / count(*)) AS DOUBLE) AS v
  FROM outcome_rows GROUP BY ALL)
SELECT '| ' || set_name || ' | ' || model || ' | ' || runtime || ' | ' || printf('%.1f', ex * 100) || '% | ' || printf('%.1f', v * 100) || '% |' AS line FROM s""",
)
def markdown_rows(t: Tables) -> DataFrame:
    """Score lines for a markdown table."""
    s = E.score_summary(roles.outcome_rows(t), ["set", "model", "runtime"])
    line = E.markdown_row(
        F.col("set"), F.col("model"), F.col("runtime"), percent(F.col("ex")), percent(F.col("valid_sql"))
    )
    return s.select(line.alias("line"))
