"""Registered queries: cascade, retry, parity, gate and regression checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.operators import release as G
from pairlake.operators import results as R
from pairlake.operators import scoring as E
from pairlake.plans import roles
from pairlake.plans.registry import Tables, query

PRICE_IN, PRICE_OUT = 0.15, 0.60

# --- cascade: each order is an item; its lines describe the three answers -----------------------


def _parts(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    local = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("set"),
        (F.col("o_orderstatus") != "P").alias("ran"),
        (F.col("o_totalprice") < 30000).alias("all_null"),
        (F.col("o_totalprice") > 150000).alias("ex"),
    )
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.min("l_quantity").alias("q"),
        F.max("l_tax").alias("tax"),
        F.sum("l_suppkey").alias("tokens_in"),
        F.sum("l_linenumber").cast("bigint").alias("tokens_out"),
    )
    sample = lines.select("id", (F.col("q") < 45).alias("sample_ran"), (F.col("tax") < 0.07).alias("sample_matched"))
    big = lines.select("id", (F.col("q") > 5).alias("big_ex"), "tokens_in", "tokens_out")
    return local, sample, big


CASCADE = f"""lines AS (
  SELECT l_orderkey AS id, min(l_quantity) AS q, max(l_tax) AS tax, sum(l_suppkey) AS ti, sum(l_linenumber) AS tk FROM lineitem GROUP BY 1),
cascade AS (
  SELECT o_orderkey AS id, o_orderpriority AS "set",
    CASE WHEN o_orderstatus = 'P' THEN 'error' WHEN o_totalprice < 30000 THEN 'empty'
      WHEN NOT coalesce(q < 45, FALSE) OR NOT coalesce(tax < 0.07, FALSE) THEN 'disagree' END AS reason,
    o_totalprice > 150000 AS local_ex, coalesce(q > 5, FALSE) AS big_ex,
    (coalesce(ti, 0) * {PRICE_IN}::DOUBLE + coalesce(tk, 0) * {PRICE_OUT}::DOUBLE) / 1e6::DOUBLE AS big_cost
  FROM orders LEFT JOIN lines ON id = o_orderkey)"""

SUMMARY = """
SELECT {keys} r.rule, count(*) AS n, CAST(printf('%.4f', count_if(NOT up)::DOUBLE / count(*)) AS DOUBLE) AS answered_locally,
  CAST(printf('%.4f', count_if(NOT up AND local_ex)::DOUBLE / nullif(count_if(NOT up), 0)) AS DOUBLE) AS local_precision,
  CAST(printf('%.4f', (count_if(NOT up AND local_ex) + count_if(up AND big_ex))::DOUBLE / count(*)) AS DOUBLE) AS ex,
  CAST(printf('%.4f', count_if(local_ex)::DOUBLE / count(*)) AS DOUBLE) AS local_ex, CAST(printf('%.4f', count_if(big_ex)::DOUBLE / count(*)) AS DOUBLE) AS big_ex,
  CAST(printf('%.1f', 100 * count_if(up)::DOUBLE / count(*)) AS DOUBLE) AS api_calls_per_100,
  CAST(printf('%.6f', sum(CAST(CASE WHEN up THEN big_cost ELSE 0.0 END AS DECIMAL(38,12)))::DOUBLE / count(*)) AS DOUBLE) AS cost_per_query_usd,
  count_if(up AND reason = 'error')::BIGINT AS escalated_error, count_if(up AND reason = 'empty')::BIGINT AS escalated_empty,
  count_if(up AND reason = 'disagree')::BIGINT AS escalated_disagree
FROM (SELECT *, reason IS NOT NULL AND (reason IN ('error', 'empty') OR rule = 'agree') AS up
      FROM cascade, (VALUES ('valid'), ('agree')) v(rule)) r
GROUP BY {keys} r.rule"""


@query("c1_escalation_reasons", f"WITH {CASCADE} SELECT id, reason FROM cascade")
def escalation_reasons(t: Tables) -> DataFrame:
    """Why each local answer would go to the large model."""
    return G.cascade_outcomes(*_parts(t), PRICE_IN, PRICE_OUT).select("id", "reason")


@query("c2_cascade_summary", f"WITH {CASCADE} {SUMMARY.format(keys='')}")
def cascade_summary(t: Tables) -> DataFrame:
    """Both rules over all items."""
    return G.cascade_summary(G.cascade_outcomes(*_parts(t), PRICE_IN, PRICE_OUT))


@query("c3_cascade_by_set", f"""WITH {CASCADE} {SUMMARY.format(keys='"set",')}""")
def cascade_by_set(t: Tables) -> DataFrame:
    """Both rules per set: local, sample and large answers joined by id."""
    return G.cascade_summary(G.cascade_outcomes(*_parts(t), PRICE_IN, PRICE_OUT), ["set"])


@query(
    "c4_retry_choice",
    f"""
WITH {roles.CHAT_PAIRS}, s AS (
  SELECT conv_id, turn, CASE WHEN length(question) < 150 THEN '' ELSE question END AS sql,
    CASE WHEN length(question) > 400 THEN 'Parser Error' END AS problem, sql AS sql2,
    CASE WHEN length(sql) > 600 THEN 'Binder Error' END AS problem2 FROM chat_pairs),
c AS (SELECT *, problem IS NOT NULL OR sql = '' AS retried FROM s)
SELECT conv_id, turn, retried, CASE WHEN retried AND (problem2 IS NULL OR sql = '') THEN sql2 ELSE sql END AS chosen_sql,
  CASE WHEN retried AND (problem2 IS NULL OR sql = '') THEN problem2 ELSE problem END AS chosen_problem FROM c""",
)
def retry_choice(t: Tables) -> DataFrame:
    """First and second samples of a question: which one is used."""
    samples = roles.chat_pairs(t).select(
        "conv_id",
        "turn",
        F.when(F.char_length("question") < 150, "").otherwise(F.col("question")).alias("sql"),
        F.when(F.char_length("question") > 400, "Parser Error").alias("problem"),
        F.col("sql").alias("sql2"),
        F.when(F.char_length("sql") > 600, "Binder Error").alias("problem2"),
    )
    return G.retry_choice(samples).select("conv_id", "turn", "retried", "chosen_sql", "chosen_problem")


@query(
    "c5_artifact_parity",
    """
WITH p AS (
  SELECT c_custkey, c_mktsegment AS candidate, c_acctbal > 0 AS ref_ran, c_nationkey > 3 AS cand_ran,
    CASE WHEN c_acctbal > 5000 THEN c_name ELSE ' ' || c_name || ' ' END AS ref_sql,
    CASE WHEN c_nationkey > 10 THEN c_name ELSE upper(c_name) END AS cand_sql FROM customer),
a AS (SELECT o_custkey, list_sort(list(o_totalprice)) AS xs FROM orders GROUP BY 1),
b AS (SELECT o_custkey, list_sort(list(o_totalprice)) AS xs FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
m AS (SELECT c_custkey, coalesce(a.xs = b.xs, a.xs IS NULL AND b.xs IS NULL) AS matched
      FROM customer LEFT JOIN a ON a.o_custkey = c_custkey LEFT JOIN b ON b.o_custkey = c_custkey)
SELECT candidate, count(*) AS n, count_if(trim(ref_sql) = trim(cand_sql))::BIGINT AS same_output,
  count_if((NOT ref_ran AND NOT cand_ran) OR (ref_ran AND cand_ran AND matched))::BIGINT AS same_result,
  count_if(trim(ref_sql) = trim(cand_sql)) >= 18 AS passed
FROM p JOIN m USING (c_custkey) GROUP BY 1""",
)
def artifact_parity(t: Tables) -> DataFrame:
    """Same text and same result for each customer's orders, with and without open ones."""
    qid = F.col("o_custkey").cast("string")
    lines = R.result_rows(t.orders, qid, "a", columns=["o_totalprice"]).unionByName(
        R.result_rows(t.orders.filter("o_orderstatus <> 'P'"), qid, "b", columns=["o_totalprice"])
    )
    asked = t.customer.select(F.col("c_custkey").cast("string").alias("query_id"), F.lit(False).alias("ordered"))
    verdicts = R.results_match(lines, asked).select("query_id", "matched")
    rows = t.customer.select(
        F.col("c_custkey").cast("string").alias("query_id"),
        F.col("c_mktsegment").alias("candidate"),
        (F.col("c_acctbal") > 0).alias("ref_ran"),
        (F.col("c_nationkey") > 3).alias("cand_ran"),
        F.when(F.col("c_acctbal") > 5000, F.col("c_name")).otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit(" "))).alias("ref_sql"),
        F.when(F.col("c_nationkey") > 10, F.col("c_name")).otherwise(F.upper("c_name")).alias("cand_sql"),
    )
    return G.parity(rows.join(verdicts, "query_id"), ["candidate"])


# --- gate: sources are models, languages are runtimes -------------------------------------------


def scores(t: Tables) -> DataFrame:
    s = E.score_summary(roles.outcome_rows(t), ["model", "runtime", "set"])
    return s.select("model", "runtime", "set", "ex", "missing")


def _number() -> Column:
    return F.substring("model", 4, 9).cast("int")


def registry(t: Tables) -> DataFrame:
    """src0–src4 are base models, src5–src9 their exports, the others fine-tuned runs."""
    models = t.documents.select(F.col("source").alias("model")).distinct()
    family = F.concat(F.lit("src"), F.pmod(_number(), F.lit(5)).cast("string"))
    return models.select(
        "model",
        F.when(_number() >= 5, family).alias("base"),
        F.when(_number() >= 10, F.concat(F.lit("v"), _number().cast("string"))).alias("run_id"),
    )


REGISTRY = f"""{roles.OUTCOMES},
scores AS (
  SELECT model, runtime, set_name AS "set", CAST(printf('%.4f', count_if(ex)::DOUBLE / count(*)) AS DOUBLE) AS ex, count_if(missing)::BIGINT AS missing
  FROM outcome_rows GROUP BY ALL),
registry AS (
  SELECT DISTINCT source AS model, CAST(substr(source, 4) AS INTEGER) AS k,
    CASE WHEN k >= 5 THEN 'src' || (k % 5) END AS base, CASE WHEN k >= 10 THEN 'v' || k END AS run_id FROM documents),
floors AS (
  SELECT coalesce(base, s.model) AS base, runtime, max(ex) AS floor FROM scores s JOIN registry r ON r.model = s.model
  WHERE run_id IS NULL GROUP BY ALL)"""


@query("c6_base_floor", f"WITH {REGISTRY} SELECT * FROM floors")
def base_floor(t: Tables) -> DataFrame:
    """Best EX of every base model per runtime."""
    return G.base_floor(scores(t), registry(t), "docs")


def _gate_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    runs = registry(t).filter("run_id is not null").select("model")
    previous = scores(t).filter("model = 'src1' and runtime <> 'de'").select(
        "runtime", F.col("ex").alias("prev_ex")
    )
    # Every fine-tuned model must be scored in every runtime that ships; one line lists them.
    shipped = t.documents.filter("lang <> 'es'").agg(F.collect_set("lang").alias("runtimes"))
    every = F.lit(1).alias("one")
    required = runs.select("model", every).join(shipped.select("runtimes", every), "one")
    required = required.select("model", F.explode("runtimes").alias("runtime"))
    return required, previous


@query(
    "c7_release_gate",
    f"""
WITH {REGISTRY},
previous AS (SELECT runtime, ex AS prev_ex FROM scores WHERE model = 'src1' AND runtime <> 'de'),
required AS (SELECT model, base, runtime FROM registry, (SELECT DISTINCT lang AS runtime FROM documents WHERE lang <> 'es') WHERE run_id IS NOT NULL),
g AS (
  SELECT q.model, q.base, q.runtime, s.ex, s.ex IS NOT NULL AND s.missing = 0 AS complete, floor, prev_ex,
    concat_ws(', ', CASE WHEN s.ex < floor THEN 'base' END, CASE WHEN s.ex < prev_ex THEN 'previous release' END) AS failed
  FROM required q LEFT JOIN scores s ON s.model = q.model AND s.runtime = q.runtime
  LEFT JOIN floors f ON f.base = q.base AND f.runtime = q.runtime LEFT JOIN previous p ON p.runtime = q.runtime),
lines AS (
  SELECT model, runtime, complete AND floor IS NOT NULL AND failed = '' AS ok,
    CASE WHEN NOT complete THEN runtime || ': FAIL (no complete docs predictions)'
      WHEN floor IS NULL THEN runtime || ': FAIL (no docs result for ' || base || ' here)'
      ELSE runtime || ': EX ' || printf('%.1f', ex * 100) || '% vs base ' || printf('%.1f', floor * 100) || '%'
        || CASE WHEN prev_ex IS NULL THEN '' ELSE ', previous release ' || printf('%.1f', prev_ex * 100) || '%' END
        || ': ' || CASE WHEN failed = '' THEN 'ok' ELSE 'FAIL (below ' || failed || ')' END END AS message FROM g)
SELECT *, bool_and(ok) OVER (PARTITION BY model) AS passed FROM lines""",
)
def release_gate(t: Tables) -> DataFrame:
    """Every fine-tuned run against its base model and the previous release."""
    required, previous = _gate_inputs(t)
    return G.release_gate(required, scores(t), registry(t), previous, "docs")


@query(
    "c8_baseline_record",
    f"""
WITH {REGISTRY}
SELECT "set", string_agg(runtime || '=' || printf('%.4f', ex), ',' ORDER BY runtime) AS ex FROM scores WHERE model = 'src11' GROUP BY 1""",
)
def baseline_record(t: Tables) -> DataFrame:
    """The recorded EX of an accepted model."""
    record = G.baseline_record(scores(t), "src11", ["docs"])
    shown = F.transform(
        F.array_sort(F.map_entries("ex")),
        lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"])),
    )
    return record.select("set", F.array_join(shown, ",").alias("ex"))


@query(
    "c9_regression_check",
    f"""
WITH {REGISTRY},
want AS (SELECT model, "set", runtime, ex + 0.03 * (model = 'src3')::INT + 0.01 * (model = 'src4')::INT AS want FROM scores WHERE runtime <> 'fr')
SELECT s.model, s."set", s.runtime, s.ex, w.want,
  w.want IS NOT NULL AND s.missing = 0 AND s.ex >= w.want - 0.02 AS ok
FROM scores s LEFT JOIN want w ON w.model = s.model AND w.runtime = s.runtime AND w."set" = s."set" """,
)
def regression_check(t: Tables) -> DataFrame:
    """Fresh scores against a recorded baseline with a tolerance of two points."""
    fresh = scores(t)
    bump = F.when(F.col("model") == "src3", 0.03).when(F.col("model") == "src4", 0.01).otherwise(0.0)
    baseline = fresh.filter("runtime <> 'fr'").select("model", "set", "runtime", (F.col("ex") + bump).alias("want"))
    return G.regression_check(fresh, baseline)
