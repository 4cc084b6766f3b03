"""Registered queries: candidates, votes and decisions, with order lines as candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.operators import consensus as V
from pairlake.operators.positions import with_positions
from pairlake.plans import roles
from pairlake.plans.registry import Tables, query


def candidates(t: Tables) -> DataFrame:
    """Each line of an order is one candidate answer to the order's question."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    placed = with_positions(t.lineitem, ["l_orderkey"], order, "cand_ix")
    return placed.select(
        F.col("l_orderkey").alias("question_id"),
        "cand_ix",
        F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("model"),
        F.concat(
            F.lit("SELECT "), F.col("l_partkey").cast("string"), F.lit(" AS p, "),
            F.col("l_suppkey").cast("string"), F.lit(";"),
        ).alias("sql"),
        (F.col("l_linestatus") == "O").alias("ordered"),
        F.when(F.col("l_discount") < 0.08, F.concat("l_returnflag", F.col("l_tax").cast("string"))).alias("hash"),
        "l_quantity", "l_discount", "l_tax",
    )


CANDIDATES = """cands AS (
  SELECT l_orderkey AS question_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS cand_ix,
         'm' || l_linenumber AS model, 'SELECT ' || l_partkey || ' AS p, ' || l_suppkey || ';' AS sql,
         l_linestatus = 'O' AS ordered,
         CASE WHEN l_discount < 0.08 THEN l_returnflag || CAST(l_tax AS VARCHAR) END AS hash,
         l_quantity, l_discount, l_tax
  FROM lineitem)"""

VOTES = f"""{CANDIDATES},
grouped AS (
  SELECT question_id, ordered, hash, count(*) AS votes, min(cand_ix) AS seen FROM cands WHERE hash IS NOT NULL GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY votes DESC, seen) AS r FROM grouped),
best AS (
  SELECT c.question_id, c.sql, c.hash, row_number() OVER (PARTITION BY c.question_id ORDER BY length(c.sql), c.cand_ix) AS r
  FROM cands c JOIN ranked w ON c.question_id = w.question_id AND c.hash = w.hash AND c.ordered = w.ordered AND w.r = 1),
votes AS (
  SELECT q.question_id, q.valid, coalesce(w.votes, 0) AS votes,
         CASE WHEN w.votes >= 2 THEN b.sql END AS sql, CASE WHEN w.votes >= 2 THEN b.hash END AS result_hash
  FROM (SELECT question_id, count(hash) AS valid FROM cands GROUP BY 1) q
  LEFT JOIN ranked w ON w.question_id = q.question_id AND w.r = 1
  LEFT JOIN best b ON b.question_id = q.question_id AND b.r = 1)"""


def checked(t: Tables) -> DataFrame:
    """Candidates with the outcome of every check."""
    rows = candidates(t)
    return rows.select(
        "question_id", "cand_ix", "model", "ordered",
        F.when(F.col("l_quantity") == 1, "").otherwise(F.col("sql")).alias("sql"),
        F.when(F.col("l_quantity") == 2, "Binder Error").alias("error"),
        F.when(F.col("l_quantity") == 3, 0).otherwise(5).alias("n_rows"),
        (F.col("l_quantity") == 4).alias("all_null"),
        (F.col("l_quantity") != 5).alias("deterministic"),
        (F.col("l_quantity") == 6).alias("ties"),
        (F.col("l_quantity") == 7).alias("limit_without_order"),
        F.concat(F.lit("h"), F.col("l_tax").cast("string")).alias("hash"),
    )


PROBLEM = """CASE l_quantity WHEN 1 THEN 'missing' WHEN 2 THEN 'error' WHEN 3 THEN 'empty' WHEN 4 THEN 'all_null'
    WHEN 5 THEN 'nondeterministic' WHEN 6 THEN 'order_ties' WHEN 7 THEN 'limit_without_order' END"""


@query(
    "v1_candidate_evaluation",
    f"""
WITH {CANDIDATES}
SELECT question_id, cand_ix, {PROBLEM} AS problem,
       CASE WHEN {PROBLEM} IS NULL THEN 'h' || CAST(l_tax AS VARCHAR) END AS hash FROM cands""",
)
def candidate_evaluation(t: Tables) -> DataFrame:
    """Why candidates cannot vote, and the hashes of those that can."""
    return V.evaluate(checked(t)).select("question_id", "cand_ix", "problem", "hash")


@query("v2_self_consistency_vote", f"WITH {VOTES} SELECT * FROM votes")
def self_consistency_vote(t: Tables) -> DataFrame:
    """The shortest SQL of the largest group of equal results per order."""
    return V.vote(candidates(t))


def records(t: Tables) -> DataFrame:
    """Orders as questions: priority is the difficulty, status the database."""
    questions = t.orders.select(
        F.col("o_orderkey").alias("question_id"),
        F.col("o_orderstatus").alias("db_id"),
        F.when(F.col("o_totalprice") > 2000, F.col("o_orderpriority")).otherwise("").alias("question"),
        F.when(F.col("o_orderpriority").startswith("1"), "easy")
        .when(F.col("o_orderpriority").startswith("2"), "medium")
        .when(F.col("o_orderpriority").startswith("3"), "hard")
        .when(F.col("o_orderpriority").startswith("4"), "extra")
        .otherwise("unclear")
        .alias("difficulty"),
    )
    return V.decide(questions, V.vote(candidates(t)))


DECISIONS = f"""{VOTES},
questions AS (
  SELECT o_orderkey AS question_id, o_orderstatus AS db_id, o_totalprice > 2000 AS asked,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 'easy' WHEN '2' THEN 'medium' WHEN '3' THEN 'hard'
           WHEN '4' THEN 'extra' ELSE 'unclear' END AS difficulty FROM orders),
records AS (
  SELECT q.*, v.votes, CASE WHEN NOT asked OR difficulty = 'unclear' THEN 'bad_item' WHEN v.sql IS NOT NULL THEN 'agreed'
    WHEN coalesce(v.valid, 0) >= 2 THEN 'no_agreement' ELSE 'too_few_valid' END AS decision
  FROM questions q LEFT JOIN votes v USING (question_id))"""


@query("v3_decisions", f"WITH {DECISIONS} SELECT question_id, decision FROM records")
def decisions(t: Tables) -> DataFrame:
    """What became of every question."""
    return records(t).select("question_id", "decision")


@query(
    "v4_consensus_stats",
    f"""
WITH {DECISIONS}, kept AS (SELECT * FROM records WHERE decision = 'agreed' AND votes >= 3),
d AS (SELECT db_id, count(*) AS questions, """
    + ", ".join(f"count_if(decision = '{d}')::BIGINT AS {d}" for d in V.DECISIONS)
    + ", "
    + ", ".join(f"count_if(decision = 'agreed' AND votes = {v})::BIGINT AS votes_{v}" for v in (2, 3))
    + """ FROM records GROUP BY 1),
k AS (SELECT db_id, count(*) AS kept, """
    + ", ".join(f"count_if(difficulty = '{d}')::BIGINT AS {d}" for d in ("easy", "medium", "hard", "extra"))
    + """ FROM kept GROUP BY 1)
SELECT d.*, coalesce(kept, 0) AS kept, coalesce(easy, 0) AS easy, coalesce(medium, 0) AS medium, coalesce(hard, 0) AS hard,
       coalesce(extra, 0) AS extra, CAST(printf('%.4f', coalesce(kept, 0)::DOUBLE / questions) AS DOUBLE) AS kept_rate
FROM d LEFT JOIN k USING (db_id)""",
)
def consensus_stats(t: Tables) -> DataFrame:
    """Decisions, votes, kept rows and difficulties per database."""
    rows = records(t)
    return V.decision_stats(rows, rows.filter("decision = 'agreed' and votes >= 3"))


@query(
    "v4_model_stats",
    f"""
WITH {CANDIDATES}, judged AS (SELECT model, {PROBLEM} AS problem FROM cands)
SELECT model, count(*) AS candidates, count_if(problem IS NULL)::BIGINT AS valid, """
    + ", ".join(f"count_if(problem = '{p}')::BIGINT AS {p}" for p in V.PROBLEMS)
    + " FROM judged GROUP BY 1",
)
def model_stats(t: Tables) -> DataFrame:
    """Valid candidates and problems per model."""
    return V.model_stats(V.evaluate(checked(t)))


@query(
    "v4_usage",
    f"WITH {roles.LOG} SELECT model, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens FROM log GROUP BY 1",
)
def usage(t: Tables) -> DataFrame:
    """Calls and tokens per model."""
    return V.usage(roles.prediction_log(t).withColumn("tokens", F.col("tokens_in")))
