"""Cascades between a small and a large model, export parity, and the release gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.functions.numbers import exact_round, percent

# Which reasons escalate under which rule, gate tolerances.
RULES = {"valid": ("error", "empty"), "agree": ("error", "empty", "disagree")}
TOLERANCE = 0.02
MIN_MATCH = 18


def escalation_reason(
    ran: Column, all_null: Column, sample_ran: Column, sample_matched: Column
) -> Column:
    """Why a local answer goes to the large model: error, empty, disagree or NULL."""
    return (
        F.when(~F.coalesce(ran, F.lit(False)), "error")
        .when(all_null, "empty")
        .when(
            ~F.coalesce(sample_ran, F.lit(False)) | ~F.coalesce(sample_matched, F.lit(False)),
            "disagree",
        )
    )


def cascade_outcomes(
    local: DataFrame, sample: DataFrame, big: DataFrame, price_in: float, price_out: float
) -> DataFrame:
    """``id, reason, local_ex, big_ex, big_cost`` per item.

    ``local``: ``id, ran, all_null, ex``; ``sample``: ``id, sample_ran, sample_matched``;
    ``big``: ``id, big_ex, tokens_in, tokens_out``.
    """
    reason = escalation_reason(
        F.col("ran"), F.col("all_null"), F.col("sample_ran"), F.col("sample_matched")
    )
    tokens = F.coalesce("tokens_in", F.lit(0)) * F.lit(price_in) + F.coalesce(
        "tokens_out", F.lit(0)
    ) * F.lit(price_out)
    return (
        local.join(sample, "id", "left")
        .join(big, "id", "left")
        .select(
            *[c for c in local.columns if c not in ("ran", "all_null", "ex")],
            reason.alias("reason"),
            F.col("ex").alias("local_ex"),
            F.coalesce("big_ex", F.lit(False)).alias("big_ex"),
            (tokens / 1e6).alias("big_cost"),
        )
    )


def cascade_summary(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Both rules per key: local share and precision, combined EX, calls and cost."""
    rules = F.explode(
        F.array(
            *[
                F.struct(F.lit(r).alias("rule"), F.array(*[F.lit(x) for x in reasons]).alias("up"))
                for r, reasons in RULES.items()
            ]
        )
    )
    up = F.coalesce(F.array_contains("_rule.up", F.col("reason")), F.lit(False))
    n = F.count(F.lit(1))
    n_local, n_up = F.count_if(~F.col("_up")), F.count_if("_up")
    local_right = F.count_if(~F.col("_up") & F.col("local_ex"))
    big_right = F.count_if(F.col("_up") & F.col("big_ex"))
    # Costs are summed as exact decimals, so the order of the rows does not matter.
    cost = F.sum(F.when(F.col("_up"), F.col("big_cost")).otherwise(0.0).cast("decimal(38,12)"))
    return (
        rows.withColumn("_rule", rules)
        .withColumn("_up", F.when(F.col("reason").isNull(), F.lit(False)).otherwise(up))
        .groupBy(*keys, F.col("_rule.rule").alias("rule"))
        .agg(
            n.alias("n"),
            exact_round(n_local / n, 4).alias("answered_locally"),
            exact_round(F.try_divide(local_right, n_local), 4).alias("local_precision"),
            exact_round((local_right + big_right) / n, 4).alias("ex"),
            exact_round(F.count_if("local_ex") / n, 4).alias("local_ex"),
            exact_round(F.count_if("big_ex") / n, 4).alias("big_ex"),
            exact_round(100 * n_up / n, 1).alias("api_calls_per_100"),
            exact_round(cost.cast("double") / n, 6).alias("cost_per_query_usd"),
            *[
                F.count_if(F.col("_up") & (F.col("reason") == r)).alias(f"escalated_{r}")
                for r in RULES["agree"]
            ],
        )
    )


def retry_choice(samples: DataFrame) -> DataFrame:
    """Take the second sample when the first fails and the second runs (or the first is empty).

    ``samples``: ``sql, problem, sql2, problem2``; NULL problems mean the SQL is fine.
    """
    retried = F.col("problem").isNotNull() | (F.coalesce("sql", F.lit("")) == "")
    second = retried & (F.col("problem2").isNull() | (F.coalesce("sql", F.lit("")) == ""))
    return (
        samples.withColumn("retried", retried)
        .withColumn("chosen_sql", F.when(second, F.col("sql2")).otherwise(F.col("sql")))
        .withColumn("chosen_problem", F.when(second, F.col("problem2")).otherwise(F.col("problem")))
    )


def parity(rows: DataFrame, keys: Sequence[str] = (), min_match: int = MIN_MATCH) -> DataFrame:
    """Same output text and same result per candidate run, and whether the gate holds.

    ``rows``: ``ref_sql, cand_sql, ref_ran, cand_ran, matched``. Two failing queries count
    as the same result.
    """
    same_text = F.trim("ref_sql") == F.trim("cand_sql")
    both_failed = ~F.col("ref_ran") & ~F.col("cand_ran")
    both_ran = F.col("ref_ran") & F.col("cand_ran") & F.coalesce("matched", F.lit(False))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(same_text).alias("same_output"),
        F.count_if(both_failed | both_ran).alias("same_result"),
        (F.count_if(same_text) >= min_match).alias("passed"),
    )


def base_floor(results: DataFrame, registry: DataFrame, test_set: str) -> DataFrame:
    """Best EX of each base model per runtime, over the base itself and its plain exports.

    ``registry``: ``model, base, run_id``; a ``run_id`` marks a fine-tuned run.
    """
    family = registry.select(
        "model",
        F.when(F.col("base").isNull(), F.col("model"))
        .when(F.col("run_id").isNull(), F.col("base"))
        .alias("base"),
    ).filter(F.col("base").isNotNull())
    scored = results.filter(F.col("set") == test_set).join(family, "model")
    return scored.groupBy("base", "runtime").agg(F.max("ex").alias("floor"))


def release_gate(
    candidates: DataFrame,
    results: DataFrame,
    registry: DataFrame,
    previous: DataFrame,
    test_set: str,
) -> DataFrame:
    """One verdict per required runtime of each candidate, and whether the candidate passes.

    ``candidates``: ``model, runtime`` (every runtime that ships); ``previous``:
    ``runtime, prev_ex`` of the last release.
    """
    floors = base_floor(results, registry, test_set)
    own = results.filter(F.col("set") == test_set).select("model", "runtime", "ex", "missing")
    joined = (
        candidates.join(registry.select("model", F.col("base")), "model", "left")
        .join(own, ["model", "runtime"], "left")
        .join(floors, ["base", "runtime"], "left")
        .join(previous, "runtime", "left")
    )
    complete = F.col("ex").isNotNull() & (F.coalesce("missing", F.lit(0)) == 0)
    below_base = F.col("ex") < F.col("floor")
    below_prev = F.coalesce(F.col("ex") < F.col("prev_ex"), F.lit(False))
    failed = F.concat_ws(
        ", ", F.when(below_base, F.lit("base")), F.when(below_prev, F.lit("previous release"))
    )
    versus = F.concat_ws(
        ", ",
        F.concat(F.lit("base "), percent(F.col("floor"))),
        F.when(
            F.col("prev_ex").isNotNull(),
            F.concat(F.lit("previous release "), percent(F.col("prev_ex"))),
        ),
    )
    ok = complete & F.col("floor").isNotNull() & (failed == "")
    message = (
        F.when(
            ~complete,
            F.concat(F.col("runtime"), F.lit(f": FAIL (no complete {test_set} predictions)")),
        )
        .when(
            F.col("floor").isNull(),
            F.concat(
                F.col("runtime"), F.lit(f": FAIL (no {test_set} result for "),
                F.coalesce("base", F.lit("its base")), F.lit(" here)"),
            ),
        )
        .otherwise(
            F.concat(
                F.col("runtime"), F.lit(": EX "), percent(F.col("ex")), F.lit(" vs "), versus,
                F.lit(": "),
                F.when(failed == "", F.lit("ok")).otherwise(
                    F.concat(F.lit("FAIL (below "), failed, F.lit(")"))
                ),
            )
        )
    )
    lines = joined.select(
        "model", "runtime", F.coalesce(ok, F.lit(False)).alias("ok"), message.alias("message")
    )
    verdict = lines.groupBy("model").agg(F.every("ok").alias("passed"))
    return lines.join(verdict, "model")


def baseline_record(results: DataFrame, model: str, sets: Sequence[str]) -> DataFrame:
    """``set → {runtime: EX}`` of the accepted model."""
    mine = results.filter((F.col("model") == model) & F.col("set").isin(*sets))
    return mine.groupBy("set").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("runtime", "ex")))).alias("ex")
    )


def regression_check(
    fresh: DataFrame, baseline: DataFrame, tolerance: float = TOLERANCE
) -> DataFrame:
    """Fresh scores against recorded ones: complete, and not more than ``tolerance`` lower.

    ``baseline``: ``model, set, runtime, want``.
    """
    ok = (F.coalesce("missing", F.lit(0)) == 0) & (F.col("ex") >= F.col("want") - tolerance)
    return fresh.join(baseline, ["model", "set", "runtime"], "left").select(
        "model",
        "set",
        "runtime",
        "ex",
        "want",
        F.when(F.col("want").isNull(), F.lit(False)).otherwise(ok).alias("ok"),
    )
