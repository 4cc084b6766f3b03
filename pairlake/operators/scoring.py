"""Prediction logs: outcomes, error tags, score summaries, latency and cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlake.functions.numbers import exact_round
from pairlake.functions.sqltext import DATE_FUNCTIONS, bind, query_shape
from pairlake.functions.text import clean_sql, normalize_sql
from pairlake.operators.results import DIFFICULTIES

# Error tags in report order, accepted first words.
TAGS = (
    "wrong column or table",
    "join error",
    "aggregation",
    "date/time functions",
    "dialect error",
    "hallucinated schema",
    "formatting",
    "other",
)
SQL_START = ("select", "with", "from", "(", "values")


def outcomes(
    items: DataFrame, predictions: DataFrame, verdicts: DataFrame, run: Sequence[str] = ()
) -> DataFrame:
    """One line per item and run: ``valid``, ``ex``, ``exact``, and whether it is missing.

    ``items``: ``id, difficulty, gold_sql``; ``predictions``: ``id, sql, latency_ms,
    tokens_out``; ``verdicts``: ``id, ran, matched, error`` for predictions that were run.
    ``run`` names the columns that tell runs apart in predictions and verdicts. Those that
    items have too (a test set) say which items a run has to answer; at least one must.
    """
    run = list(run)
    if run:
        runs = predictions.select(*run).distinct()
        items = items.join(runs, [c for c in run if c in items.columns])
    keys = ["id", *run]
    sql = clean_sql(F.coalesce("sql", F.lit("")))
    joined = (
        items.join(predictions.withColumn("_found", F.lit(True)), keys, "left")
        .join(verdicts, keys, "left")
        .withColumn("sql", sql)
    )
    valid = (F.col("sql") != "") & F.coalesce("ran", F.lit(False))
    return joined.select(
        *items.columns,
        "sql",
        valid.alias("valid"),
        (valid & F.coalesce("matched", F.lit(False))).alias("ex"),
        (normalize_sql(F.col("sql")) == normalize_sql(F.col("gold_sql"))).alias("exact"),
        "error",
        "latency_ms",
        "tokens_out",
        F.col("_found").isNull().alias("missing"),
    )


def stable_verdict(hash_matches: Column, tie_dependent: Column) -> Column:
    """``ok``, ``reran`` (gold depends on ties, so its fresh result counts) or ``stale``."""
    return F.when(hash_matches, "ok").when(tie_dependent, "reran").otherwise("stale")


def message_tag(error: Column) -> Column:
    """The error tag that an engine's message implies."""
    low = F.lower(error)
    dated = F.lit(False)
    for name in DATE_FUNCTIONS:
        dated = dated | low.contains(name)
    return (
        F.when(low.contains("parser error") | low.contains("[parse_syntax_error]"), "dialect error")
        .when(low.contains("ambiguous reference") | low.contains("[ambiguous_reference]"), "join error")
        .when(
            low.contains("[unresolved_column") | low.contains("[table_or_view_not_found]"),
            "hallucinated schema",
        )
        .when(low.contains("[missing_aggregation]") | low.contains("[missing_group_by]"), "aggregation")
        .when(
            low.contains("table with name")
            | (low.contains("binder error") & low.contains("not found")),
            "hallucinated schema",
        )
        .when(
            low.contains("does not have a column") | low.contains("referenced column"),
            "hallucinated schema",
        )
        .when(low.contains("group by") | low.contains("aggregate"), "aggregation")
        .when(low.contains("function") & dated, "date/time functions")
        .otherwise("dialect error")
    )


def error_tag(sql: Column, error: Column, gold_sql: Column, n_cols: Column) -> Column:
    """Why a wrong answer is wrong: text, message, then the shapes of both queries."""
    low = F.lower(F.coalesce(sql, F.lit("")))
    starts = F.lit(False)
    for word in SQL_START:
        starts = starts | low.startswith(word)

    def differ(a: Column, b: Column) -> Column:
        return (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)

    def by_shape(both: Column) -> Column:
        mine, gold = both["mine"], both["gold"]
        return (
            F.when(differ(mine["tables"], gold["tables"]), "wrong column or table")
            .when(
                n_cols.isNotNull() & gold["columns"].isNotNull() & (n_cols != gold["columns"]),
                "wrong column or table",
            )
            .when(mine["joins"] != gold["joins"], "join error")
            .when(
                differ(mine["aggregates"], gold["aggregates"])
                | (mine["grouped"] != gold["grouped"]),
                "aggregation",
            )
            .when(differ(mine["dates"], gold["dates"]), "date/time functions")
            .otherwise("other")
        )

    shapes = F.struct(query_shape(sql).alias("mine"), query_shape(gold_sql).alias("gold"))
    return (
        F.when(~starts, "formatting")
        .when(error.isNotNull(), message_tag(error))
        .otherwise(bind(shapes, by_shape))
    )


def _mean(flag: str) -> Column:
    return exact_round(F.count_if(F.col(flag)) / F.count(F.lit(1)), 4)


def score_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and means per run, EX per difficulty, one count per error tag."""
    sizes = [F.count_if(F.col("difficulty") == d).alias(f"n_{d}") for d in DIFFICULTIES]
    by_difficulty = [
        exact_round(
            F.try_divide(
                F.count_if((F.col("difficulty") == d) & F.col("ex")),
                F.count_if(F.col("difficulty") == d),
            ),
            4,
        ).alias(f"ex_{d}")
        for d in DIFFICULTIES
    ]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("missing").alias("missing"),
        _mean("ex").alias("ex"),
        _mean("valid").alias("valid_sql"),
        _mean("exact").alias("exact_match"),
        exact_round(F.avg("tokens_out"), 1).alias("tokens_out_mean"),
        *sizes,
        *by_difficulty,
        *[F.count_if(~F.col("ex") & (F.col("tag") == t)).alias(f"tag: {t}") for t in TAGS],
    )


def latency_percentiles(
    rows: DataFrame, keys: Sequence[str], latency: str = "latency_ms"
) -> DataFrame:
    """The value at ``min(n - 1, int(q * n))`` of the sorted latencies, one decimal.

    Rounding keeps the order, so it comes first: the window then runs over counts per
    tenth of a millisecond instead of over all rows, at most 36 million lines for a run whose
    slowest answer took an hour.
    """
    counts = (
        rows.filter(F.col(latency).isNotNull())
        .groupBy(*keys, exact_round(F.col(latency), 1).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    by_value = Window.partitionBy(*keys).orderBy("_value")
    spread = counts.withColumn("_upto", F.sum("_n").over(by_value)).withColumn(
        "_total", F.sum("_n").over(Window.partitionBy(*keys))
    )

    def at(q: float) -> Column:
        index = F.least(F.col("_total") - 1, F.floor(F.lit(q) * F.col("_total")))
        hit = (index < F.col("_upto")) & (index >= F.col("_upto") - F.col("_n"))
        return F.max(F.when(hit, F.col("_value")))

    return spread.groupBy(*keys).agg(
        at(0.5).alias("latency_ms_p50"), at(0.95).alias("latency_ms_p95")
    )


def _cost() -> Column:
    """Mean price of a run from its token sums; no price means free."""
    spent = F.col("_in") * F.coalesce("price_in", F.lit(0.0)) + F.col("_out") * F.coalesce(
        "price_out", F.lit(0.0)
    )
    return exact_round(spent / 1e6 / F.col("_n"), 6)


def cost_per_query(predictions: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Mean price per prediction in USD; models without a price cost nothing.

    ``prices``: ``model, price_in, price_out`` per million tokens.
    """
    totals = predictions.groupBy(model).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.coalesce("tokens_in", F.lit(0))).alias("_in"),
        F.sum(F.coalesce("tokens_out", F.lit(0))).alias("_out"),
    )
    return totals.join(prices, model, "left").select(
        model, F.col("_n").alias("n"), _cost().alias("cost_per_query_usd")
    )


def report_lines(
    rows: DataFrame,
    predictions: DataFrame,
    prices: DataFrame,
    api_runtimes: Sequence[str] = (),
    keys: Sequence[str] = ("model", "runtime", "set"),
) -> DataFrame:
    """The whole report line of every run: scores, latencies, calls to an API, cost."""
    keys = list(keys)
    runs = predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.coalesce("tokens_in", F.lit(0))).alias("_in"),
        F.sum(F.coalesce("tokens_out", F.lit(0))).alias("_out"),
    )
    priced = runs.join(prices, "model", "left").select(*keys, _cost().alias("cost_per_query_usd"))
    calls = F.when(F.col("runtime").isin(*api_runtimes), 100).otherwise(0) if api_runtimes else F.lit(0)
    return (
        score_summary(rows, keys)
        .join(latency_percentiles(rows, keys), keys, "left")
        .join(priced, keys, "left")
        .withColumn("cost_per_query_usd", F.coalesce("cost_per_query_usd", F.lit(0.0)))
        .withColumn("api_calls_per_100", calls)
    )


def first_failures(rows: DataFrame, order: str = "id", tag: str = "tag") -> DataFrame:
    """The first failing row of each error tag."""
    failed = rows.filter(~F.col("ex"))
    firsts = failed.groupBy(tag).agg(F.min_by(F.struct(*failed.columns), order).alias("_row"))
    return firsts.select("_row.*")


def wrong_examples(chosen: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Chosen examples that are not answered correctly; must be empty before publishing."""
    return chosen.join(rows.filter("ex"), key, "left_anti")


def pick_examples(chosen: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The outcomes of the chosen examples; raises if any of them is wrong."""
    wrong = wrong_examples(chosen, rows, key).limit(5).collect()
    if wrong:
        raise ValueError(f"not answered correctly: {[r[key] for r in wrong]}")
    return rows.join(chosen.select(key).distinct(), key, "left_semi")


def comparison(rows: DataFrame, row: str, column: str) -> DataFrame:
    """EX per (row, column), one line per cell: whatever values there are show up."""
    cells = rows.groupBy(row, column).agg(
        F.count_if("ex").alias("_ok"), F.count(F.lit(1)).alias("_n")
    )
    return cells.select(row, column, exact_round(F.col("_ok") / F.col("_n"), 4).alias("ex"))


def tag_matrix(rows: DataFrame, column: str = "model") -> DataFrame:
    """Failures per error tag and model, one line per cell that has any."""
    return rows.filter(~F.col("ex")).groupBy("tag", column).agg(F.count(F.lit(1)).alias("failures"))


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in cells]), F.lit(" |"))
