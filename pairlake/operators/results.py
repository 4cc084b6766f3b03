"""Query results held as long tables: compare, hash, audit and chart them.

A results table has one line per result row: ``query_id, side, row_ix, cells``. ``row_ix``
counts 0, 1, 2, … for ordered results; unordered ones may leave it NULL. Queries with no
rows have no lines, so every verdict starts from a ``queries`` table (``query_id``, and
``ordered`` where order matters).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlake.functions.cells import row_cells, row_key, row_text, same_row
from pairlake.operators.positions import (
    first_per_group,
    with_copy_positions,
    with_positions,
)
from pairlake.session import cut

MAX_ROWS = 500
HASH_CHARS = 16


# The sums over rows that make up a result's hash: 32-bit slices of the row digests.
SLICES = 4


def _slice(digest: Column, number: int) -> Column:
    """32 bits of a hex digest; sums of two thousand million rows fit a BIGINT."""
    return F.conv(F.substring(digest, 8 * number + 1, 8), 16, 10).cast("bigint")


def result_rows(
    df: DataFrame,
    query_id: str | Column,
    side: str = "a",
    order: Sequence[Column | str] | None = None,
    columns: list[str] | None = None,
    numeric_text: bool = True,
) -> DataFrame:
    """``df`` as lines of a results table; ``order`` fixes ``row_ix`` for ordered results."""
    qid = F.lit(query_id) if isinstance(query_id, str) else query_id
    cells = row_cells(df, columns, numeric_text)
    rows = df.withColumn("_qid", qid).withColumn("_cells", cells)
    if order is None:
        rows = rows.withColumn("_ix", F.lit(None).cast("bigint"))
    else:
        rows = with_positions(rows, ["_qid"], order, "_ix").withColumn("_ix", F.col("_ix") - 1)
    return rows.select(
        F.col("_qid").alias("query_id"),
        F.lit(side).alias("side"),
        F.col("_ix").alias("row_ix"),
        F.col("_cells").alias("cells"),
    )


def sorted_rows(results: DataFrame) -> DataFrame:
    """Multiset order: ``rn`` numbers each result's rows by canonical key."""
    keyed = results.select("query_id", "side", row_key(F.col("cells")).alias("_key"), "cells")
    placed = with_copy_positions(keyed, ["query_id", "side"], ["_key", "cells"], "rn")
    # The rebuilt array keeps Spark from pruning single fields of ``cells`` through the two
    # explodes before it, which its planner (4.1) gets wrong.
    return placed.drop("_key").withColumn("cells", F.transform("cells", lambda c: c))


def results_match(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Do sides ``a`` and ``b`` agree? → ``query_id, n_a, n_b, matched``.

    Slices of the row digests are added up per query, one side positive and the other
    negative, where the rows are read: a line per task and query is shuffled, not one per
    row, and a single huge result spreads over all tasks. Only results with equal counts
    but other sums than zero are sorted and compared row by row within the tolerance.
    """
    has_nan = F.exists(F.col("cells"), lambda c: F.coalesce(F.isnan(c["num"]), F.lit(False)))
    sign = F.when(F.col("side") == "a", 1).otherwise(-1)
    # Only digests are added up; cells are read again for the queries that stay open.
    text = F.coalesce(row_text(F.col("cells")), F.lit(""))
    placed = F.md5(F.concat(F.col("row_ix").cast("string"), F.lit("#"), text))  # null without a place
    digests = results.select(
        "query_id", "side", sign.alias("_sign"), F.md5(text).alias("_row"), placed.alias("_placed"), has_nan.alias("_has_nan")
    )
    slices = range(SLICES)
    moved = [_slice(F.col("_placed"), k) - _slice(F.col("_row"), k) for k in slices]
    # One line per query before the queries say whether places count.
    sums = digests.groupBy("query_id").agg(
        F.count_if(F.col("side") == "a").alias("_a"),
        F.count_if(F.col("side") == "b").alias("_b"),
        F.max("_has_nan").alias("_nan"),
        *[F.sum(F.col("_sign") * _slice(F.col("_row"), k)).alias(f"_plain{k}") for k in slices],
        *[F.sum(F.col("_sign") * moved[k]).alias(f"_moved{k}") for k in slices],
    )
    same = F.lit(True)
    for k in slices:
        more = F.when(F.col("ordered"), F.coalesce(f"_moved{k}", F.lit(0))).otherwise(F.lit(0))
        same = same & (F.col(f"_plain{k}") + more == 0)
    verdicts = (
        sums.join(queries.select("query_id", "ordered"), "query_id")
        .groupBy("query_id")
        .agg(
            F.sum("_a").alias("n_a"),
            F.sum("_b").alias("n_b"),
            F.max("_nan").alias("_nan"),
            F.every(same).alias("_same_keys"),
        )
    )
    zero = F.lit(0).cast("bigint")
    known = cut(
        queries.select("query_id", "ordered")
        .join(verdicts, "query_id", "left")
        .select(
            "query_id",
            "ordered",
            F.coalesce("n_a", zero).alias("n_a"),
            F.coalesce("n_b", zero).alias("n_b"),
            F.coalesce("_nan", F.lit(False)).alias("_nan"),
            F.coalesce("_same_keys", F.lit(True)).alias("_same_keys"),
        )
    )
    counted = (F.col("n_a") == F.col("n_b")) & ~F.col("_nan")
    # Written on their own: where they are few, the lines of the others do not move.
    open_queries = cut(known.filter(counted & ~F.col("_same_keys")).select("query_id", "ordered"))
    close = _match_by_position(results, open_queries)
    return known.join(close, "query_id", "left").select(
        "query_id",
        "n_a",
        "n_b",
        (counted & (F.col("_same_keys") | F.coalesce("_close", F.lit(False)))).alias("matched"),
    )


def _match_by_position(results: DataFrame, open_queries: DataFrame) -> DataFrame:
    if open_queries.isEmpty():
        return open_queries.select("query_id", F.lit(False).alias("_close"))
    lines = results.join(open_queries, "query_id")
    unordered = sorted_rows(lines.filter(~F.col("ordered"))).withColumnRenamed("rn", "pos")
    ordered = lines.filter("ordered").select(
        "query_id", "side", "cells", F.col("row_ix").alias("pos")
    )
    pairs = (
        unordered.unionByName(ordered)
        .groupBy("query_id", "pos")
        .agg(
            F.max(F.when(F.col("side") == "a", F.col("cells"))).alias("_a"),
            F.max(F.when(F.col("side") == "b", F.col("cells"))).alias("_b"),
        )
    )
    return pairs.groupBy("query_id").agg(
        F.every(F.coalesce(same_row(F.col("_a"), F.col("_b")), F.lit(False))).alias("_close")
    )


def result_hash(results: DataFrame, queries: DataFrame) -> DataFrame:
    """16 hex characters per (query, side): equal results give equal hashes.

    Row digests are added up, so no task ever holds a whole result. Ordered results put
    the row number into the digest. The bytes are this library's own encoding.
    """
    text = row_text(F.col("cells"))
    numbered = F.concat(F.col("row_ix").cast("string"), F.lit("#"), text)
    digests = results.select(
        "query_id",
        "side",
        F.sha2(text, 256).alias("_plain"),
        F.sha2(numbered, 256).alias("_numbered"),  # null where a row has no number
    )

    def sums_of(digest: str) -> Column:
        parts = [F.sum(_slice(F.col(digest), k)).cast("string") for k in range(SLICES)]
        return F.concat_ws(":", F.count(F.lit(1)).cast("string"), *parts)

    # One line per (query, side) before the queries say which of the two sums counts.
    sums = (
        digests.groupBy("query_id", "side")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            sums_of("_plain").alias("_plain"),
            sums_of("_numbered").alias("_numbered"),
        )
        .join(queries.select("query_id", "ordered"), "query_id")
    )
    joined = F.when(F.col("ordered"), F.col("_numbered")).otherwise(F.col("_plain"))
    return sums.select(
        "query_id",
        "side",
        F.col("_n").alias("n_rows"),
        F.substring(F.sha2(joined, 256), 1, HASH_CHARS).alias("result_hash"),
    )


def relaxed_match(lines: DataFrame, queries: DataFrame) -> DataFrame:
    """Same rows in any order at 6 significant digits.

    ``lines``: ``query_id, side, width, row`` with ``row`` from ``relaxed_row_text``.
    """
    sign = F.when(F.col("side") == "a", 1).otherwise(-1)
    balance = lines.groupBy("query_id", "width", "row").agg(F.sum(sign).alias("_balance"))
    verdict = balance.groupBy("query_id").agg(F.every(F.col("_balance") == 0).alias("_same"))
    return queries.select("query_id").join(verdict, "query_id", "left").select(
        "query_id", F.coalesce("_same", F.lit(True)).alias("matched")
    )


def emptiness(results: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, n_rows, all_null``; a result without rows counts as all NULL too."""
    blank = F.forall(F.col("cells"), lambda c: c["tag"] == 0)
    found = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_n"), F.every(blank).alias("_blank")
    )
    return queries.select("query_id").join(found, "query_id", "left").select(
        "query_id",
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_rows"),
        F.coalesce("_blank", F.lit(True)).alias("all_null"),
    )


def order_ties(
    df: DataFrame, order: Sequence[Column], limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The ordered result twice, ties broken by every column ascending and descending.

    If the two differ (``results_match`` with ``ordered``), ties decide the answer.
    """
    def broken(direction: Callable[[str], Column]) -> tuple[DataFrame, list[Column]]:
        keys = [*order, *[direction(f"`{c}`") for c in df.columns]]
        return (df.orderBy(*keys).limit(limit) if limit is not None else df), keys

    up, up_keys = broken(F.asc)
    down, down_keys = broken(F.desc)
    return (
        result_rows(up, "q", "a", up_keys),
        result_rows(down, "q", "b", down_keys),
    )


def has_order_ties(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Without a limit a tie matters when one key holds two different rows: one aggregation."""
    text = row_text(row_cells(df))
    per_key = df.withColumn("_row", F.sha2(text, 256)).groupBy(*keys).agg(
        (F.min("_row") != F.max("_row")).alias("_tied")
    )
    return per_key.agg(F.coalesce(F.bool_or("_tied"), F.lit(False)).alias("has_ties"))


def capped(results: DataFrame, queries: DataFrame, limit: int = MAX_ROWS) -> DataFrame:
    """The first ``limit`` rows of each result, with the full row count on every line."""
    counts = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("row_count"))
    kept = first_per_group(results, ["query_id"], ["row_ix", "cells"], limit)
    return (
        queries.select("query_id")
        .join(counts, "query_id", "left")
        .withColumn("row_count", F.coalesce("row_count", F.lit(0)).cast("bigint"))
        .join(kept.drop("side"), "query_id", "left")
    )


def chart_kind(results: DataFrame, queries: DataFrame) -> DataFrame:
    """``line``, ``bar`` or NULL for each result: two columns, 2 to 30 rows, one numeric.

    A date-like x is text that starts with ``YYYY-MM``. Lines come from ``result_rows`` with
    ``numeric_text=False``: digits in a text column are no numbers here.
    """
    first, second = F.get("cells", F.lit(0)), F.get("cells", F.lit(1))

    def dated(c: Column) -> Column:
        return F.coalesce(c["str"].rlike(r"^\d{4}-\d{2}"), F.lit(False)) | (c["tag"] == 1)

    stats = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size("cells")).alias("lo"),
        F.max(F.size("cells")).alias("hi"),
        *[
            agg
            for name, c in (("x", first), ("y", second))
            for agg in (
                F.every(c["tag"] == 1).alias(f"{name}_num"),
                F.every(dated(c)).alias(f"{name}_dated"),
                F.bool_or(c["tag"] == 0).alias(f"{name}_null"),
                F.min(F.when(c["tag"] == 1, c["num"])).alias(f"{name}_min"),
            )
        ],
    )
    y_second, y_first = F.col("y_num"), F.col("x_num") & ~F.col("y_num")
    fits = (F.col("lo") == 2) & (F.col("hi") == 2) & F.col("n").between(2, 30) & (y_second | y_first)
    x_null = F.when(y_second, F.col("x_null")).otherwise(F.col("y_null"))
    x_dated = F.when(y_second, F.col("x_dated")).otherwise(F.col("y_dated"))
    y_min = F.when(y_second, F.col("y_min")).otherwise(F.col("x_min"))
    kind = F.when(fits & ~x_null, F.when(x_dated & (F.col("n") >= 3), "line").when(y_min >= 0, "bar"))
    return queries.select("query_id").join(
        stats.select("query_id", kind.alias("kind")), "query_id", "left"
    )


def reversed_copy(df: DataFrame) -> DataFrame:
    """The rows of a stored table in reverse order, for determinism checks."""
    marked = df.withColumn("_ix", F.monotonically_increasing_id())
    return marked.orderBy(F.desc("_ix")).drop("_ix")


def determinism(
    tables: dict[str, DataFrame],
    queries: dict[str, Callable[[dict[str, DataFrame]], DataFrame]],
) -> DataFrame:
    """Run each query on the tables and on reversed copies → ``query_id, deterministic``."""
    backwards = {name: cut(reversed_copy(df)) for name, df in tables.items()}
    lines = None
    for query_id, run in queries.items():
        for side, source in (("a", tables), ("b", backwards)):
            rows = result_rows(run(source), query_id, side)
            lines = rows if lines is None else lines.unionByName(rows)
    spark = next(iter(tables.values())).sparkSession
    asked = query_list(spark, dict.fromkeys(queries, False))
    return results_match(lines, asked).select("query_id", F.col("matched").alias("deterministic"))


def query_list(spark: SparkSession, ordered: dict[str, bool]) -> DataFrame:
    """The small ``queries`` table for results built by hand."""
    entries = [
        F.struct(F.lit(q).alias("query_id"), F.lit(o).alias("ordered")) for q, o in ordered.items()
    ]
    # A literal list has a known size, so joins with it need no shuffle.
    return spark.range(1).select(F.explode(F.array(*entries)).alias("q")).select("q.*")


def equivalence_filter(
    pairs: DataFrame, results: DataFrame, errors: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Keep the pairs whose two result sets agree → (kept pairs, drops by reason).

    ``pairs``: ``query_id, ordered, …``; ``errors``: ``query_id, reason`` for pairs that
    failed to convert or to run.
    """
    verdicts = cut(results_match(results, pairs.select("query_id", "ordered")).select("query_id", "matched"))
    judged = (
        pairs.join(errors.groupBy("query_id").agg(F.min("reason").alias("_error")), "query_id", "left")
        .join(verdicts, "query_id", "left")
        .withColumn(
            "reason",
            F.when(F.col("_error").isNotNull(), F.col("_error")).when(
                ~F.col("matched"), F.lit("result_mismatch")
            ),
        )
    )
    kept = judged.filter(F.col("reason").isNull()).drop("_error", "matched", "reason")
    drops = judged.filter(F.col("reason").isNotNull()).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n")
    )
    return kept, drops


def audit_items(items: DataFrame, checks: DataFrame, databases: DataFrame) -> DataFrame:
    """Problems of gold items → ``id, problem`` (NULL when the item is sound).

    ``items``: ``id, db_id, difficulty, gold_result_hash``; ``checks``: per id the columns
    ``error, n_rows, all_null, deterministic, ties, result_hash``; ``databases``: ``db_id``.
    """
    copies = items.groupBy("id").agg(F.count(F.lit(1)).alias("_copies"))
    known = databases.select("db_id").distinct().withColumn("_known", F.lit(True))
    unsound = _item_problem()
    return (
        items.join(copies, "id")
        .join(known, "db_id", "left")
        .join(checks, "id", "left")
        .select(
            "id",
            F.when(F.col("_copies") > 1, F.lit("duplicate id"))
            .when(
                F.col("_known").isNull()
                | ~F.coalesce(F.col("difficulty").isin(*DIFFICULTIES), F.lit(False)),
                F.lit("unknown db_id or difficulty"),
            )
            .when(unsound.isNotNull(), unsound)
            .when(
                ~F.col("gold_result_hash").eqNullSafe(F.col("result_hash")),
                F.concat(
                    F.lit("gold_result_hash is stale (now "), F.col("result_hash"), F.lit(")")
                ),
            )
            .alias("problem"),
        )
    )


# The difficulty labels, in report order.
DIFFICULTIES = ("easy", "medium", "hard", "extra")


def _item_problem() -> Column:
    """The first failed check of a query: error, emptiness, determinism, ties."""
    return (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), F.col("error")))
        .when(F.col("n_rows") == 0, F.lit("empty result"))
        .when(F.col("all_null"), F.lit("all-NULL result"))
        .when(~F.col("deterministic"), F.lit("non-deterministic (ties or unordered LIMIT)"))
        .when(F.col("ties"), F.lit("ORDER BY ties change the result"))
    )
