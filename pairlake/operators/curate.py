"""Pair-corpus curation: duplicates, leaks, splits, caps, samples, ids and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlake.functions.numbers import exact_round
from pairlake.functions.text import normalize_question, normalize_sql
from pairlake.operators.positions import first_per_group, with_positions, with_running_total
from pairlake.operators.results import DIFFICULTIES
from pairlake.operators.quantiles import order_statistics
from pairlake.operators.similarity import (
    ROW,
    first_similar,
    index_tests,
    labelled,
    labelled_dedupe,
    labelled_leaks,
)
from pairlake.session import beside, cut


def seeded(seed: str, key: str | Column) -> Column:
    """A fixed pseudo-random order: SHA-256 of ``seed:key``."""
    value = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat(F.lit(f"{seed}:"), value.cast("string")), 256)


def exact_dedupe(pairs: DataFrame, block: str = "db_id") -> DataFrame:
    """The first pair by id for each (database, normalised question, normalised SQL).

    Only digests are grouped. The pairs themselves meet the ids to drop, a short list
    unless the corpus is mostly copies, so their text is not sorted or moved for nothing.
    """
    key = [block, "_q", "_s"]
    digests = cut(
        pairs.select(
            "id",
            block,
            F.md5(normalize_question(F.col("question"))).alias("_q"),
            F.md5(normalize_sql(F.col("sql"))).alias("_s"),
        )
    )
    copied = (
        digests.groupBy(*key)
        .agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1)
    )
    later = digests.join(copied, key).filter(F.col("id") != F.col("_first")).select("id")
    return pairs.join(later, "id", "left_anti")


def shared_databases(train: DataFrame, val: DataFrame, block: str = "db_id") -> DataFrame:
    """Databases that occur on both sides of a split."""
    return train.select(block).intersect(val.select(block))


def same_result_as_test(rows: DataFrame, tests: DataFrame) -> DataFrame:
    """Rows whose result equals a test item's gold result on the same database."""
    gold = tests.filter(F.coalesce("gold_result_hash", F.lit("")) != "").select(
        "db_id", F.col("gold_result_hash").alias("result_hash")
    )
    return rows.join(gold.distinct(), ["db_id", "result_hash"], "left_semi").select(rows.columns)


def cap_per_group(
    rows: DataFrame, n: int, order: str = "seq", group: str = "db_id"
) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows per group, and how many were left out (``over_target``)."""
    kept = first_per_group(rows, [group], [order], n)
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    over = counts.select(group, F.greatest(F.col("_n") - n, F.lit(0)).alias("over_target"))
    return kept, over


def finalize(
    records: DataFrame, tests: DataFrame, n: int, order: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """Agreed records → deduplicated, leak-free, capped rows, and drops per database.

    ``records``: ``id, seq, db_id, question, sql, result_hash, decision``. If they are
    ``marked``, their texts stay where they are until the rows to keep are known.
    """
    agreed = records.filter(F.col("decision") == "agreed")
    numbered = ROW in records.columns
    spark = records.sparkSession
    with beside(spark, lambda: index_tests(tests)) as indexed:
        known = labelled(agreed, order, carry=["id"])
        reasons = labelled_dedupe(known)
    index = indexed.result()
    judged = agreed.join(reasons.withColumnRenamed("seq", order), order)
    first = known.rows.join(reasons.filter(F.col("reason").isNull()), "seq")
    first = cut(first.select("set_id", "q_id", "s_id", F.col("carried.id").alias("id")))
    asked = cut(first.select("set_id").distinct())
    near = first_similar(known.sets, cut(known.signs.join(asked, "set_id", "left_semi")), index)
    if numbered:
        judged = judged.select(*dict.fromkeys([ROW, "id", order, "db_id", "result_hash", "reason"]))
    unique = judged.filter(F.col("reason").isNull()).drop("reason")
    text = labelled_leaks(first, near, index).select("id").withColumn("_text", F.lit(True))
    same = same_result_as_test(unique, tests).select("id").withColumn("_same", F.lit(True))
    flagged = (
        judged.join(text, "id", "left")
        .join(same, "id", "left")
        .withColumn(
            "reason",
            F.coalesce(
                F.col("reason"),
                F.when(F.col("_text"), F.lit("test_leakage_text")),
                F.when(F.col("_same"), F.lit("test_leakage_same_result")),
            ),
        )
        .drop("_text", "_same")
    )
    clean = flagged.filter(F.col("reason").isNull()).drop("reason")
    kept, over = cap_per_group(clean, n, order)
    if numbered:
        kept = agreed.join(cut(kept.select(ROW)), ROW).drop(ROW)
    drops = (
        flagged.filter(F.col("reason").isNotNull())
        .groupBy("db_id", "reason")
        .agg(F.count(F.lit(1)).alias("n"))
        .unionByName(
            over.filter("over_target > 0").select(
                "db_id", F.lit("over_target").alias("reason"), F.col("over_target").alias("n")
            )
        )
    )
    return kept, drops


def hold_out(
    rows: DataFrame,
    seed: str,
    fraction: float = 0.10,
    source: str = "spider",
    block: str = "db_id",
) -> DataFrame:
    """Whole databases for validation, in seeded order, until they reach the target.

    The target is a share of all rows; the running count covers one source only, and the
    database that crosses the target is included.
    """
    per_db = rows.groupBy(block).agg(
        F.count_if(F.col("source") == source).alias("_own"), F.count(F.lit(1)).alias("_all")
    )
    target = rows.agg((F.lit(fraction) * F.count(F.lit(1))).alias("_target"))
    counted = per_db.filter(F.col("_own") > 0).withColumn("_order", seeded(seed, block))
    running = with_running_total(counted, [], ["_order", block], "_own", "_running")
    return running.filter(F.col("_running") - F.col("_own") < target.scalar()).select(
        block, F.col("_own").alias("n_rows")
    )


def seeded_subset(rows: DataFrame, n: int, seed: str, key: str = "id") -> DataFrame:
    """``n`` rows with the smallest seeded hash; a larger ``n`` gives a superset."""
    return rows.orderBy(seeded(seed, key), key).limit(n).orderBy(key)


def systematic_sample(
    rows: DataFrame, every: int = 10, group: str = "set", order: str = "id"
) -> DataFrame:
    """The 1st, 11th, 21st, … row of each set."""
    ranked = with_positions(rows, [group], [order], "_pos")
    return ranked.filter((F.col("_pos") - 1) % every == 0).drop("_pos")


def quotas(groups: Sequence[str], total: int) -> dict[str, int]:
    """``total`` split evenly over the groups, the first ones taking the remainder."""
    share, rest = divmod(total, len(groups))
    return {g: share + (i < rest) for i, g in enumerate(groups)}


def review_sample(
    rows: DataFrame,
    groups: Sequence[str],
    seed: str,
    total: int = 50,
    group: str = "db_id",
    key: str = "id",
) -> DataFrame:
    """A fixed random sample for review, its size split evenly over the groups."""
    wanted = quotas(groups, total)
    pool = rows.filter(F.col(group).isin(*groups)).withColumn(
        "_order", seeded(seed, F.concat_ws(":", F.col(group), F.col(key).cast("string")))
    )
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_order", key))
    largest = max(wanted.values())
    quota = F.create_map(*[F.lit(x) for g, q in wanted.items() for x in (g, q)])
    return (
        pool.withColumn("_rank", rank)
        .filter(F.col("_rank") <= largest)
        .filter(F.col("_rank") <= F.element_at(quota, F.col(group)))
        .drop("_rank", "_order")
    )


def stable_sample(items: DataFrame, audit: DataFrame, n: int, seed: str) -> DataFrame:
    """A seeded subset of the items without problems (``audit``: ``id, problem``)."""
    sound = audit.filter(F.col("problem").isNull()).select("id")
    return seeded_subset(items.join(sound, "id", "left_semi"), n, seed)


def sequence_ids(
    rows: DataFrame, prefix: str = "synth", group: str = "db_id", order: str = "seq"
) -> DataFrame:
    """New ids ``prefix_<db>_0001``, … in order inside each database."""
    ranked = with_positions(rows, [group], [order], "_pos")
    new_id = F.format_string(f"{prefix}_%s_%04d", F.col(group), F.col("_pos"))
    return ranked.withColumn("new_id", new_id).drop("_pos")


def retention(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs, kept and kept share per key; ``reason`` NULL means kept."""
    kept = F.count_if(F.col("reason").isNull())
    return outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"),
        kept.alias("kept"),
        exact_round(kept / F.count(F.lit(1)), 4).alias("retention"),
    )


def drops_by_reason(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    dropped = outcomes.filter(F.col("reason").isNotNull())
    return dropped.groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))


def corpus_totals(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: databases, output rows, duplicates removed, and outputs with empty results.

    ``rows``: ``db_id, duplicate, empty`` per pair that passed the execution filter.
    """
    return rows.groupBy(*keys).agg(
        F.count_distinct("db_id").alias("databases"),
        F.count_if(~F.col("duplicate")).alias("outputs"),
        F.count_if("duplicate").alias("duplicates_removed"),
        F.count_if(~F.col("duplicate") & F.col("empty")).alias("empty_results"),
    )


def difficulty_histogram(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One column per difficulty, in the fixed order, zeros included."""
    return rows.groupBy(*keys).agg(
        *[F.count_if(F.col("difficulty") == d).alias(d) for d in DIFFICULTIES]
    )


def length_percentiles(rows: DataFrame, group: str, length: str) -> DataFrame:
    """Per group: median (rounded down), the value at ``int(0.95 * (n - 1))``, maximum.

    No group is sorted or held in one task, however large it is.
    """
    targets = {
        "_low": (0.5, lambda n: F.floor((n - 1) / 2)),
        "_high": (0.5, lambda n: F.ceil((n - 1) / 2)),
        "_p95": (0.95, lambda n: F.floor(F.lit(0.95) * (n - 1))),
    }
    longest = rows.groupBy(F.col(group).alias("_group")).agg(F.max(length).cast("bigint").alias("max"))
    found = order_statistics(rows, [group], length, targets)
    return longest.join(found, F.col("_group").eqNullSafe(F.col(group)), "left").select(
        F.col("_group").alias(group),
        F.floor((F.col("_low") + F.col("_high")) / 2).cast("bigint").alias("p50"),
        F.col("_p95").cast("bigint").alias("p95"),
        "max",
    )


def source_mix(rows: DataFrame, length: str, max_length: int) -> DataFrame:
    """Training rows by source, and how many were too long."""
    fits = F.col(length) <= max_length
    return rows.groupBy("source").agg(
        F.count_if(fits).alias("train_pairs"), F.count_if(~fits).alias("dropped_over_max_len")
    )


def review_acceptance(verdicts: DataFrame, group: str = "db_id") -> DataFrame:
    """Accepted share per group, and overall as the group ``all``."""
    accepted = F.count_if(F.col("accept"))
    return (
        verdicts.rollup(group)
        .agg(
            F.count(F.lit(1)).alias("n"),
            accepted.alias("accepted"),
            exact_round(accepted / F.count(F.lit(1)), 4).alias("accept_rate"),
            F.grouping(group).alias("_all"),
        )
        .withColumn(group, F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col(group)))
        .drop("_all")
    )
