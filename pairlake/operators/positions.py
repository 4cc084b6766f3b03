"""Row numbers, running totals and lookups for groups of any size.

``row_number`` over ``partitionBy(group)`` puts a whole group into one task. Here the
rows are range-sorted by (group, order), so one group may span many tasks. Each task
numbers its own rows and a table with one row per (task, group) carries the offset.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pairlake.session import cut

# Fixed value: the most rows per group that Spark keeps before a shuffle (its default setting).
GROUP_LIMIT = 1000
_MID, _TASK, _LOCAL, _BEFORE = "_mid", "_task", "_local", "_before"


def _sorted(df: DataFrame, groups: Sequence[str], orders: Sequence[Column | str]) -> DataFrame:
    by = [F.col(g) for g in groups] + [F.col(o) if isinstance(o, str) else o for o in orders]
    marked = df.orderBy(*by).withColumn(_MID, F.monotonically_increasing_id())
    # The written copy fixes which task holds which row, whatever is recomputed later.
    return cut(marked).withColumn(_TASK, F.shiftright(_MID, 33))


def _offsets(segments: DataFrame, groups: Sequence[str], amount: str) -> DataFrame:
    """Sum of ``amount`` over a group's earlier tasks: at most one row per task and group."""
    earlier = (
        Window.partitionBy(*groups).orderBy(_TASK).rowsBetween(Window.unboundedPreceding, -1)
    )
    return segments.withColumn(_BEFORE, F.sum(amount).over(earlier))


def _with_offsets(rows: DataFrame, segments: DataFrame, groups: Sequence[str]) -> DataFrame:
    keys = [_TASK, *groups]
    renamed = segments.select(
        *[F.col(k).alias(f"_s_{k}") for k in keys],
        *[c for c in segments.columns if c not in keys],
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    return rows.join(renamed, same, "left").drop(*[f"_s_{k}" for k in keys])


def with_positions(
    df: DataFrame,
    groups: Sequence[str],
    orders: Sequence[Column | str],
    name: str = "pos",
) -> DataFrame:
    """Add ``name``: 1, 2, 3, … inside each group. ``orders`` should end in a unique key."""
    rows = _sorted(df, groups, orders)
    segments = rows.groupBy(_TASK, *groups).agg(
        F.count(F.lit(1)).alias("_n"), F.min(_MID).alias("_start")
    )
    segments = _offsets(segments, groups, "_n").drop("_n")
    numbered = _with_offsets(rows, segments, groups)
    return numbered.withColumn(
        name, F.col(_MID) - F.col("_start") + F.coalesce(_BEFORE, F.lit(0)) + 1
    ).drop(_MID, _TASK, _BEFORE, "_start")


def with_running_total(
    df: DataFrame,
    groups: Sequence[str],
    orders: Sequence[Column | str],
    value: str,
    name: str = "running",
) -> DataFrame:
    """Add ``name``: the sum of ``value`` from the group's first row to this one."""
    rows = _sorted(df, groups, orders)
    inside = (
        Window.partitionBy(_TASK, *groups)
        .orderBy(_MID)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = rows.withColumn(_LOCAL, F.sum(value).over(inside))
    segments = rows.groupBy(_TASK, *groups).agg(F.sum(value).alias("_n"))
    segments = _offsets(segments, groups, "_n").drop("_n")
    totals = _with_offsets(rows, segments, groups)
    return totals.withColumn(name, F.col(_LOCAL) + F.coalesce(_BEFORE, F.lit(0))).drop(
        _MID, _TASK, _LOCAL, _BEFORE
    )


def _differs(rows: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Which rows after the first differ from the row before them; null equals null."""
    new = np.zeros(rows.num_rows - 1, bool)
    for name in names:
        column = rows.column(name).combine_chunks()
        one, two = column[:-1], column[1:]
        other = pc.fill_null(pc.not_equal(one, two), False).to_numpy(zero_copy_only=False)
        if pa.types.is_floating(column.type):  # NaN equals NaN, as in a sort
            nan = pc.fill_null(pc.is_nan(column), False).to_numpy(zero_copy_only=False)
            other = other & ~(nan[:-1] & nan[1:])
        empty = column.is_null().to_numpy(zero_copy_only=False)
        new |= np.where(empty[:-1] | empty[1:], empty[:-1] != empty[1:], other)
    return new


def _scanned(
    df: DataFrame, groups: Sequence[str], orders: Sequence[Column | str], key: str, value: str
) -> tuple[DataFrame, DataFrame]:
    """(rows, carried): ``df`` in range-sorted tasks, scanned once, and one line per task.

    ``rows`` have ``_row``, the place in the task; ``_group`` and ``_tie``, the places where
    the row's group and its run of equal ``key`` begin in the task; ``_last``, the ``value``
    before it in both task and group. ``carried`` says how a task's first row goes on from the
    tasks before: ``_begin`` (rows before the task), ``_group_in``, ``_tie_in`` (where its group
    and run began), ``_last_in``.
    """
    names = list(dict.fromkeys([*groups, key, value]))
    kind = df.schema[value].dataType
    by = [F.col(g) for g in groups] + [F.col(o) if isinstance(o, str) else o for o in orders]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = group = tie = 0
        held: pa.Table | None = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            part = pa.Table.from_batches([batch]).select(names)
            both = part if held is None else pa.concat_tables([held, part])
            new_group, new_tie = _differs(both, groups), _differs(both, [*groups, key])
            before = both.column(value).combine_chunks()[:-1]
            if held is None:
                new_group, new_tie = np.append(True, new_group), np.append(True, new_tie)
                before = pa.concat_arrays([pa.nulls(1, before.type), before])
            place = np.arange(seen, seen + n)
            groups_at = np.maximum.accumulate(np.where(new_group, place, group))
            ties_at = np.maximum.accumulate(np.where(new_tie, place, tie))
            group, tie, seen = int(groups_at[-1]), int(ties_at[-1]), seen + n
            held = part.slice(n - 1)
            before = pc.if_else(pa.array(new_group), pa.nulls(n, before.type), before)
            arrays = [*batch.columns, pa.array(place), pa.array(groups_at), pa.array(ties_at), before]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "_row", "_group", "_tie", "_last"])

    added = [StructField(c, LongType()) for c in ("_row", "_group", "_tie")] + [StructField("_last", kind)]
    scanned = df.orderBy(*by).mapInArrow(run, StructType([*df.schema.fields, *added]))
    rows = cut(scanned.withColumn(_TASK, F.spark_partition_id()))
    ends = rows.groupBy(_TASK).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct(*names), "_row").alias("first"),
        F.max_by(F.struct(*names, "_group", "_tie"), "_row").alias("end"),
    )
    # One line per task: few, however many rows there are.
    tasks = Window.orderBy(_TASK)
    earlier = tasks.rowsBetween(Window.unboundedPreceding, -1)

    def same(columns: Sequence[str]) -> Column:
        out = F.col("before").isNotNull()
        for c in columns:
            out = out & F.col("first")[c].eqNullSafe(F.col("before")[c])
        return out

    lines = ends.withColumns(
        {"_begin": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "before": F.lag("end").over(tasks)}
    ).withColumns({"same_group": same(groups), "same_tie": same([*groups, key])})

    def began(place: str, same_run: str) -> Column:
        """Where the run of the last row began, told by the task in which it did."""
        here = F.when((F.col("end")[place] > 0) | ~F.col(same_run), F.col("_begin") + F.col("end")[place])
        return F.last(here, ignorenulls=True).over(earlier)

    carried = lines.withColumns(
        {"group_run": began("_group", "same_group"), "tie_run": began("_tie", "same_tie")}
    ).select(
        _TASK,
        "_begin",
        F.when(F.col("same_group"), F.col("group_run")).otherwise(F.col("_begin")).alias("_group_in"),
        F.when(F.col("same_tie"), F.col("tie_run")).otherwise(F.col("_begin")).alias("_tie_in"),
        F.when(F.col("same_group"), F.col("before")[value]).alias("_last_in"),
    )
    return rows, carried


def with_rank(
    df: DataFrame, groups: Sequence[str], key: str, orders: Sequence[Column | str], name: str = "rank"
) -> DataFrame:
    """``rank()`` by ``key`` inside each group; ``orders`` sorts by ``key`` first.

    Rows are sorted into tasks once; what a task needs of the tasks before it is one line.
    """
    rows, carried = _scanned(df, groups, orders, key, key)
    group = F.when(F.col("_group") == 0, F.col("_group_in")).otherwise(F.col("_begin") + F.col("_group"))
    tie = F.when(F.col("_tie") == 0, F.col("_tie_in")).otherwise(F.col("_begin") + F.col("_tie"))
    return rows.join(carried, _TASK).select(*df.columns, (tie - group + 1).alias(name))


def with_previous(
    df: DataFrame, groups: Sequence[str], orders: Sequence[Column | str], value: str, name: str
) -> DataFrame:
    """``lag(value)`` inside each group: a scan of each sorted task, and one carried line."""
    rows, carried = _scanned(df, groups, orders, value, value)
    first = F.when(F.col("_row") == 0, F.col("_last_in")).otherwise(F.col("_last"))
    return rows.join(carried, _TASK).select(*df.columns, first.alias(name))


def first_per_group(
    df: DataFrame, groups: Sequence[str], orders: Sequence[Column | str], n: int
) -> DataFrame:
    """The first ``n`` rows of each group.

    Up to ``GROUP_LIMIT``, Spark cuts every task's part of a group to ``n`` rows before they
    move, so a group brings at most ``n`` rows per task together. Above, where it would not,
    rows are numbered where they are sorted.
    """
    if n <= GROUP_LIMIT:
        by = [F.col(o) if isinstance(o, str) else o for o in orders]
        rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*by))
        return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
    ranked = with_positions(df, groups, orders, "_rank")
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def with_copy_positions(
    df: DataFrame,
    groups: Sequence[str],
    orders: Sequence[str],
    name: str = "pos",
    chunk: int = 1_000_000,
) -> DataFrame:
    """Positions of rows without a unique key: ``orders`` and ``groups`` name all columns.

    Equal rows are counted, numbered once and then listed again, so nothing depends on
    which of them came first, and any number of copies spreads over tasks.
    """
    counted = df.groupBy(*groups, *orders).agg(F.count(F.lit(1)).alias("_copies"))
    ends = with_running_total(counted, groups, orders, "_copies", "_end")
    first, last = F.col("_end") - F.col("_copies") + 1, F.col("_end")
    starts = F.sequence(first, last, F.lit(chunk).cast("bigint"))
    return (
        ends.withColumn("_from", F.explode(starts))
        .withColumn(
            name, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (chunk - 1), last)))
        )
        .drop("_copies", "_end", "_from")
    )
