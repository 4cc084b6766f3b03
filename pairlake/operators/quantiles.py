"""Exact order statistics of groups of any size, without sorting the groups.

One aggregation sketches where a wanted place lies: two approximate percentiles a little
below and above it, merged on the map side. A second pass counts what is below the lower one
and keeps only the values between the two, about a thousandth of a large group, counted per
distinct value. Their running totals, which spread over tasks, meet the wanted place exactly.
Should a sketch have missed it, the group's values are all counted instead.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.operators.positions import with_running_total
from pairlake.session import cut

ACCURACY = 10_000  # of the sketch: it is off by at most n / ACCURACY places
MARGIN = 3 / ACCURACY
WHOLE = 50_000  # groups up to this size are counted as they are

Target = tuple[float, Callable[[Column], Column]]


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, targets: Mapping[str, Target]
) -> DataFrame:
    """``keys``, ``n`` and one column per target: the value at its place in the sorted group.

    A target is (fraction, place of n): ``(0.95, lambda n: F.floor(0.95 * (n - 1)))`` wants the
    value at that 0-based place, which must lie within one of the fraction. NULL values are
    left out, and so are groups without any other; NaN sorts last.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(
        *[F.col(k).alias(name) for k, name in zip(keys, names, strict=True)], F.col(value).alias("_v")
    ).filter(F.col("_v").isNotNull())
    cuts = [min(max(q + side * MARGIN, 0.0), 1.0) for q, _ in targets.values() for side in (-1, 1)]
    facts = cut(
        rows.groupBy(*names).agg(
            F.count(F.lit(1)).alias("n"),
            F.min("_v").alias("_low"),
            F.max("_v").alias("_high"),
            F.percentile_approx("_v", cuts, ACCURACY).alias("_cuts"),
        )
    )
    kind = df.schema[value].dataType

    def wanted(narrow: bool) -> Column:
        each = []
        for i, (name, (_, place)) in enumerate(targets.items()):
            small = (F.col("n") <= WHOLE) if narrow else F.lit(True)
            ends = [
                F.when(small, F.col(end)).otherwise(F.get("_cuts", F.lit(2 * i + side)).cast(kind)).alias(name_)
                for side, (end, name_) in enumerate((("_low", "low"), ("_high", "high")))
            ]
            each.append(F.struct(F.lit(name).alias("target"), place(F.col("n")).cast("bigint").alias("place"), *ends))
        return F.array(*each)

    def pick(groups: DataFrame, narrow: bool) -> DataFrame:
        asked = groups.select(*[F.col(k).alias(f"_f{k}") for k in names], "n", wanted(narrow).alias("_targets"))
        same = F.lit(True)
        for k in names:
            same = same & F.col(k).eqNullSafe(F.col(f"_f{k}"))
        # What is above a target's range cannot be it; what is below only counts.
        shown = F.transform(
            F.filter("_targets", lambda t: F.col("_v") <= t["high"]),
            lambda t: F.struct(t["target"], t["place"], F.when(F.col("_v") >= t["low"], F.col("_v")).alias("shown")),
        )
        counted = (
            rows.join(asked, same)
            .select(*names, "n", F.explode(shown).alias("_t"))
            .select(*names, "n", "_t.*")
            .groupBy(*names, "n", "target", "place", "shown")
            .agg(F.count(F.lit(1)).alias("_here"))
        )
        spread = with_running_total(counted, [*names, "target"], [F.asc_nulls_first("shown")], "_here", "_upto")
        hit = (F.col("place") < F.col("_upto")) & (F.col("place") >= F.col("_upto") - F.col("_here"))
        return spread.groupBy(*names, "n").agg(
            *[F.max(F.when(hit & (F.col("target") == t), F.col("shown"))).alias(t) for t in targets]
        )

    found = cut(pick(facts, narrow=True))
    missed = F.lit(False)
    for t in targets:
        missed = missed | F.col(t).isNull()
    rest = found.filter(missed)
    if not rest.isEmpty():
        again = rest.select(*[F.col(k).alias(f"_m{k}") for k in names])
        same = F.lit(True)
        for k in names:
            same = same & F.col(k).eqNullSafe(F.col(f"_m{k}"))
        found = found.filter(~missed).unionByName(pick(facts.join(again, same, "left_semi"), narrow=False))
    return found.withColumnsRenamed(dict(zip(names, keys, strict=True)))


def percentile(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """``keys`` and the exact percentile ``q``, interpolated between neighbours."""
    at = [(q, lambda n: F.floor((n - 1) * q)), (q, lambda n: F.ceil((n - 1) * q))]
    found = order_statistics(df, keys, value, {"_lower": at[0], "_upper": at[1]})
    part = (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
    between = F.col("_lower") + (F.col("_upper") - F.col("_lower")) * part
    return found.select(*keys, F.when(part == 0, F.col("_lower")).otherwise(between).cast("double").alias(name))
