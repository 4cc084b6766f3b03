"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Every source wants a share of the mix in proportion to its weight but may be repeated at
most ``max_epochs`` times. Sources whose share exceeds that are clamped, and the excess is
dealt to the others by weight until nobody is above. The fixed point is reached in one
pass: with sources ordered by (cap / weight), exactly a prefix of them is clamped.

A source then takes ``floor(target / size)`` whole repetitions of all its documents and,
for the fractional repetition, the documents that come first in a seeded order, up to the
remaining words. The order is cut into slots by hash, so no source is sorted as a whole:
slots before the boundary are taken, those after it are not, and only the boundary slot's
documents are numbered.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a source of
its own; a source of size 0 has target 0; an empty table gives an empty result; repeated
rows count as documents of their own (equal rows share one place in the order, and which
of them comes first does not show); other columns are ignored by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlake.llm.digests import digest
from pairlake.operators.positions import with_positions
from pairlake.session import cut

WORD = r"[^\x20\x09-\x0D]+"
SLOT_DIGITS = 3  # hex digits of the seeded order that name a slot: 4,096 slots a source


def words(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(
    sources: DataFrame, weights: Sequence[float], share: float, max_epochs: float
) -> DataFrame:
    """Add ``target`` to (source, source_size): min(cap, level * weight).

    ``sources`` has one row per source. Weights repeat over the sources by name, null last.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sources.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    everything = Window.partitionBy()
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = (
        weighed.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("clamped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(onward))
        # The water level if all sources before this one are clamped and this one is not.
        .withColumn("level", (F.col("total") - F.col("clamped")) / F.col("open"))
        .withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
        .withColumn(
            "level",
            F.min(F.when(F.col("fits"), F.struct("clamped", "level"))).over(everything)["level"],
        )
    )
    goal = F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))
    return levels.select("source", "source_size", F.least("cap", goal).alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float],
    share: float = 1.0,
    max_epochs: float = 4.0,
    seed: str = "mix-1",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per document.

    ``docs`` has doc_id, source and text. ``copies`` says how often the document enters the
    mix; ``taken`` = copies * size. A source misses its target by at most half a document.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sized = cut(
        docs.select(
            "doc_id",
            "source",
            words(F.col("text")).alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), key)).alias("place"),
        )
    ).withColumn("slot", F.substring("place", 1, SLOT_DIGITS))

    slots = sized.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    sources = slots.groupBy("source").agg(F.sum("slot_size").alias("source_size"))
    targets = (
        water_fill(sources, weights, share, max_epochs)
        .withColumn(
            "whole",
            F.when(
                F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
            ).otherwise(F.lit(0)),
        )
        .withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    targets = targets.select("source", "source_size", "target", "whole", "goal")
    earlier = (
        Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    )
    begun = slots.withColumn("begun", F.coalesce(F.sum("slot_size").over(earlier), F.lit(0)))
    slot_end = F.col("begun") + F.col("slot_size")
    # Slots that end by the goal are taken, slots that begin at or above it are not; the
    # one in between is the boundary. Documents meet their slot, never their whole source.
    plan = _join(begun, targets, ["source"]).select(
        "source",
        "slot",
        "source_size",
        "target",
        "whole",
        "goal",
        "begun",
        (slot_end <= F.col("goal")).cast("int").alias("extra"),
        ((F.col("begun") < F.col("goal")) & (slot_end > F.col("goal"))).alias("boundary"),
    )
    dealt = _join(sized, plan, ["source", "slot"])
    inside = (
        Window.partitionBy("source", "slot")
        .orderBy("place", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    so_far = F.col("begun") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    edge = dealt.filter("boundary").withColumn(
        "extra", (so_far + F.col("size") / 2 < F.col("goal")).cast("int")
    )
    copies = (F.col("whole") + F.col("extra")).cast("long")
    return (
        dealt.filter(~F.col("boundary"))
        .unionByName(edge)
        .withColumn("copies", copies)
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def repeat(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as ``mixed`` says, columns unchanged.

    Rows meet their counts by (doc_id, source, size). Repeated rows of ``docs`` may have
    different counts; their sum is dealt to them evenly, and what is left over goes to the
    first rows by digest, one copy each.
    """
    counts = mixed.groupBy("doc_id", "source", "size").agg(
        F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")
    )
    names = {c: f"_m_{c}" for c in ("doc_id", "source", "size")}
    counts = cut(counts.withColumnsRenamed(names))
    over = F.col("_copies") % F.col("_rows")
    same = (
        docs["doc_id"].eqNullSafe(counts["_m_doc_id"])
        & docs["source"].eqNullSafe(counts["_m_source"])
        & (words(docs["text"]) == counts["_m_size"])
    )
    dealt = docs.join(counts.filter(over == 0), same).withColumn("_more", F.lit(0))
    uneven = counts.filter(over > 0)
    if not uneven.isEmpty():  # only where rows are repeated
        joined = docs.join(uneven, same)
        placed = with_positions(joined, list(names.values()), [digest("text")], "_place")
        first = (F.col("_place") <= over).cast("int")
        dealt = dealt.unionByName(placed.withColumn("_more", first).drop("_place"))
    return (
        dealt.withColumn("_n", (F.floor(F.col("_copies") / F.col("_rows")) + F.col("_more")).cast("int"))
        .filter(F.col("_n") > 0)
        .withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n"))))
        .select(*docs.columns)
    )


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on ``keys``, where null equals null."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(other, same).drop(*[f"_{k}" for k in keys])
