"""Merkle manifest of a dataset: interval-labelled nodes, proofs, and a check of every row.

Every row is a leaf: the SHA-256 of its chosen columns. The leaves of a group (null is a
group) ascend by id and are numbered; while a group has several nodes, each two neighbours,
or the one left over, become the digest of their digests. The groups' subroots, in order of
the group, become the root in the same way.

A node is labelled with the interval of leaf numbers that it covers. Levels are kept in
bands of ``BAND``: a row of a band's table holds the nodes of ``BAND`` levels over one aligned
bucket of leaf numbers, at most ``2 * 2**BAND`` of them. A leaf, or the top of a bucket, meets
the row whose bucket contains its interval, which attaches its ancestors of the whole band;
what a parent's interval covers besides the child's is the sibling's interval. So bands are
joined from the root downwards, every join by a key with at most ``2**BAND`` partners, and no
group, however large, lies in one task; the loops run once per band, not once per row.

Defined cases: a null counts as ``-``; a null id sorts first; rows that are equal in id and
leaf are numbered in any order, since they are interchangeable, and each keeps its own line;
empty texts are values of length 0; a lone leaf is its own subroot and a lone group's subroot
the root; an empty table gives an empty manifest; columns not asked for are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.operators.positions import with_copy_positions
from pairlake.session import cut

BAND = 5  # levels of a row; 32 leaves or nodes below it
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """A value that cannot be confused with its neighbours: byte count, colon, value."""
    text = value.cast("string")
    counted = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(counted, F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*map(framed, values))


def _halve(below: str) -> Column:
    """The next level of a sorted array of nodes."""
    left, right = f"get({below}, 2 * i)", f"get({below}, 2 * i + 1)"
    return F.expr(
        f"transform(sequence(0, (size({below}) + 1) div 2 - 1), i -> named_struct("
        f"'lo', {left}.lo, 'hi', coalesce({right}.hi, {left}.hi), "
        f"'digest', sha2(concat({left}.digest, coalesce({right}.digest, '')), 256)))"
    )


def _band(nodes: DataFrame, heights: DataFrame, band: int) -> DataFrame:
    """(group, bucket, lo, hi, digest, steps, last, _level0 … _level5): the levels from
    BAND * band on over every bucket, and the node that they end in.

    ``nodes`` are the (group, lo, hi, digest) at level BAND * band.
    """
    bucket = F.shiftright("lo", BAND * (band + 1)).alias("bucket")
    rows = nodes.groupBy("group", bucket).agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("_level0")
    )
    tall = heights.select(F.col("group").alias("_group"), "height")
    rows = rows.join(tall, F.col("group").eqNullSafe(F.col("_group"))).select(
        "group",
        "bucket",
        F.least(F.lit(BAND), F.col("height") - BAND * band).alias("steps"),
        (F.col("height") <= BAND * (band + 1)).alias("last"),
        "_level0",
    )
    for step in range(BAND):
        rows = rows.withColumn(f"_level{step + 1}", F.when(F.col("steps") > step, _halve(f"_level{step}")))
    top = F.get(F.coalesce(*[F.col(f"_level{s}") for s in range(BAND, -1, -1)]), F.lit(0))
    return cut(rows.withColumn("_top", top).select("*", "_top.*").drop("_top"))


def _beside(unit: int) -> Column:
    """What stands beside the node at ``lo`` and beside its ancestors in the band, bottom up.

    ``unit`` is the width of a node of the band's lowest level.
    """

    def at(step: int, place: str) -> str:
        return f"get(_up_level{step}, cast(({place} - get(_up_level0, 0).lo) div {unit << step} AS int))"

    steps = []
    for step in range(BAND):
        child, parent = at(step, "lo"), at(step + 1, "lo")
        # The parent's interval without the child's is the sibling's, if anything is left.
        left = f"CASE WHEN {parent}.lo < {child}.lo THEN {at(step, parent + '.lo')}.digest ELSE '' END"
        right = f"CASE WHEN {child}.hi < {parent}.hi THEN {at(step, child + '.hi')}.digest ELSE '' END"
        pair = f"named_struct('left', {left}, 'right', {right})"
        steps.append(f"IF(_up_steps > {step}, array({pair}), CAST(array() AS {PATH}))")
    return F.expr(f"concat({', '.join(steps)})")


def _attach(nodes: DataFrame, rows: DataFrame, band: int) -> DataFrame:
    """``nodes`` (group, lo, hi, …) with ``path`` and ``subroot`` from the row of the band
    whose interval contains theirs."""
    names = ["group", "bucket", "lo", "hi", "path", "subroot", "steps", *[f"level{s}" for s in range(BAND + 1)]]
    above = rows.select(*[F.col(f"_{n}" if n.startswith("level") else n).alias(f"_up_{n}") for n in names])
    contains = (
        F.col("group").eqNullSafe(F.col("_up_group"))
        & (F.shiftright("lo", BAND * (band + 1)) == F.col("_up_bucket"))
        & (F.col("_up_lo") <= F.col("lo"))
        & (F.col("hi") <= F.col("_up_hi"))
    )
    path = F.concat(_beside(1 << (BAND * band)), F.col("_up_path")).alias("path")
    return nodes.join(above, contains).select(*nodes.columns, path, F.col("_up_subroot").alias("subroot"))


class Trees:
    """One tree per group over numbered leaves (group, lo, hi, digest, …)."""

    def __init__(self, leaves: DataFrame):
        self.leaves = leaves
        n = F.col("n")
        self.heights = cut(
            leaves.groupBy("group")
            .agg(F.max("hi").alias("n"))
            .select("group", F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).alias("height"))
        )
        tallest = self.heights.agg(F.max("height")).first()[0]
        self.bands: list[DataFrame] = []
        if tallest is None:
            return
        nodes = leaves.select("group", "lo", "hi", "digest")
        for band in range(max(1, -(-tallest // BAND))):
            left = self.heights.filter(F.col("height") > BAND * band) if band else self.heights
            self.bands.append(_band(nodes, left, band))
            nodes = self.bands[-1].select("group", "lo", "hi", "digest")

    def subroots(self) -> DataFrame:
        """(group, subroot)"""
        ends = [b.filter("last").select("group", F.col("digest").alias("subroot")) for b in self.bands]
        found = ends[0]
        for more in ends[1:]:
            found = found.unionByName(more)
        return found

    def paths(self, above: DataFrame) -> DataFrame:
        """The leaves with ``path`` and ``subroot``; ``above`` (group, path) is what follows
        after a group's subroot."""
        ends = above.select(F.col("group").alias("_g"), "path")
        upper: DataFrame | None = None
        for band in range(len(self.bands) - 1, -1, -1):
            rows = self.bands[band]
            known = (
                rows.filter("last")
                .join(ends, F.col("group").eqNullSafe(F.col("_g")))
                .drop("_g")
                .withColumn("subroot", F.col("digest"))
            )
            if upper is not None:
                inner = _attach(rows.filter(~F.col("last")), upper, band + 1)
                known = known.unionByName(inner)
            upper = cut(known)
        return _attach(self.leaves, upper, 0)


def manifest(rows: DataFrame, id_col: str, group: str, carried: Sequence[str] = ()) -> DataFrame:
    """(id_col, group, leaf, *carried, path, subroot, root) of ``rows`` (id_col, group, leaf, …).

    ``path`` has one (left, right) per level from the leaf to the root: what stands beside the
    node, empty where nothing does. ``carried`` columns go along unchanged.
    """
    spark = rows.sparkSession
    names = [id_col, group, "leaf", *carried]
    given = rows.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    given = cut(given)  # the texts are read once, for their digests
    order = ["c0", "c2", *[f"c{i}" for i in range(3, len(names))]]
    leaves = cut(
        with_copy_positions(given, ["c1"], order, "pos").select(
            F.col("c1").alias("group"),
            (F.col("pos") - 1).alias("lo"),
            F.col("pos").alias("hi"),
            F.col("c2").alias("digest"),
            "c0",
            *order[2:],
        )
    )
    schema = given.schema
    trees = Trees(leaves)
    if not trees.bands:
        empty = given.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
        nothing = F.lit("")
        return empty.select("*", F.array().cast(PATH).alias("path"), nothing.alias("subroot"), nothing.alias("root"))
    subroots = cut(trees.subroots())
    placed = with_copy_positions(subroots.withColumn("all", F.lit(0)), ["all"], ["group", "subroot"], "pos")
    crown = Trees(
        cut(
            placed.select(
                F.col("all").alias("group"),
                (F.col("pos") - 1).alias("lo"),
                F.col("pos").alias("hi"),
                F.col("subroot").alias("digest"),
                F.col("group").alias("name"),
            )
        )
    )
    root = crown.subroots().first()["subroot"]
    start = spark.range(1).select(F.lit(0).alias("group"), F.array().cast(PATH).alias("path"))
    above = cut(crown.paths(start).select(F.col("name").alias("group"), "path"))
    found = trees.paths(above)
    return found.select(
        F.col("c0").alias(id_col),
        F.col("group").cast(schema["c1"].dataType).alias(group),
        F.col("digest").alias("leaf"),
        *[F.col(f"c{i}").alias(names[i]) for i in range(3, len(names))],
        "path",
        "subroot",
        F.lit(root).alias("root"),
    )


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf leads to along its path."""
    return F.aggregate(path, leaf_digest, lambda node, s: digest(s["left"], node, s["right"]))
