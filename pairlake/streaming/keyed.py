"""Tables of keyed lines that grow batch by batch: written once, merged when read.

A batch writes its own lines and nothing else, under its number, so a repeated batch writes
the same folder again. Readers take the last line of every key. Now and then the lines so far
are merged into a base, and what it holds is deleted: a batch costs what it brings, a read
costs the keys plus the lines since the last base, and no streaming state is kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlake.session import folders, remove

COMPACT_EVERY = 20


class KeyedTable:
    """The table at ``folder``; of the lines of one key the last by ``order``, then by batch,
    counts."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], order: Sequence[str] = ()):
        self.spark, self.folder, self.keys, self.order = spark, folder, list(keys), list(order)

    def _parts(self) -> tuple[int, list[int]]:
        """Number of the newest whole base (-1: none), and the batches after it."""
        names = folders(self.spark, self.folder)
        bases = [int(n.split("=")[1]) for n, whole in names if n.startswith("base=") and whole]
        base = max(bases, default=-1)
        batches = [int(n.split("=")[1]) for n, whole in names if n.startswith("batch=") and whole]
        return base, sorted(b for b in batches if b > base)

    def _last(self, lines: DataFrame) -> DataFrame:
        rest = [c for c in lines.columns if c not in self.keys]
        order = F.struct(*self.order, "_batch")
        last = lines.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
        return last.select(*self.keys, "_last.*")

    def add(self, lines: DataFrame, number: int) -> None:
        """Write the lines of batch ``number``; of a key that it has several times, the last."""
        base, batches = self._parts()
        if number <= base:  # a repeated batch that has been merged already
            return
        numbered = self._last(lines.withColumn("_batch", F.lit(number).cast("bigint")))
        numbered.write.mode("overwrite").parquet(f"{self.folder}/batch={number}")
        if len(batches) + 1 >= COMPACT_EVERY:
            self.compact(number)

    def compact(self, number: int) -> None:
        """Merge everything up to batch ``number`` into one base and delete what it holds."""
        base, batches = self._parts()
        held = [b for b in batches if b <= number]
        self._read(base, held).write.mode("overwrite").parquet(f"{self.folder}/base={number}")
        for b in held:
            remove(self.spark, f"{self.folder}/batch={b}")
        if base >= 0:
            remove(self.spark, f"{self.folder}/base={base}")

    def _read(self, base: int, batches: Sequence[int]) -> DataFrame:
        paths = [f"{self.folder}/batch={b}" for b in batches]
        if base >= 0:
            paths.append(f"{self.folder}/base={base}")
        lines = self.spark.read.option("recursiveFileLookup", "true").parquet(*paths)
        return self._last(lines)

    def latest(self) -> DataFrame | None:
        """The table as it stands, or None if no batch has come yet."""
        base, batches = self._parts()
        if base < 0 and not batches:
            return None
        return self._read(base, batches).drop("_batch")
