"""Vector tables as shards and query blocks: shared by the exact and the approximate search.

Vectors are dealt to shards by a hash of their id and packed, one row per shard; queries are
packed into blocks. A search unit is one (shard, block) pair: a bounded piece of work, and
nothing else ever meets in a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PACK = "dim int, {key} long, n int, ids binary, matrix binary"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector as doubles): vectors without null or non-finite components, one per
    id (the smallest, if an id has several); null ids and empty vectors are left out."""
    fine = F.forall(
        vector_col,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return (
        vectors.filter(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & fine)
        .select(
            F.col(id_col).cast("long").alias("vec_id"),
            F.transform(vector_col, lambda x: x.cast("double")).alias("vector"),
        )
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"))
    )


def pack(rows: DataFrame, key: str, size: int, dtype: str) -> DataFrame:
    """One row per (dim, key): ids (int64) and the matrix, in order of ids.

    Rows (vec_id, vector) are dealt to about ``rows / size`` keys by a hash of the id. The
    count of rows is the only thing that reaches the driver.
    """
    parts = max(1, -(-rows.count() // size))
    dealt = rows.select(
        F.size("vector").alias("dim"),
        F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("long").alias(key),
        "vec_id",
        "vector",
    )

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        matrix = np.stack(frame["vector"].to_numpy()).astype(dtype)
        return pd.DataFrame(
            {
                "dim": [frame["dim"].iloc[0]],
                key: [frame[key].iloc[0]],
                "n": [len(frame)],
                "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()],
                "matrix": [matrix.tobytes()],
            }
        )

    return dealt.repartition(parts, "dim", key).groupBy("dim", key).applyInPandas(
        together, PACK.format(key=key)
    )


def unpack(row, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["matrix"], dtype).reshape(len(ids), -1)


def units(shards: DataFrame, blocks: DataFrame, pairs: DataFrame, tasks: int) -> DataFrame:
    """Shard and block side by side for every (dim, shard, block) of ``pairs``."""
    asked = blocks.select(
        "dim", "block", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"),
        *[c for c in blocks.columns if c not in ("dim", "block", "n", "ids", "matrix")],
    )
    dealt = pairs.join(asked, ["dim", "block"]).repartition(tasks, "dim", "shard")
    return dealt.join(shards.repartition(tasks, "dim", "shard"), ["dim", "shard"])


def best(found: DataFrame, k: int, score: Column) -> DataFrame:
    """The ``k`` best (query_id, vec_id) by score, ties to the smaller id, ranked from 1."""
    order = Window.partitionBy("query_id").orderBy(score.desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_rows(
    scores: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Per row the ``k`` highest whole scores with their ids, ties to the smaller id."""
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]  # ~ turns the order and never overflows
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def run_units(frame: DataFrame, search: Callable, schema: str) -> DataFrame:
    """``search(row) -> pandas frame`` for every unit."""

    def run(frames):
        for batch in frames:
            for row in batch.to_dict("records"):
                yield search(row)

    return frame.mapInPandas(run, schema)
