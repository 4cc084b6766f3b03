"""Exact top-k inner products: branch and bound over one ball tree per shard.

The index is a table with one row per shard: vectors in leaf order, and the nodes' centres
and radii. A query cannot score more than ``q·centre + |q|·radius`` in a ball, nor more than
in the ball around it. Every query walks down from the root: of the nodes it has in reach it
opens the one with the highest bound, which brings its two children, or a leaf's scores; when
the highest bound is below the k-th score it knows, it is done, and whatever lies below the
nodes left is never looked at, nor bounded.

Shards share that score: a block of queries searches one shard first, then two, four and so
on, and starts in each with the k-th score found in all before.

Scores are exact: integers are multiplied as doubles only where all partial sums stay below
2**53, as 64-bit integers below 2**63, as Python's integers otherwise.

Defined cases: see ``vectors.usable`` for what takes part; vectors of different length never
meet; a query is not its own candidate; ties go to the smaller id; scores that 64 bits cannot
hold count as the largest or smallest number that they can; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.llm.vectors import best, pack, run_units, top_rows, units, unpack, usable
from pairlake.session import cut

SHARD_ROWS = 4096
BLOCK_ROWS = 1024
LEAF_ROWS = 64
NONE = np.iinfo(np.int64).min  # no score: no product is as small
INDEX = (
    "dim int, shard long, ids binary, matrix binary, centres binary, radii binary, "
    "parents binary, leaf_nodes binary, leaf_starts binary"
)


def build_tree(matrix: np.ndarray, leaf_rows: int = LEAF_ROWS):
    """(order of rows, centres, radii, parent of each node, leaf nodes, first row of each leaf)."""
    points = matrix.astype(np.float64)
    centres, radii, parents, leaf_nodes, starts, order = [], [], [], [], [], []
    stack = [(np.arange(len(points)), -1)]
    while stack:
        rows, parent = stack.pop()
        node, own = len(parents), points[rows]
        centre = own.mean(axis=0)
        away = np.sqrt(((own - centre) ** 2).sum(axis=1))
        centres.append(centre)
        radii.append(away.max())
        parents.append(parent)
        if len(rows) <= leaf_rows or away.max() == 0:
            leaf_nodes.append(node)
            starts.append(len(order))
            order.extend(rows.tolist())
            continue
        far = own[away.argmax()]
        further = own[((own - far) ** 2).sum(axis=1).argmax()]
        along = np.argsort(own @ (further - far), kind="stable")
        half = len(rows) // 2
        stack += [(rows[along[half:]], node), (rows[along[:half]], node)]
    return (
        np.array(order), np.array(centres), np.array(radii),
        np.array(parents, np.int64), np.array(leaf_nodes, np.int64), np.array([*starts, len(order)], np.int64),
    )


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard, from (vec_id, vector of whole numbers)."""

    def grow(row: dict) -> pd.DataFrame:
        ids, matrix = unpack(row, "int64")
        order, *tree = build_tree(matrix)
        packed = [ids[order], matrix[order], *tree]
        values = [row["dim"], row["shard"], *[np.ascontiguousarray(x).tobytes() for x in packed]]
        return pd.DataFrame([values], columns=[c.split()[0] for c in INDEX.split(", ")])

    return run_units(pack(vectors, "shard", shard_rows, "int64"), grow, INDEX)


def _products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact inner products as int64, clipped to it where they leave it."""
    most = int(np.abs(queries.astype(np.float64)).max(initial=0)) * int(np.abs(points.astype(np.float64)).max(initial=0))
    if most * queries.shape[1] < 2**53:
        return (queries.astype(np.float64) @ points.astype(np.float64).T).astype(np.int64)
    if most * queries.shape[1] < 2**62:
        return queries @ points.T
    exact = queries.astype(object) @ points.astype(object).T
    return np.clip(exact, NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


class Tree:
    """One shard's tree, opened node by node."""

    def __init__(self, row: dict):
        self.ids, self.points = unpack(row, "int64")
        self.radii = np.frombuffer(row["radii"], np.float64)
        self.centres = np.frombuffer(row["centres"], np.float64).reshape(len(self.radii), -1)
        parents = np.frombuffer(row["parents"], np.int64)
        self.children: list[list[int]] = [[] for _ in parents]
        for node in range(1, len(parents)):
            self.children[parents[node]].append(node)
        starts = np.frombuffer(row["leaf_starts"], np.int64)
        leaves = np.frombuffer(row["leaf_nodes"], np.int64).tolist()
        self.rows = {leaf: slice(a, b) for leaf, a, b in zip(leaves, starts[:-1], starts[1:], strict=True)}

    def bound(self, node: int, queries: np.ndarray, length: np.ndarray) -> np.ndarray:
        most = queries @ self.centres[node] + length * self.radii[node]
        return most + 1e-9 * (1 + np.abs(most)) + 1e-6  # rounding must not cut a branch


def search_tree(tree: Tree, q_ids: np.ndarray, queries: np.ndarray, known: np.ndarray, k: int):
    """(scores, ids, nodes bounded): the ``k`` best of every query, as far as they may be
    among its best overall, whose k-th score so far is ``known``."""
    exact = queries.astype(np.float64)
    length = np.sqrt((exact**2).sum(axis=1))
    reach = np.full((len(q_ids), len(tree.radii)), -np.inf)
    reach[:, 0] = tree.bound(0, exact, length)
    bounded = len(q_ids)
    scores = np.full((len(q_ids), k), NONE)
    found = np.full((len(q_ids), k), np.iinfo(np.int64).max)
    active = np.arange(len(q_ids))
    while len(active):
        pick = reach[active].argmax(axis=1)
        best_left = reach[active, pick]
        floor = np.maximum(known[active], scores[active, -1])
        going = (best_left > -np.inf) & (best_left >= floor)
        active, pick, best_left, floor = active[going], pick[going], best_left[going], floor[going]
        reach[active, pick] = -np.inf
        for node in np.unique(pick).tolist():
            here = pick == node
            who = active[here]
            for child in tree.children[node]:
                inner = tree.bound(child, exact[who], length[who])
                reach[who, child] = np.minimum(inner, best_left[here])
                bounded += len(who)
            if node in tree.rows:
                part = tree.rows[node]
                new = _products(queries[who], tree.points[part])
                new[tree.ids[part][None, :] == q_ids[who][:, None]] = NONE
                better = np.flatnonzero(new.max(axis=1) >= floor[here])
                if len(better):
                    rows = who[better]
                    both = np.hstack([scores[rows], new[better]])
                    names = np.hstack([found[rows], np.broadcast_to(tree.ids[part], new[better].shape)])
                    scores[rows], found[rows] = top_rows(both, names, k)
    return scores, found, bounded


def search_shard(row: dict, k: int) -> pd.DataFrame:
    """The best candidates of a block of queries in a shard that may still be among the k."""
    q_ids = np.frombuffer(row["q_ids"], np.int64)
    queries = np.frombuffer(row["q_matrix"], np.int64).reshape(len(q_ids), -1)
    known = np.full(len(q_ids), NONE)
    if row.get("known") is not None:
        known = np.frombuffer(row["known"], np.int64)
    scores, found, _ = search_tree(Tree(row), q_ids, queries, known, k)
    keep = (scores >= known[:, None]) & (scores > NONE)
    at = np.nonzero(keep)
    return pd.DataFrame({"query_id": q_ids[at[0]], "vec_id": found[keep], "score": scores[keep]})


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of every query.

    Both tables have vec_id and vector (whole numbers as bigint).
    """
    shards = cut(build_index(vectors, shard_rows))
    blocks = cut(pack(queries, "block", block_rows, "int64"))
    out = "query_id long, vec_id long, score long"
    counts = shards.groupBy("dim").agg(F.max("shard").alias("last"))
    # Shards in turn from one that differs from block to block: the first is turn 0.
    turn = F.pmod(F.col("shard") - F.col("block"), F.col("last") + 1)
    pairs = cut(
        blocks.select("dim", "block")
        .join(counts, "dim")
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
        .select("dim", "block", "shard", turn.alias("turn"))
    )
    tasks = max(2, shards.count())
    turns = pairs.agg(F.max("turn")).first()[0]
    ranked = best(shards.sparkSession.createDataFrame([], out), k, F.col("score"))
    begin, end = 0, 1
    while turns is not None and begin <= turns:
        kth = (
            ranked.groupBy("query_id")
            .agg(F.min("score").alias("known"), F.count("*").alias("n"))
            .filter(F.col("n") == k)
        )
        asked = _with_known(blocks, kth) if begin else blocks
        wave = pairs.filter((F.col("turn") >= begin) & (F.col("turn") < end)).drop("turn")
        found = run_units(units(shards, asked, wave, tasks), lambda row: search_shard(row, k), out)
        ranked = cut(best(ranked.drop("rank").unionByName(found), k, F.col("score")))
        begin, end = end, 2 * end + 1
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _with_known(blocks: DataFrame, kth: DataFrame) -> DataFrame:
    """Blocks with the k-th score that each of their queries knows so far."""

    def ids_of(frames):
        for frame in frames:
            for row in frame.to_dict("records"):
                ids = np.frombuffer(row["ids"], np.int64)
                yield pd.DataFrame({"dim": row["dim"], "block": row["block"], "query_id": ids})

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("query_id")
        known = frame["known"].to_numpy(np.int64).tobytes()
        return pd.DataFrame({"dim": [frame["dim"].iloc[0]], "block": [frame["block"].iloc[0]], "known": [known]})

    listed = blocks.select("dim", "block", "ids").mapInPandas(
        ids_of, "dim int, block long, query_id long"
    )
    filled = listed.join(kth.select("query_id", "known"), "query_id", "left").fillna(
        int(NONE), ["known"]
    )
    packed = filled.groupBy("dim", "block").applyInPandas(fold, "dim int, block long, known binary")
    return blocks.join(packed, ["dim", "block"])


def whole_numbers(vectors: DataFrame, scale: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector): every component x as floor(scale * x), computed in doubles."""
    return usable(vectors, id_col, vector_col).select(
        "vec_id", F.transform("vector", lambda x: F.floor(F.lit(scale) * x).cast("long")).alias("vector")
    )
