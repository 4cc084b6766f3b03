"""Approximate nearest neighbours: one navigable small-world graph per shard, results merged.

The index is a table with one row per shard: ids, vectors, and the graph's levels as flat
neighbour arrays (level 0 first; ``width`` slots per node, -1 where a slot is free). Levels
are built from the top. A node is inserted into a level by walking it: down the levels above,
which gives a node to begin with, and through the graph as it stands, with a beam of
``CANDIDATES`` nodes; of those met a diverse choice is linked both ways. Nodes are inserted a
batch at a time, never more than an eighth of those already there, and walk together; they
see each other besides.

A search descends greedily from the entry node to level 1 and sweeps level 0 with a beam of
``ef`` nodes; all queries of a block move together. Vectors are normalised to unit length
for the walk; scores are cosines of the original vectors, computed pair by pair.

Equal vectors share one node (``same_as``): copies would otherwise fill each other's
neighbour lists and cut the graph. A found node stands for all its copies; of them only the
``k + 1`` smallest ids can be among the answers.

Defined cases: see ``vectors.usable`` for what takes part; zero vectors take no part;
vectors of different length never meet; a query is not its own candidate; ties go to the
smaller id; an empty table gives an empty result. Recall is measured against brute force in
the tests and stated in the README.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlake.llm.vectors import best, pack, run_units, units, unpack, usable
from pairlake.session import cut

SHARD_ROWS = 4096
BLOCK_ROWS = 512
LINKS = 16  # links of a node on upper levels; twice as many on level 0
CANDIDATES = 64  # nodes that a walk at insertion keeps
BATCH = 128  # nodes inserted together, at most
BEAM = 96
INDEX = (
    "dim int, shard long, ids binary, matrix binary, entry long, sizes binary, members binary, "
    "neighbours binary"
)


def _unit(matrix: np.ndarray) -> np.ndarray:
    scale = np.abs(matrix).max(axis=1, keepdims=True)  # avoids overflow of the squares
    matrix = matrix / scale
    return matrix / np.sqrt((matrix**2).sum(axis=1, keepdims=True))


def _diverse(near: np.ndarray, sims: np.ndarray, between: np.ndarray, most: int) -> list[int]:
    """Of ``near`` (nearest first) those that are nearer to the node than to a chosen one;
    the nearest of the others fill the free slots."""
    chosen, hidden = [], np.zeros(len(near), bool)
    for i in range(len(near)):
        if not hidden[i]:
            chosen.append(i)
            if len(chosen) == most:
                break
            hidden |= between[i] > sims
    if len(chosen) < most:
        chosen += [i for i in range(len(near)) if hidden[i] and i not in chosen][: most - len(chosen)]
    return near[chosen].tolist()


class Level:
    """One level of a graph: neighbours of its nodes (rows of ``points``), free slots -1."""

    def __init__(self, points: np.ndarray, width: int):
        self.points, self.width = points, width
        # Lists grow a little beyond the width and are pruned now and then, not every time.
        self.links = np.full((len(points), width + width // 2), -1, np.int32)
        self.held = np.zeros(len(points), np.int32)

    def _choose(self, node: int, near: np.ndarray, most: int) -> list[int]:
        vectors = self.points[near]
        close = vectors @ self.points[node]
        order = np.lexsort((near, -close))
        vectors = vectors[order]
        return _diverse(near[order], close[order], vectors @ vectors.T, most)

    def _set(self, node: int, chosen: list[int]) -> None:
        self.links[node] = -1
        self.links[node, : len(chosen)] = chosen
        self.held[node] = len(chosen)

    def insert(self, node: int, near: np.ndarray) -> None:
        """Link ``node`` and a diverse choice of ``near`` both ways."""
        if not len(near):
            return
        self._set(node, self._choose(node, near, max(1, self.width // 2)))
        for other in self.links[node, : self.held[node]].tolist():
            if self.held[other] == self.links.shape[1]:
                self._set(other, self._choose(other, self.links[other], self.width))
            self.links[other, self.held[other]] = node
            self.held[other] += 1

    def flat(self) -> np.ndarray:
        for node in np.flatnonzero(self.held > self.width).tolist():
            self._set(node, self._choose(node, self.links[node, : self.held[node]], self.width))
        return self.links[:, : self.width]


def build_level(points: np.ndarray, width: int, candidates: int, begins: np.ndarray) -> np.ndarray:
    """Neighbour array (n × width) of one level; nodes are inserted in the order of rows.

    ``begins`` are the nodes where the walks begin.
    """
    level, n, done = Level(points, width), len(points), 0
    while done < n:
        batch = np.arange(done, min(n, done + max(1, min(BATCH, done // 8))))
        between = points[batch] @ points[batch].T
        if done:
            queries = points[batch]
            at = np.where(begins[batch] < done, begins[batch], 0)  # a node that is there already
            sims = np.einsum("qd,qd->q", queries, points[at])
            _, met = sweep(points, level.links, at, sims, queries, min(candidates, done))
        for row, node in enumerate(batch.tolist()):
            near = met[row][met[row] >= 0] if done else np.zeros(0, np.int64)
            # Earlier nodes of the batch are candidates too, the nearest of them.
            own = np.argsort(-between[row, :row], kind="stable")[:candidates]
            level.insert(node, np.concatenate([near, batch[own]]))
        done = int(batch[-1]) + 1
    return level.flat()


def build_graph(ids: np.ndarray, matrix: np.ndarray, links: int = LINKS, candidates: int = CANDIDATES):
    """(entry, nodes per level, members of each level, neighbours of each level)."""
    points = _unit(matrix)
    # A node's top level is drawn from a hash of its id: the same graph on every run.
    spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(32)
    draw = ((spread * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(11)).astype(np.float64) / 2**53
    level = np.floor(-np.log(np.maximum(draw, 1e-300)) / np.log(links)).astype(int)
    # Nodes of higher levels come first in every level: walks from above begin at nodes
    # that are there already.
    order = np.argsort(-level, kind="stable")
    members, neighbours = [], []
    for step in range(level.max(), -1, -1):
        held = order[: int((level >= step).sum())].astype(np.int32)
        place = np.full(len(points), -1)
        place[held] = np.arange(len(held))
        if members:
            begins = place[descend(points, int(order[0]), members[::-1], neighbours[::-1], points[held], 0)[0]]
        else:
            begins = np.zeros(len(held), np.int64)
        flat = build_level(points[held], 2 * links if step == 0 else links, candidates, begins)
        by_node = np.argsort(held)  # level 0 is looked up by node
        members.append(held[by_node])
        neighbours.append(np.where(flat >= 0, held[np.maximum(flat, 0)], -1).astype(np.int32)[by_node])
    members, neighbours = members[::-1], neighbours[::-1]
    return int(order[0]), [len(m) for m in members], members, neighbours


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard, from (vec_id, vector)."""

    def grow(row: dict) -> pd.DataFrame:
        ids, matrix = unpack(row, "float64")
        entry, sizes, members, neighbours = build_graph(ids, matrix)
        values = [
            row["dim"], row["shard"], row["ids"], row["matrix"], entry,
            np.array(sizes, np.int64).tobytes(), np.concatenate(members).tobytes(),
            np.concatenate([x.ravel() for x in neighbours]).tobytes(),
        ]
        return pd.DataFrame([values], columns=[c.split()[0] for c in INDEX.split(", ")])

    return run_units(pack(vectors, "shard", shard_rows, "float64"), grow, INDEX)


def descend(points, entry, members, neighbours, queries, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, similarity) per query: greedily from the entry through the levels down to ``last``."""
    n, asked = len(points), len(queries)
    everyone = np.arange(asked)
    at = np.full(asked, entry)
    sims = queries @ points[entry]
    for step in range(len(members) - 1, last - 1, -1):
        place = np.full(n, -1)
        place[members[step]] = np.arange(len(members[step]))
        moving = everyone
        while len(moving):
            around = neighbours[step][place[at[moving]]]
            close = np.einsum("qwd,qd->qw", points[np.maximum(around, 0)], queries[moving])
            close[around < 0] = -np.inf
            to = close.argmax(axis=1)
            nearer = close[np.arange(len(moving)), to] > sims[moving]
            moving, to, around, close = moving[nearer], to[nearer], around[nearer], close[nearer]
            rows = np.arange(len(moving))
            at[moving], sims[moving] = around[rows, to], close[rows, to]
    return at, sims


def sweep(points, links, at, sims, queries, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(similarities, nodes), ``ef`` per query, nearest first; -inf and -1 where fewer were met.

    The beams begin at the nodes ``at`` (with similarities ``sims``) and follow ``links``.
    """
    n, asked = len(points), len(queries)
    everyone = np.arange(asked)
    beam = np.full((asked, ef), -1)
    score = np.full((asked, ef), -np.inf)
    done = np.ones((asked, ef), bool)
    beam[:, 0], score[:, 0], done[:, 0] = at, sims, False
    visited = np.zeros((asked, n), bool)
    visited[everyone, at] = True
    moving = everyone
    while len(moving):
        waiting = np.where(done[moving], -np.inf, score[moving])
        pick = waiting.argmax(axis=1)
        more = waiting[np.arange(len(moving)), pick] > -np.inf
        moving, pick = moving[more], pick[more]
        if not len(moving):
            break
        done[moving, pick] = True
        around = links[beam[moving, pick]]
        fresh = (around >= 0) & ~visited[moving[:, None], np.maximum(around, 0)]
        rows, cols = np.nonzero(fresh)
        visited[moving[rows], around[rows, cols]] = True
        close = np.full(around.shape, -np.inf)
        close[rows, cols] = np.einsum("rd,rd->r", points[around[rows, cols]], queries[moving[rows]])
        useful = np.flatnonzero(close.max(axis=1) > score[moving].min(axis=1))
        if not len(useful):
            continue
        who = moving[useful]
        all_scores = np.hstack([score[who], close[useful]])
        all_nodes = np.hstack([beam[who], around[useful]])
        all_done = np.hstack([done[who], ~fresh[useful]])
        order = np.argpartition(-all_scores, ef - 1, axis=1)[:, :ef]
        score[who] = np.take_along_axis(all_scores, order, 1)
        beam[who] = np.take_along_axis(all_nodes, order, 1)
        done[who] = np.take_along_axis(all_done, order, 1) | (score[who] == -np.inf)
    order = np.lexsort((beam, -score), axis=1)
    score, beam = np.take_along_axis(score, order, 1), np.take_along_axis(beam, order, 1)
    return score, np.where(score > -np.inf, beam, -1)


def search_graph(points, entry, members, neighbours, queries, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(similarities, nodes), ``ef`` per query, nearest first."""
    at, sims = descend(points, entry, members, neighbours, queries, 1)
    return sweep(points, neighbours[0], at, sims, queries, ef)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in doubles; the same pair of vectors always gives the same value."""
    dot, aa, bb = (np.einsum("rd,rd->r", x, y) for x, y in ((a, b), (a, a), (b, b)))
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def search_shard(row: dict, k: int, ef: int) -> pd.DataFrame:
    """(query_id, vec_id, score): the nodes nearest to each query of a block in a shard."""
    ids, matrix = unpack(row, "float64")
    q_ids = np.frombuffer(row["q_ids"], np.int64)
    originals = np.frombuffer(row["q_matrix"], np.float64).reshape(len(q_ids), -1)
    sizes = np.frombuffer(row["sizes"], np.int64)
    members = np.split(np.frombuffer(row["members"], np.int32), np.cumsum(sizes)[:-1])
    width = [2 * LINKS if step == 0 else LINKS for step in range(len(sizes))]
    flat = np.frombuffer(row["neighbours"], np.int32)
    cuts = np.cumsum([s * w for s, w in zip(sizes, width, strict=True)])[:-1]
    neighbours = [x.reshape(-1, w) for x, w in zip(np.split(flat, cuts), width, strict=True)]
    beam = min(ef, len(ids))
    _, nodes = search_graph(_unit(matrix), row["entry"], members, neighbours, _unit(originals), beam)
    nodes = nodes[:, : k + 1]  # one of them may be the query itself
    at, slot = np.nonzero(nodes >= 0)
    found = nodes[at, slot]
    return pd.DataFrame(
        {"query_id": q_ids[at], "vec_id": ids[found], "score": cosines(originals[at], matrix[found])}
    )


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, ef: int = BEAM, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` nearest by cosine, nearest first.

    Both tables have vec_id and vector (see ``directions``).
    """
    order = Window.partitionBy("vector").orderBy("vec_id")
    copies = cut(
        vectors.withColumn("copy", F.row_number().over(order)).filter(F.col("copy") <= k + 1)
    )
    nodes = copies.filter(F.col("copy") == 1).select("vec_id", "vector")
    same_as = (
        copies.filter(F.col("copy") > 1)
        .select(F.col("vec_id").alias("copy_id"), "vector")
        .join(nodes, "vector")
        .select("vec_id", "copy_id")
    )
    index = cut(build_index(nodes, shard_rows))
    blocks = cut(pack(queries, "block", BLOCK_ROWS, "float64"))
    counts = index.groupBy("dim").agg(F.max("shard").alias("last"))
    pairs = (
        blocks.select("dim", "block")
        .join(counts, "dim")
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
        .drop("last")
    )
    tasks = max(2, index.count())
    met = run_units(
        units(index, blocks, pairs, tasks),
        lambda row: search_shard(row, k, ef),
        "query_id long, vec_id long, score double",
    )
    met = best(met, k + 1, F.col("score")).drop("rank")  # nodes of all shards merged
    expanded = met.unionByName(
        met.join(same_as, "vec_id").select("query_id", F.col("copy_id").alias("vec_id"), "score")
    )
    ranked = best(expanded.filter("query_id <> vec_id"), k, F.col("score"))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def directions(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the vectors that have a direction."""
    return usable(vectors, id_col, vector_col).filter(F.exists("vector", lambda x: x != 0))
