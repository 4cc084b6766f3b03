"""Near-duplicate documents by a chosen-path set similarity join on minwise tokens.

A document is the set of its five-word shingles. Its signature holds the minwise token of
``COORDINATES`` permutations. A tree branches documents by the tokens of selected
permutations: documents that agree stay together. A node with at most ``SMALL`` documents is
compared exhaustively; larger nodes are branched again, each time by a fresh choice of
permutations drawn from the node's path, more than one on average, so that a similar pair
stays together on some path. ``TREES`` independent trees bring the recall to its target: a
pair at the threshold is missed by one tree with probability 0.15, by all with 0.15**10.

Equal sets are one set from the start. Nodes compare signatures only, keep pairs that may
reach the threshold (five standard deviations below it), and name the groups these pairs
form; a group's full sets are then fetched once and every link in it is confirmed on them.
Groups of any size are cut into blocks, so a task never holds more than two blocks, and it
returns at most one link per document: a spanning forest, not the pairs. Nodes that are
still large after ``DEPTH`` levels go the exact way too: blocks against blocks.

Defined cases: null texts and texts without words have no shingles and are linked with
nothing; fewer than five words make one shingle; an empty table gives an empty result; the
rows of one doc_id are one document: every one of its texts links, all of them are in one
component, and ``n_shingles`` is that of its largest set; rows with a null doc_id are left
out; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.llm.components import components
from pairlake.llm.hashing import Windows, mix, text_chunks
from pairlake.session import cut

SHINGLE = 5
COORDINATES = 64
TREES = 10
SMALL = 1024  # documents of a node that are compared exhaustively, and of a block
DEPTH = 6
ROWS_PER_BUCKET = 8192
CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_STEPS = mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_TURNS = mix(np.arange(501, 501 + COORDINATES, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a buffer."""
    data = _LOWER[data]
    space = _SPACE[data]
    inner = offsets[1:-1]
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    before[inner[inner < len(data)]] = True
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    after[inner[inner > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    words = Windows(data).between(starts, ends) + (ends - starts).astype(np.uint64)
    words = mix(words)
    first = np.searchsorted(starts, offsets)
    rolled = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for step in range(size):
        rolled += words[step : step + len(rolled)] * _STEPS[step]
    rolled = mix(rolled)
    sets = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            sets.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            short = (words[a:b] * _STEPS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            sets.append(mix(np.array([short], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets × COORDINATES) minwise tokens as 32 bits; all sets are non-empty."""
    sizes = np.array([len(s) for s in sets])
    tokens, begins = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for c in range(COORDINATES):
        out[:, c] = np.minimum.reduceat(tokens * _TURNS[c], begins) >> np.uint64(16)
    return out


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature) per row; the last two are null for no set."""

    def run(batches):
        for batch in batches:
            for ids, offsets, data in text_chunks(batch, 0, 1, CHUNK_BYTES):
                sets = shingle_sets(data, offsets)
                full = [s for s in sets if len(s)]
                signed = iter(signatures(full)) if full else iter(())
                keys, signs = [], []
                for s in sets:
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    signs.append(next(signed).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array(signs, pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "signature"],
                )

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text_col)
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(set_key, tokens) of the sets that ``wanted`` (set_key, doc_id) names, hashed anew."""

    def run(batches):
        for batch in batches:
            for ids, offsets, data in text_chunks(batch, 0, 1, CHUNK_BYTES):
                sets = shingle_sets(data, offsets)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                arrays = [pa.array(keys, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["set_key", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    # By shuffle at every size: the list of wanted sets grows with the corpus.
    asked = wanted.select("doc_id").hint("merge")
    rows = rows.join(asked, F.col("_id") == F.col("doc_id"), "left_semi")
    made = rows.mapInArrow(run, "set_key binary, tokens binary")
    # An id that is repeated with other texts brings sets that nobody asked for.
    return made.join(wanted.select("set_key"), "set_key", "left_semi")


class Forest:
    """Union-find over 0 … n-1 that remembers the links that joined two parts."""

    def __init__(self, n: int):
        self.up, self.links = np.arange(n), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))

    def roots(self, these: np.ndarray) -> np.ndarray:
        return np.array([self.root(i) for i in these])


def _agreeing(signs: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    return (signs[others] == signs[i]).sum(axis=1)


def _nodes_of(frame: pd.DataFrame):
    """(rows, signatures) of every node in a frame, in order of the node."""
    frame = frame.sort_values(["node", "set_id"], kind="stable")
    signs = np.frombuffer(b"".join(frame["signature"]), np.uint32).reshape(len(frame), -1)
    ids, nodes = frame["set_id"].to_numpy(), frame["node"].to_numpy()
    cuts = np.flatnonzero(nodes[1:] != nodes[:-1]) + 1
    yield from zip(np.split(ids, cuts), np.split(signs, cuts), strict=True)


def may_link(least: int):
    """Candidate links inside small nodes: a spanning forest of the pairs whose signatures
    agree in at least ``least`` coordinates."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for ids, signs in _nodes_of(frame):
            forest = Forest(len(ids))
            for i in range(len(ids) - 1):
                others = np.arange(i + 1, len(ids))
                for j in others[_agreeing(signs, i, others) >= least]:
                    forest.link(i, j)
            found += [(ids[i], ids[j]) for i, j in forest.links]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def sharable(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens of each set another set may have too: never fewer than it does.

    A token alone in its bucket of hashes is nobody else's.
    """
    bits = np.uint64((1 << 20) - 1)
    seen = np.zeros(1 << 20, np.int64)
    for s in sets:
        np.add.at(seen, s & bits, 1)
    return np.array([int((seen[s & bits] > 1).sum()) for s in sets])


def do_link(least: int, percent: int):
    """Confirmed links of a unit: a spanning forest of the pairs of sets at the threshold.

    Pairs that are connected already need no confirmation, and pairs whose sets hold too many
    tokens that no other set of the unit has cannot reach the threshold; all others are
    counted exactly.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, unit in frame.groupby("unit", sort=True):
            unit = unit.sort_values(["block", "set_id"], kind="stable")
            ids, blocks = unit["set_id"].to_numpy(), unit["block"].to_numpy()
            signs = np.frombuffer(b"".join(unit["signature"]), np.uint32).reshape(len(unit), -1)
            sets = [np.frombuffer(t, np.uint64) for t in unit["tokens"]]
            sizes = np.array([len(s) for s in sets])
            shared = sharable(sets)
            two = blocks[0] != blocks[-1]
            forest = Forest(len(ids))
            for i in range(len(ids) - 1):
                others = np.arange(i + 1, len(ids))
                if two:  # pairs inside a block are compared in the block's own unit
                    others = others[blocks[others] != blocks[i]]
                lo, hi = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
                both = np.minimum(shared[others], shared[i])
                others = others[(100 * lo >= percent * hi) & (100 * both >= percent * (lo + hi - both))]
                others = others[_agreeing(signs, i, others) >= least]
                if len(others):
                    others = others[forest.roots(others) != forest.root(i)]
                for at in range(0, len(others), 512):
                    part = others[at : at + 512]
                    tokens = np.concatenate([sets[j] for j in part])
                    place = np.minimum(np.searchsorted(sets[i], tokens), sizes[i] - 1)
                    hit = (sets[i][place] == tokens).astype(np.int64)
                    begins = np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
                    both = np.add.reduceat(hit, begins)
                    for j in part[100 * both >= percent * (sizes[part] + sizes[i] - both)]:
                        forest.link(i, j)
            found += [(ids[i], ids[j]) for i, j in forest.links]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _token(place) -> F.Column:
    """The minwise token at a 0-based coordinate of a signature."""
    return F.substring(F.col("signature"), place * 4 + 1, F.lit(4))


def branch(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, set_id) of small nodes, the same of nodes that stayed large), all trees.

    The first level takes one permutation per tree. Every further level of a large node
    takes one or two, 1 / 0.85 on average or more, drawn from its path.
    """
    trees = F.sequence(F.lit(0), F.lit(TREES - 1))
    grown = sets.select("set_id", "signature", F.explode(trees).alias("tree")).select(
        "set_id", F.xxhash64("tree", _token(F.col("tree"))).alias("node")
    )
    small = []
    for level in range(DEPTH):
        grown = cut(grown)
        counted = grown.groupBy("node").agg(F.count("*").alias("n")).filter("n >= 2")
        there = grown.join(counted, "node")
        small.append(there.filter(F.col("n") <= SMALL).select("node", "set_id"))
        large = there.filter(F.col("n") > SMALL).select("node", "set_id")
        if level == DEPTH - 1 or large.isEmpty():
            break
        pick = F.pmod(F.xxhash64("node", F.col("twig")), F.lit(COORDINATES - TREES)).cast("int") + TREES
        grown = (
            large.withColumn("twigs", F.when(F.pmod(F.xxhash64("node"), F.lit(3)) == 0, 2).otherwise(1))
            .withColumn("twig", F.explode(F.sequence(F.lit(1), F.col("twigs"))))
            .join(sets.select("set_id", "signature"), "set_id")
            .select("set_id", F.xxhash64("node", "twig", _token(pick)).alias("node"))
        )
    every = small[0]
    for part in small[1:]:
        every = every.unionByName(part)
    return every, large


def near_duplicates(
    docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document id.

    Documents whose sets share at least ``percent`` / 100 of their union are linked;
    a component is named by its smallest id, which is the one that is kept.
    """
    described = describe(docs, id_col, text_col).groupBy("doc_id", "set_key")
    rows = cut(described.agg(F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")))
    share = percent / 100
    least = int(COORDINATES * share - 5 * (COORDINATES * share * (1 - share)) ** 0.5)
    sets = cut(
        rows.filter(F.col("set_key").isNotNull())
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("set_id"), F.first("signature").alias("signature"))
    )
    small, large = branch(sets)
    candidates = small.distinct().join(sets.select("set_id", "signature"), "set_id")
    parts = max(1, candidates.count() // ROWS_PER_BUCKET)
    groups = components(
        candidates.withColumn("bucket", F.pmod(F.col("node"), F.lit(parts)))
        .repartition(parts, "bucket")
        .groupBy("bucket")
        .applyInPandas(may_link(least), "a long, b long")
        .unionByName(_joined(large))
    )
    edges = _confirm(docs, sets, groups, least, percent, id_col, text_col)
    owner = sets.select("set_key", "set_id")
    # A set is named by its smallest document. Two sets of one name are both that document's,
    # so they are one component anyway; other sets of one document are linked here.
    told = rows.select("doc_id", "n_shingles", "set_key").join(owner, "set_key", "left")
    documents = cut(
        told.groupBy("doc_id").agg(
            F.max("n_shingles").alias("n_shingles"), F.min("set_id").alias("a"), F.max("set_id").alias("z")
        )
    )
    several = documents.filter("a < z").select("doc_id", "a")
    own = told.join(several, "doc_id").select("a", F.col("set_id").alias("b")).filter("a < b")
    linked = components(edges.unionByName(own))
    component = F.coalesce("component", "a", "doc_id")
    return documents.join(linked, F.col("a") == F.col("node"), "left").select(
        F.col("doc_id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        (component == F.col("doc_id")).alias("kept"),
    )


def _joined(large: DataFrame) -> DataFrame:
    """All documents of a node that stayed large, linked to its smallest one."""
    least = large.groupBy("node").agg(F.min("set_id").alias("b"))
    return large.join(least, "node").select(F.col("set_id").alias("a"), "b")


def _confirm(docs, sets, groups, least, percent, id_col, text_col) -> DataFrame:
    """Exact links inside every group, blocks against blocks."""
    groups = cut(groups)
    sizes = groups.groupBy("component").agg(
        F.ceil(F.count("*") / F.lit(SMALL)).cast("long").alias("blocks")
    )
    members = (
        groups.join(sizes, "component")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            F.col("node").alias("set_id"),
            "block",
            F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("unit"),
        )
    )
    wanted = cut(sets.join(groups.select(F.col("node").alias("set_id")), "set_id", "left_semi"))
    tokens = full_sets(docs, wanted.select("set_key", F.col("set_id").alias("doc_id")), id_col, text_col)
    told = wanted.join(tokens.dropDuplicates(["set_key"]), "set_key").select("set_id", "signature", "tokens")
    parts = max(1, 4 * members.count() // SMALL)
    return cut(
        members.join(told, "set_id")
        .withColumn("bucket", F.pmod(F.col("unit"), F.lit(parts)))
        .repartition(parts, "bucket")
        .groupBy("bucket")
        .applyInPandas(do_link(least, percent), "a long, b long")
    )
