"""Removal of repeated byte strings: a blockwise suffix sort with a difference cover.

Two suffixes matter to each other if their first ``length`` bytes agree. With a difference
cover D modulo v, any two suffixes have a common shift below v at which both stand on a
sampled position (position mod v in D), and there they still agree in ``length - v + 1``
bytes. So:

1. Cover sample. The sampled suffixes, about |D| / v of all, are ranked by their first
   ``length - v + 1`` bytes. Ranks are dealt to buckets; one bucket is sorted at a time.
   A sample whose rank nobody shares ends every tie that passes through it.
2. Suffix buckets. Only suffixes with a shared sample rank can have a tie of ``length``
   bytes. They are dealt to buckets by the key of their first ``length`` bytes, and again
   one bucket is sorted at a time; of every tie the first document counts.

Order is that of 64-bit keys of the bytes (a fixed order: ties are what is asked for, not
the alphabet), so comparisons never run along long copies; ties of keys are taken for ties of
bytes and not compared once more. Documents are cut into chunks by
ascending id, so the first document of a tie is found from chunk numbers alone. What moves:
the compressed texts once, and the sorted keys of each (chunk, bucket), distinct and
difference-coded: about one byte per byte of sample and of repeated text. Answers are one
bit per key. Every task holds one chunk or one bucket. Whole copies are settled first, by
digest; they take no part in the sort.

The width of the keys follows from the size of the corpus (``key_bits``): samples need few
enough false ties to stay a filter, suffixes none at all.

Defined cases: null and empty texts have no bytes; texts below ``length`` bytes keep all;
rows of one id never remove each other's bytes; rows with a null id keep all their bytes
and remove nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.llm.digests import digest
from pairlake.llm.hashing import Windows
from pairlake.operators.positions import with_running_total
from pairlake.session import cut

# A difference cover modulo 21 (fixed values): every residue is a difference of two of them.
MODULUS, COVER = 21, (0, 1, 6, 8, 18)
CHUNK_BYTES = 4 << 20
BUCKET_KEYS = 2_000_000
BLOB = "bucket long, chunk long, n long, keys binary"
MASK = "chunk long, kind int, bucket long, bits binary"
RESULT = (
    "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
)


def key_bits(total_bytes: int) -> tuple[int, int]:
    """Bits of a sample's key, and of the second key that suffixes carry beside 64 bits."""
    size = max(int(total_bytes), 2).bit_length()
    return min(64, size + 10), max(0, 2 * size + 4 - 64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences, byte plane by byte plane, without empty planes."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    planes = np.ascontiguousarray(gaps).view(np.uint8).reshape(-1, 8).T
    used = max(1, int(np.flatnonzero(planes.any(axis=1)).max(initial=0)) + 1)
    return np.ascontiguousarray(planes[:used]).tobytes()


def unpack_keys(blob: bytes, n: int) -> np.ndarray:
    planes = np.zeros((8, n), np.uint8)
    held = np.frombuffer(blob, np.uint8).reshape(-1, n)
    planes[: len(held)] = held
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted 64-bit keys; buckets are equal ranges of keys."""
    width = 2**64 // buckets + 1
    bounds = np.array([min(b * width, 2**64 - 1) for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, bounds), len(keys))


class Chunk:
    """The documents of a chunk in order of their ids, without whole copies."""

    def __init__(self, texts: pa.Table, copies: set[int], length: int):
        docs = []
        for row in texts.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            sizes = np.frombuffer(row["sizes"], np.int64)
            data = pa.decompress(row["payload"], int(sizes.sum()), "zstd", asbytes=True) if sizes.sum() else b""
            ends = np.cumsum(sizes)
            docs += [(int(i), data[e - s : e]) for i, s, e in zip(ids, sizes, ends, strict=True)]
        docs.sort()
        self.length = length
        self.copies = [(i, t) for i, t in docs if i in copies]
        docs = [(i, t) for i, t in docs if i not in copies]
        self.ids = np.array([i for i, _ in docs], np.int64)
        self.data = np.frombuffer(b"".join(t for _, t in docs), np.uint8)
        self.sizes = np.array([len(t) for _, t in docs], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        # Rows of one id are one document.
        self.number = np.cumsum(np.diff(self.ids, prepend=self.ids[:1]) != 0) if docs else self.ids
        self.windows = Windows(self.data)
        self.owner = None

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        if self.owner is None:
            self.owner = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        return self.owner[places]

    def samples(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, key) of every sampled suffix."""
        head = self.length - MODULUS + 1
        most = int(self.sizes.max(initial=0))
        grid = np.arange(0, most, MODULUS)[:, None] + np.array(COVER)
        grid = grid.ravel()
        parts = [np.zeros(0, np.int64)]
        for begin, size in zip(self.offsets[:-1], self.sizes, strict=True):
            if size >= self.length:
                parts.append(grid[: np.searchsorted(grid, size - head, side="right")] + begin)
        places = np.concatenate(parts)
        keys = self.windows.between(places, places + head)
        drop = np.uint64(64 - bits)
        return places, keys >> drop << drop

    def candidates(self, at: np.ndarray) -> np.ndarray:
        """Starts of all suffixes that have one of the (shared) samples in reach."""
        doc = self.doc_of(at)
        low = np.maximum(at - MODULUS + 1, self.offsets[doc])
        high = np.minimum(at, self.offsets[doc] + self.sizes[doc] - self.length)
        fine = low <= high
        return np.flatnonzero(_covered(low[fine], high[fine] + 1, len(self.data)))

    def suffix_keys(self, starts: np.ndarray, extra: int) -> np.ndarray:
        """Keys of the first ``length`` bytes; with ``extra`` bits a second column."""
        first = self.windows.between(starts, starts + self.length)
        if not extra:
            return first[:, None]
        second = Windows(self.data, seed=1).between(starts, starts + self.length)
        return np.stack([first, second >> np.uint64(64 - min(extra, 64))], axis=1)


def _covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    change = np.bincount(starts, minlength=size + 1)
    change -= np.bincount(ends, minlength=size + 1)
    return np.cumsum(change[:size], dtype=np.int32) > 0


def _changes(ranked: np.ndarray) -> np.ndarray:
    """Which rows of sorted keys (one or two columns) differ from the row before them."""
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:, 0] != ranked[:-1, 0]
    if ranked.shape[1] == 2:
        new[1:] |= ranked[1:, 1] != ranked[:-1, 1]
    return new


def _order(keys: np.ndarray) -> np.ndarray:
    if keys.shape[1] == 1:
        return np.argsort(keys[:, 0])
    return np.lexsort((keys[:, 1], keys[:, 0]))


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct rows."""
    ranked = np.sort(keys, axis=0) if keys.shape[1] == 1 else keys[_order(keys)]
    return ranked[_changes(ranked)]


def _blobs(keys: np.ndarray, buckets: int, chunk: int) -> pa.Table:
    cuts, rows = _bucket_cuts(keys[:, 0], buckets), []
    for bucket in np.flatnonzero(np.diff(cuts)):
        part = keys[cuts[bucket] : cuts[bucket + 1]]
        blob = pack_keys(part[:, 0]) if part.shape[1] == 1 else np.ascontiguousarray(part.T).tobytes()
        rows.append((int(bucket), chunk, len(part), blob))
    return _table(rows, [("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("keys", pa.binary())])


def _table(rows: list[tuple], fields: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(fields, columns, strict=True)})


def sort_bucket(kind: int, two: bool):
    """Sorts the keys of one bucket and answers every chunk with a bit per key: whether
    another chunk shares it (kind 1), or an earlier chunk has it (kind 2)."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        width = 2 if two else 1
        parts = []
        for r in rows:
            if two:
                parts.append(np.frombuffer(r["keys"], np.uint64).reshape(2, r["n"]).T)
            else:
                parts.append(unpack_keys(r["keys"], r["n"])[:, None])
        keys = np.concatenate(parts) if parts else np.zeros((0, width), np.uint64)
        # A stable sort of chunks in order: the first of equal keys is the earliest chunk's.
        order = _order(keys) if two else np.argsort(keys[:, 0], kind="stable")
        again = ~_changes(keys[order])
        if kind == 1:
            again[:-1] |= again[1:]
        told = np.empty(len(keys), bool)
        told[order] = again
        ends = np.cumsum([len(p) for p in parts])
        out = [
            (r["chunk"], kind, r["bucket"], np.packbits(told[e - len(p) : e]).tobytes())
            for r, p, e in zip(rows, parts, ends, strict=True)
        ]
        return _table(out, [("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("bits", pa.binary())])

    return run


def _told(keys: np.ndarray, buckets: int, answers: dict[int, bytes]) -> np.ndarray:
    """The answers of all buckets for sorted distinct keys."""
    cuts, told = _bucket_cuts(keys[:, 0], buckets), np.zeros(len(keys), bool)
    for bucket in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[bucket], cuts[bucket + 1]
        told[a:b] = np.unpackbits(np.frombuffer(answers[int(bucket)], np.uint8), count=b - a)
    return told


class Plan:
    """What every task needs to know: lengths, widths and numbers of buckets."""

    def __init__(self, total: int, length: int, bucket_keys: int = BUCKET_KEYS):
        self.length = length
        self.bits, self.extra = key_bits(total)
        self.sample_buckets = max(1, -(-total * len(COVER) // (MODULUS * bucket_keys)))
        self.suffix_buckets = max(1, -(-total // (4 * bucket_keys)))

    def open(self, texts: pa.Table, side: pa.Table) -> tuple[Chunk, dict[int, dict[int, bytes]]]:
        answers, copies = {1: {}, 2: {}}, set()
        for row in side.to_pylist():
            if row["kind"] == 0:
                copies.update(np.frombuffer(row["bits"], np.int64).tolist())
            else:
                answers[row["kind"]][row["bucket"]] = row["bits"]
        return Chunk(texts, copies, self.length), answers

    def sample_blobs(self, key, texts: pa.Table, side: pa.Table) -> pa.Table:
        chunk, _ = self.open(texts, side)
        return _blobs(_distinct(chunk.samples(self.bits)[1][:, None]), self.sample_buckets, key[0].as_py())

    def _suffixes(self, chunk: Chunk, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        places, keys = chunk.samples(self.bits)
        order = np.argsort(keys)
        ranked = keys[order][:, None]
        new = _changes(ranked)
        rank = np.cumsum(new) - 1
        # Shared with another chunk, or found more than once in this one.
        shared = _told(ranked[new], self.sample_buckets, answers) | (np.bincount(rank) > 1)
        starts = chunk.candidates(places[order[shared[rank]]])
        return starts, chunk.suffix_keys(starts, self.extra)

    def suffix_blobs(self, key, texts: pa.Table, side: pa.Table) -> pa.Table:
        chunk, answers = self.open(texts, side)
        _, keys = self._suffixes(chunk, answers[1])
        return _blobs(_distinct(keys), self.suffix_buckets, key[0].as_py())

    def clean(self, key, texts: pa.Table, side: pa.Table) -> pa.Table:
        chunk, answers = self.open(texts, side)
        starts, keys = self._suffixes(chunk, answers[1])
        order = _order(keys)
        ranked = keys[order]
        new = _changes(ranked)
        rank = np.cumsum(new) - 1
        doc = chunk.number[chunk.doc_of(starts[order])]
        first = np.minimum.reduceat(doc, np.flatnonzero(new)) if len(doc) else doc
        earlier = _told(ranked[new], self.suffix_buckets, answers[2])[rank] | (doc > first[rank])
        gone = starts[order[earlier]]
        covered = _covered(gone, gone + self.length, len(chunk.data))
        rows = []
        for number, (i, size) in enumerate(zip(chunk.ids.tolist(), chunk.sizes.tolist(), strict=True)):
            part = slice(chunk.offsets[number], chunk.offsets[number + 1])
            own = covered[part]
            edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
            spans = [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
            kept = chunk.data[part]
            rows.append((i, size, spans, kept[~own].tobytes() if spans else kept.tobytes()))
        for i, text in chunk.copies:
            whole = len(text) >= self.length
            spans = [{"start": 0, "end": len(text)}] if whole else []
            rows.append((i, len(text), spans, b"" if whole else text))
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return _table(
            rows,
            [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())],
        )


def _pack(bounds: np.ndarray):
    """Rows (id, text) → (chunk, ids, sizes, payload), texts joined and compressed."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            chunks = np.searchsorted(bounds, ids, side="right")
            order = np.argsort(chunks, kind="stable")
            texts = batch.column(1).fill_null("").cast(pa.large_binary())
            rows = []
            for part in np.split(order, np.flatnonzero(np.diff(chunks[order])) + 1):
                if len(part):
                    held = [x.as_py() for x in texts.take(pa.array(part))]
                    payload = pa.compress(b"".join(held), "zstd", asbytes=True)
                    sizes = np.array([len(h) for h in held], np.int64)
                    rows.append((int(chunks[part[0]]), ids[part].astype(np.int64).tobytes(), sizes.tobytes(), payload))
            fields = [("chunk", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("payload", pa.binary())]
            yield from _table(rows, fields).to_batches()

    return run


def _copy_rows(bounds: np.ndarray):
    """Ids of whole copies → (chunk, kind 0, bucket 0, ids)."""

    def run(batches):
        for batch in batches:
            ids = np.sort(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            chunks = np.searchsorted(bounds, ids, side="right")
            rows = [
                (int(chunks[part[0]]), 0, 0, ids[part].tobytes())
                for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(chunks)) + 1)
                if len(part)
            ]
            fields = [("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("bits", pa.binary())]
            yield from _table(rows, fields).to_batches()

    return run


def remove_repeats(
    docs: DataFrame,
    length: int = 50,
    chunk_bytes: int = CHUNK_BYTES,
    bucket_keys: int = BUCKET_KEYS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, spans, kept), one row per row of ``docs``.

    ``spans`` are the maximal removed runs in byte offsets; ``kept`` are the other bytes.
    A byte goes if some ``length`` bytes around it also start in a document of smaller id.
    """
    if length <= MODULUS:
        raise ValueError(f"length must be above {MODULUS}")
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = named.filter(F.col("id").isNotNull())
    digests = cut(
        known.select(
            "id", digest("text").alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size")
        )
    )
    total = digests.agg(F.sum("size").alias("n")).first()["n"] or 0
    chunks = max(1, -(-total // chunk_bytes))
    bounds = np.zeros(0, np.int64)
    if chunks > 1:  # the first id of every chunk but one: 8 bytes for each, 2 for a MB of text
        sizes = digests.groupBy("id").agg(F.sum("size").alias("size"))
        upto = with_running_total(sizes, [], ["id"], "size", "upto")
        begins = F.floor((F.col("upto") - F.col("size")) / chunk_bytes)
        opens = upto.filter((F.floor(F.col("upto") / chunk_bytes) > begins) & (F.col("upto") < total))
        bounds = np.sort(np.array([r["id"] for r in opens.select("id").collect()], np.int64)) + 1
    plan = Plan(total, length, bucket_keys)
    first = digests.groupBy("digest").agg(F.min("id").alias("first"), F.count_distinct("id").alias("ids"))
    twice = digests.groupBy("id").agg(F.count_distinct("digest").alias("texts")).filter("texts > 1")
    copies = (
        digests.join(first.filter("ids > 1"), "digest")
        .filter(F.col("id") > F.col("first"))
        .join(twice, "id", "left_anti")  # an id with several texts takes part as a whole
        .select("id")
        .distinct()
        .mapInArrow(_copy_rows(bounds), MASK)
    )
    # One exchange of texts serves all three passes: the plan reuses it.
    texts = known.mapInArrow(_pack(bounds), "chunk long, ids binary, sizes binary, payload binary")

    def per_chunk(side: DataFrame, run, schema: str) -> DataFrame:
        call = lambda key, left, right: run(key, left, right)
        return texts.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(call, schema)

    def per_bucket(blobs: DataFrame, kind: int) -> DataFrame:
        run = sort_bucket(kind, kind == 2 and plan.extra > 0)
        return blobs.groupBy("bucket").applyInArrow(run, MASK)

    ranks = per_bucket(per_chunk(copies, plan.sample_blobs, BLOB), 1)
    side = copies.unionByName(ranks)
    ties = per_bucket(per_chunk(side, plan.suffix_blobs, BLOB), 2)
    side = side.unionByName(ties)
    cleaned = per_chunk(side, plan.clean, RESULT)
    lost = named.filter(F.col("id").isNull()).select(
        F.col("id").alias("doc_id"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.array().cast("array<struct<start: long, end: long>>").alias("spans"),
        F.coalesce("text", F.lit("")).cast("binary").alias("kept"),
    )
    return cleaned.unionByName(lost).withColumnRenamed("doc_id", id_col)
