"""Fill-in-middle by content-defined chunks whose summaries are remembered.

A text is cut into chunks where a rolling hash of the last ``WINDOW`` bytes says so, so
equal passages of different documents fall into equal chunks, whatever stands before them.
A chunk is summed up once: its tokens (`[A-Za-z]+|[^A-Za-z]`), its code points, and whether
a letter begins and ends it. Summaries are looked up by a hash of the chunk and believed only
if the bytes are equal. Summaries of neighbours combine: a run of letters that crosses a
border counts once. So running sums over chunks give the tokens of a text and the chunk that
holds any token; only the two chunks with a cut are read again.

Documents are independent: nothing is shuffled, and a task remembers at most ``REMEMBERED``
bytes of chunks before it starts afresh.

Defined cases: null and empty texts have no tokens and are plain; a null id is seeded as the
empty string; texts of any length are read whole; repeated rows are treated alike and kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pairlake.llm.hashing import Windows

MARKS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
WINDOW = 32  # bytes that decide about a border
LEAST, USUAL, MOST = 512, 2048, 16_384  # bytes of a chunk; USUAL a power of two
REMEMBERED = 32 << 20
PIECE = 1 << 20  # bytes cut at once

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_INSIDE = np.zeros(256, bool)  # bytes inside a code point
_INSIDE[0x80:0xC0] = True


def borders(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text, the last one its length; no code point is divided."""
    n = len(data)
    likely: list[np.ndarray] = []
    for begin in range(0, n - WINDOW, PIECE):
        hashes = Windows(data[begin : begin + PIECE + WINDOW - 1]).all_of(WINDOW)
        likely.append(np.flatnonzero((hashes & np.uint64(USUAL - 1)) == 0) + begin + WINDOW)
    places = np.concatenate(likely) if likely else np.zeros(0, np.int64)
    places = places[places < n]
    places = places[~_INSIDE[data[places]]]
    ends, at, k = [], 0, 0
    found = places.tolist()
    while n - at > LEAST:
        while k < len(found) and found[k] < at + LEAST:
            k += 1
        end = min(found[k] if k < len(found) else n, at + MOST)
        while end < n and _INSIDE[data[end]]:
            end -= 1
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return np.array(ends, np.int64)


def token_starts(data: np.ndarray) -> np.ndarray:
    """Where tokens begin in these bytes, read by themselves."""
    letter = _LETTER[data]
    first = ~letter & ~_INSIDE[data]
    first[:1] |= letter[:1]
    first[1:] |= letter[1:] & ~letter[:-1]
    return np.flatnonzero(first)


class ChunkCache:
    """Summaries of chunks by content."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.held = most, 0
        self.known: dict[int, list[tuple[bytes, tuple[int, int, bool, bool]]]] = {}
        self.summed = 0  # chunks that were not known

    def summary(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        """(tokens, code points, begins with a letter, ends with a letter)."""
        entries = self.known.setdefault(self.key(chunk), [])
        for content, summary in entries:
            if content == chunk:
                return summary
        self.summed += 1
        data = np.frombuffer(chunk, np.uint8)
        summary = (
            len(token_starts(data)),
            len(data) - int(_INSIDE[data].sum()),
            bool(_LETTER[data[0]]),
            bool(_LETTER[data[-1]]),
        )
        self.held += len(chunk) + 200
        if self.held > self.most:
            self.known, self.held = {}, len(chunk) + 200
            entries = self.known.setdefault(self.key(chunk), [])
        entries.append((chunk, summary))
        return summary

    def key(self, chunk: bytes) -> int:
        return hash(chunk)


class Chunked:
    """One text as chunks: its token count, and where its tokens begin."""

    def __init__(self, text: bytes, cache: ChunkCache):
        self.data = np.frombuffer(text, np.uint8)
        self.ends = borders(self.data)
        begins = np.concatenate([[0], self.ends[:-1]]).tolist() if len(self.ends) else []
        found = [cache.summary(text[b:e]) for b, e in zip(begins, self.ends.tolist(), strict=True)]
        self.begins = begins
        # A run of letters over a border belongs to the chunk that it begins in.
        self.joined = [
            bool(i and found[i - 1][3] and found[i][2]) for i in range(len(found))
        ]
        counts = [f[0] - j for f, j in zip(found, self.joined, strict=True)]
        self.tokens = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.points = np.concatenate([[0], np.cumsum([f[1] for f in found], dtype=np.int64)])
        self.n = int(self.tokens[-1])

    def place(self, token: int) -> tuple[int, int]:
        """(byte, code point) at which token number ``token`` begins; the end for ``n``."""
        if token >= self.n:
            return len(self.data), int(self.points[-1])
        k = int(np.searchsorted(self.tokens, token, side="right")) - 1
        begin, end = self.begins[k], int(self.ends[k])
        starts = token_starts(self.data[begin:end])[int(self.joined[k]) :]
        offset = int(starts[token - int(self.tokens[k])])
        inside = int(_INSIDE[self.data[begin : begin + offset]].sum())
        return begin + offset, int(self.points[k]) + offset - inside


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four unsigned 32-bit numbers of a row."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(name.encode()).digest()
    return [int.from_bytes(digest[i : i + 4]) for i in (0, 4, 8, 12)]


FIELDS = [
    StructField("n", LongType()),
    StructField("form", StringType()),
    StructField("prefix_chars", LongType()),
    StructField("middle_chars", LongType()),
    StructField("output", StringType()),
]


def fill_in_middle(
    docs: DataFrame,
    seed: str = "1",
    rate: int = 90,
    suffix_first: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output), one row per row of ``docs``.

    ``rate`` of 100 texts are cut in three at two drawn tokens; ``suffix_first`` of 100 of
    those begin with the suffix (form spm, the others psm). A text that holds a mark, or
    none at all, stays plain.
    """
    marks = [m.encode() for m in MARKS]

    def transform(text: bytes, doc_id: int | None, cache: ChunkCache):
        chunked = Chunked(text, cache)
        h = draws(doc_id, seed)
        if not text or h[2] % 100 >= rate or any(m in text for m in marks):
            return chunked.n, "plain", None, None, text
        low, high = sorted(x % (chunked.n + 1) for x in h[:2])
        (a, before), (b, upto) = chunked.place(low), chunked.place(high)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        form = "spm" if h[3] % 100 < suffix_first else "psm"
        parts = [marks[0], prefix, marks[1], suffix] if form == "psm" else [marks[1], suffix, marks[0], prefix]
        return chunked.n, form, before, upto - before, b"".join([*parts, marks[2], middle])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ChunkCache()
        for batch in batches:
            for begin in range(0, batch.num_rows, 100):
                part = batch.slice(begin, 100)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                rows = [transform(t, i, cache) for t, i in zip(texts, part.column(0).to_pylist(), strict=True)]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(n, pa.int64()),
                        pa.array(form, pa.string()),
                        pa.array(prefix, pa.int64()),
                        pa.array(middle, pa.int64()),
                        pa.array(output, pa.binary()).cast(pa.string()),
                    ],
                    names=[id_col, *(f.name for f in FIELDS)],
                )

    wanted = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return wanted.mapInArrow(run, StructType([docs.schema[id_col], *FIELDS]))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    parts = F.split(output, "|".join(MARKS), -1)
    prefix = F.when(form == "psm", F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(2)))
    suffix = F.when(form == "psm", F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.get(parts, F.lit(3)), suffix))
