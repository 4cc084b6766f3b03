"""BPE encoding with a contiguous rank array per word, and decoding.

A word (what the tokenizer's splitting leaves to merge) is held as two short arrays: the
parts between its boundaries, and for every boundary the rank of the pair that meets there.
Encoding scans the ranks for the smallest (the leftmost of equals), deletes that boundary,
and looks the two neighbouring ranks up anew, until no pair has a rank. Many words make one
matrix, a row each, so that a scan, a deletion and a refresh are one NumPy step for all of
them; a row that is done leaves the matrix. Words above ``SHORT`` bytes would make the scan
quadratic and take their pairs from a queue instead, with the same result.

Nothing is shuffled: a task splits its texts into words, remembers the ids of words it has
seen (up to ``KNOWN_WORDS``, then it starts afresh), and encodes the new ones of a slice of
texts together. Normalising and splitting are the tokenizer's own, read from its file.

Defined cases: null and empty texts (and texts of white space alone, where the tokenizer
drops it) have no ids and decode to the empty text; null ids decode to the empty text; special strings inside a text
become their special ids; repeated rows are encoded alike and kept; texts of any length are
encoded whole; an empty table gives an empty result; other columns are ignored by ``encode``
and kept by ``decode``, where a column named like the result is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

SHORT = 64  # bytes of a word that is merged by scanning
KNOWN_WORDS = 400_000  # words a task remembers
SLICE = 1_000_000  # characters encoded together
_BLANKS = re.compile("[\x09-\x0d\x20]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # blanks to some pattern libraries only
_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand
    for themselves, the others for the code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, more = [], 256
    for b in range(256):
        letters.append(chr(b if b in plain else more))
        more += b not in plain
    return letters


class Merger:
    """Ids of byte strings by the merges of one tokenizer file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab = model["vocab"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("a plain BPE vocabulary is needed")
        end = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + end] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; a missing part is -1 and has no rank."""
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found = (self.keys[at] == wanted) & (left >= 0) & (right >= 0)
        return np.where(found, self.ranks[at], _NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of every word, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in (4, 8, 16, 32, SHORT):
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            if len(rows):
                self._scan(words, rows, sizes[rows], width, out)
        for row in np.flatnonzero(sizes > SHORT).tolist():
            out[row] = np.array(self._queue(words[row]), "<u4").tobytes()
        return out

    def _scan(self, words: list[bytes], rows, sizes, width: int, out: list[bytes]) -> None:
        raw = b"".join(words[r].ljust(width, b"\0") for r in rows.tolist())
        raw = np.frombuffer(raw, np.uint8).reshape(len(rows), width)
        parts = np.where(np.arange(width) < sizes[:, None], self.inner[raw], np.int32(-1))
        parts[np.arange(len(rows)), sizes - 1] = self.final[raw[np.arange(len(rows)), sizes - 1]]
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        done = np.full(parts.shape, -1, np.int32)
        place = np.arange(len(rows))
        while len(place):
            each = np.arange(len(place))
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(place), np.int64)
            lowest = ranks[each, at] if ranks.shape[1] else np.full(len(place), _NONE)
            live = lowest < _NONE
            if not live.all():
                done[place[~live], : parts.shape[1]] = parts[~live]
                parts, ranks, place = parts[live], ranks[live], place[live]
                at, lowest, each = at[live], lowest[live], np.arange(int(live.sum()))
                if not len(place):
                    break
            parts[each, at] = self.made[lowest]
            # The boundary after part ``at`` goes: what follows moves up one place.
            column = np.arange(parts.shape[1] - 1)
            parts = np.where(column > at[:, None], parts[:, 1:], parts[:, :-1])
            if parts.shape[1] > 1:
                ranks = np.where(column[:-1] >= at[:, None], ranks[:, 1:], ranks[:, :-1])
                ahead = np.flatnonzero(at < ranks.shape[1])
                ranks[ahead, at[ahead]] = self.rank(parts[ahead, at[ahead]], parts[ahead, at[ahead] + 1])
                behind = np.flatnonzero(at > 0)
                ranks[behind, at[behind] - 1] = self.rank(parts[behind, at[behind] - 1], parts[behind, at[behind]])
            else:
                ranks = ranks[:, :0]
        kept = done >= 0
        flat = done[kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * 4
        begin = 0
        for row, end in zip(rows.tolist(), ends.tolist(), strict=True):
            out[row] = flat[begin:end]
            begin = end

    def _queue(self, word: bytes) -> list[int]:
        """The same merges for a long word: pairs wait in a queue by rank and place."""
        raw = np.frombuffer(word, np.uint8)
        ids = self.inner[raw]
        ids[-1] = self.final[raw[-1]]
        ids = ids.tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        known: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            got = known.get((a, b))
            if got is None:
                got = known[a, b] = int(self.rank(np.array([a]), np.array([b]))[0])
            return got

        wait = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i], ids[i + 1])) < _NONE]
        heapq.heapify(wait)
        while wait:
            r, i, a, b = heapq.heappop(wait)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = int(self.made[r]), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rank(ids[x], ids[y])) < _NONE:
                    heapq.heappush(wait, (r, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]


def _ascii_splitter(spec: dict):
    """Splits a lower-cased ASCII word as the file's pattern does, or None where the file does
    more than lower-casing, composing and cutting by one pattern. Calling the library for every
    word costs more than merging it."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    cutters = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    usual = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"}
    if not usual or [c["type"] for c in cutters] != ["Split", "ByteLevel"]:
        return None
    cut, letters = cutters
    if (cut["behavior"], cut["invert"]) != ("Removed", True) or letters["use_regex"] or letters["add_prefix_space"]:
        return None
    import regex

    return regex.compile(cut["pattern"]["Regex"]).findall


class Encoder:
    """Texts to ids for one byte-level BPE tokenizer file."""

    def __init__(self, path: str, drops_space: bool, known: int = KNOWN_WORDS):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.merger, self.normalizer, self.splitter = Merger(spec), library.normalizer, library.pre_tokenizer
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest = sorted(special, key=len, reverse=True)
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if special else None
        self.byte_of = {ord(c): b for b, c in enumerate(byte_letters())}
        self.split_ascii = _ascii_splitter(spec) if drops_space else None
        self.drops_space, self.limit = drops_space, known
        self.known: dict[str, bytes] = {}  # by what stands between blanks
        self.merged: dict[bytes, bytes] = {}  # by what is merged

    def _words(self, text: str) -> list[bytes]:
        """What is left to merge of a text without special strings."""
        if self.split_ascii and text.isascii() and not _SEPARATORS.search(text):
            return [w.encode() for w in self.split_ascii(text.lower())]
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        split = self.splitter.pre_tokenize_str(text)
        return [w.translate(self.byte_of).encode("latin-1") for w, _ in split]

    def _encode_new(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, whose words not merged before are merged together."""
        if len(self.merged) > self.limit:
            self.merged = {}
        merged = self.merged
        plan: list[list[bytes]] = []
        special: dict[int, list[tuple[int, bytes]]] = {}
        for text in texts:
            if self.cut and self.cut.search(text):
                words: list[bytes] = []
                for piece in self.cut.split(text):
                    if piece in self.special:
                        special.setdefault(len(plan), []).append((len(words), self.special[piece]))
                    elif piece:
                        words += self._words(piece)
                plan.append(words)
            else:
                plan.append(self._words(text) if text else [])
        new = list({w for words in plan for w in words if w not in merged})
        merged.update(zip(new, self.merger.encode(new), strict=True))
        got = [b"".join(map(merged.__getitem__, words)) for words in plan]
        for row, marks in special.items():
            begin, pieces = 0, []
            for at, mark in marks:
                pieces += [*map(merged.__getitem__, plan[row][begin:at]), mark]
                begin = at
            got[row] = b"".join([*pieces, *map(merged.__getitem__, plan[row][begin:])])
        for w in new:
            if len(w) > SHORT:
                del merged[w]
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.drops_space:
            return self._encode_new(texts)
        # Blanks part words before anything else does: a text is its words' ids in a row.
        split = [[w for w in _BLANKS.split(t) if w] for t in texts]
        if len(self.known) > self.limit:
            self.known = {}
        known = self.known
        new = list({w for words in split for w in words if w not in known})
        known.update(zip(new, self._encode_new(new), strict=True))
        got = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > SHORT:
                del known[w]
        return got


class Decoder:
    """Ids to text: tokens joined by a blank, or their bytes where the file says so."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = (spec.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"decoder {kind} is not known")
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.bytes = kind == "ByteLevel"
        special = {t["id"] for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.names = names
        if self.bytes:
            self.names = {
                i: t.encode() if i in special else bytes(map(byte_of.__getitem__, t)) for i, t in names.items()
            }

    def decode(self, ids: bytes) -> str:
        found = map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist())
        return b"".join(found).decode("utf-8", "replace") if self.bytes else " ".join(found)


ENCODED = StructType([StructField("n_tokens", LongType()), StructField("ids", BinaryType())])


def _slices(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        if size + len(t) > most and i > begin:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def encode(
    docs: DataFrame, tokenizer: str, drops_space: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, n_tokens, ids), one row per row of ``docs``; ids are packed as little-endian
    unsigned 32-bit integers.

    ``tokenizer`` is a byte-level BPE file that every executor can open. ``drops_space`` says
    that it cuts at white space and drops it, as word_bpe_49k.json does: then words between
    blanks are remembered.
    """
    fields = [docs.schema[id_col], *ENCODED.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, drops_space)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in _slices(texts, SLICE):
                ids = encoder.encode(texts[begin:end])
                counts = [len(x) // 4 for x in ids]
                columns = [batch.column(0).slice(begin, end - begin), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids"])

    wanted = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return wanted.mapInArrow(run, StructType(fields))


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``encoded`` with the text of its packed ids as column ``out``; special ids are kept."""
    kept = [f for f in encoded.schema.fields if f.name != out]
    where = [f.name for f in kept].index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(tokenizer)
        for batch in batches:
            for begin in range(0, batch.num_rows, 100):
                part = batch.slice(begin, 100)
                texts = [decoder.decode(x or b"") for x in part.column(where).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out]
                )

    result = StructType([*kept, StructField(out, StringType())])
    return encoded.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, result)
