"""Hashes of many byte windows at once.

With ``P[i]`` the sum of ``T[byte j] * B**j`` over j < i (mod 2**64, B odd), the value
``(P[e] - P[s]) * B**-s`` depends only on the bytes between s and e: one running sum per
buffer gives the hash of any window in it.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_TABLES: dict[str, np.ndarray] = {}


def byte_values(seed: int = 0) -> np.ndarray:
    """256 odd 64-bit numbers from a counter."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(seed * 1000)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on all input bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _TABLES.get(name)
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16), base, np.uint64)
        grown[0] = 1
        have = _TABLES[name] = np.multiply.accumulate(grown)
    return have[:n]


class Windows:
    """Hashes of windows of one buffer."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(byte_values(seed)[data] * _powers("up", _BASE, n), dtype=np.uint64, out=self.sums[1:])
        self.back = _powers("down", pow(_BASE, -1, 2**64), n + 1)

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def all_of(self, length: int) -> np.ndarray:
        """One hash for every start from 0 to n - length."""
        count = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:-length]) * self.back[:count])


def text_chunks(batch, id_index: int, text_index: int, most: int):
    """(ids, offsets, bytes) pieces of an Arrow batch, whole rows of about ``most`` bytes.

    Null texts count as empty. Offsets are into the piece's own bytes.
    """
    import pyarrow as pa

    text = batch.column(text_index)
    if text.null_count:
        text = text.fill_null("")
    if not pa.types.is_large_string(text.type):
        text = text.cast(pa.large_string())
    rows = len(text)
    if not rows:
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + rows + 1]
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    ids = batch.column(id_index)
    at = 0
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(max(end, at + 1), rows)
        yield ids.slice(at, end - at), offsets[at : end + 1] - offsets[at], data[offsets[at] : offsets[end]]
        at = end
