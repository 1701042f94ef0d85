"""Words of many texts at once, as arrays.

A word is a run of bytes outside space and 0x09-0x0D, which in UTF-8 equals the pattern
``[^\\x20\\x09-\\x0D]+`` on code points. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (arrays take about 60 times as much); a longer text is a slice of its own.
SLICE_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E6C63D0876A9A47)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in slices of about ``limit`` bytes of ``column``."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, first = np.cumsum(sizes), 0
        while first < len(sizes):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts of a column as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads their bits (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """All words of some texts.

    buffer: the texts, a line feed after each; text_at: where each begins; start, end: of each
    word in the buffer; text: the number of its text; hash: of its bytes.
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.buffer = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.text_at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]).astype(np.int64)
        space = _SPACE[self.buffer]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.text = np.searchsorted(self.text_at, self.start, side="right") - 1
        self.hash = self._hashes(space)
        self.counts = np.bincount(self.text, minlength=len(texts))[: len(texts)]

    def _hashes(self, space: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(length.max()), _BASE))
            kept = np.flatnonzero(~space)
            first = np.concatenate([[0], np.cumsum(length)[:-1]])
            within = np.arange(len(kept)) - np.repeat(first, length)
            sums = np.add.reduceat((self.buffer[kept].astype(np.uint64) + np.uint64(1)) * powers[within], first)
            return mix(sums + length.astype(np.uint64) * _BASE)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all k-word windows inside one text, and hashes of the windows."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            total = np.zeros(n - k + 1, np.uint64)
            for i in range(k):
                total = total * _BASE + self.hash[i : n - k + 1 + i]
            first = np.flatnonzero(self.text[: n - k + 1] == self.text[k - 1 :])
            return first, mix(total[first])
