"""Array kernels shared by the operators: slices of Arrow text and word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

#: The white space that separates words (space, tab to carriage return).
WORD_SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(WORD_SPACE)] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
_SALT = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


class _Tables:
    size = 0
    up = down = None

    @classmethod
    def upto(cls, n: int):
        if n > cls.size:
            cls.size = max(n, 2 * cls.size, SLICE_BYTES + 1)
            cls.up = _powers(_STEP, cls.size)
            cls.down = _powers(pow(_STEP, -1, 1 << 64), cls.size)
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column with nulls as empty texts and 64-bit offsets."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return col.fill_null("") if col.null_count else col


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets, bytes) of runs of rows of about `limit` bytes;
    a longer text makes a run of its own, and no text is cut."""
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, offs[lo : hi + 1] - offs[lo], data[offs[lo] : offs[hi]]
        lo = hi


def word_bounds(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a slice, and the first word of each row (n + 1)."""
    if not len(data):
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(offs), dtype=np.int64)
    word = ~_IS_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = offs[:-1][offs[:-1] < len(data)]
    first[heads] = word[heads]
    last = word.copy()
    last[:-1] &= ~word[1:]
    tails = offs[1:][offs[1:] > 0] - 1
    last[tails] = word[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased: differences of one running
    polynomial over the slice, shifted to a common origin and mixed."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _Tables.upto(len(data) + 1)
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_SALT[data] * up[: len(data)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def runs(batch: pa.RecordBatch, columns: int) -> Iterator[tuple[int, int, tuple]]:
    """(first row, end row, key) of the runs of equal leading columns."""
    if batch.num_rows:
        key = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(columns)])
        cuts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)])).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield lo, hi, tuple(key[lo].tolist())
