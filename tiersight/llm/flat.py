"""Words of many texts as flat arrays."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_RANDOM = np.random.default_rng(20_240_501)
#: A number for each byte; A-Z have those of a-z.
BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
BYTE[65:91] = BYTE[97:123]
STEP = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A well spread bijection of unsigned 64-bit numbers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words(NamedTuple):
    """Of texts joined by a line feed: the bytes, and for each word its text, place and hash."""

    data: np.ndarray
    first: np.ndarray  # of each text and one more, the place of its first word
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def words_of(texts: list[bytes]) -> Words:
    """Words are runs of bytes other than space and 9 to 13; case of A-Z doesn't count in hashes."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    first = np.concatenate(([0], np.searchsorted(start, ends)))
    if not len(start):
        return Words(data, first, start, end, np.zeros(0, np.uint64))
    length = end - start
    inside = np.flatnonzero(~space)
    at = inside - np.repeat(start, length)
    power = np.multiply.accumulate(np.full(int(length.max()), STEP, np.uint64))
    value = BYTE[data[inside]] * power[at]
    return Words(data, first, start, end, mixed(np.add.reduceat(value, np.concatenate(([0], np.cumsum(length)[:-1])))))


def word_counts(texts: list[bytes]) -> np.ndarray:
    """How many words of `words_of` each text has."""
    space = SPACE[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    start = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return np.diff(np.searchsorted(start, ends), prepend=0)


def free_name(base: str, df: DataFrame) -> str:
    """A column name that a table doesn't have."""
    names = {c.lower() for c in df.columns}
    while base in names:
        base = f"_{base}"
    return base


def _ranges(lengths: list[int], size: int, most: int) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for i, length in enumerate(lengths):
        if i > lo and (held + length > size or i - lo == most):
            yield lo, i
            lo, held = i, 0
        held += length
    if lo < len(lengths):
        yield lo, len(lengths)


def parts(batch: pa.RecordBatch, column: str, size: int = 1 << 20, most: int = 1024) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `size` bytes of a text column, so that few texts are Python objects at once."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for lo, hi in _ranges(lengths, size, most):
        yield batch.slice(lo, hi - lo)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts' bytes, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]
