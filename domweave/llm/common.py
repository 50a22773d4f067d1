"""Word hashing inside tasks, and joins whose small side is measured before it is broadcast."""

from __future__ import annotations

import ctypes
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Odd multipliers, one for each place in a shingle (also the upper limit of its length).
PLACES = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
     0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    dtype=np.uint64,
)


def measured_broadcast(rows: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint if the rows, counted now, are at most ``max_rows``; else the rows as they are.

    ``rows`` should be a written table, as counting runs it.
    """
    return F.broadcast(rows) if rows.limit(max_rows + 1).count() <= max_rows else rows


def utf8(text: Column | str) -> Column:
    """The bytes of a text, none for null: Python tasks then skip decoding and encoding."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that their high bits are evenly spread."""
    values = (values ^ (values >> np.uint64(32))) * PLACES[0]
    values = (values ^ (values >> np.uint64(29))) * PLACES[1]
    return values ^ (values >> np.uint64(32))


class WordHashes(dict):
    """word bytes -> 64-bit hash, looked up in C; forgets all when full, so memory stays bounded."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, cut at the ASCII blanks (0x20, 0x09-0x0D)."""
    return text.lower().split()


def shingle_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``length`` words; of all words as one run if there are fewer."""
    n = len(words)
    if n == 0:
        return words
    if n < length:
        total = mixed(words * PLACES[:n]).sum(dtype=np.uint64, keepdims=True)
        return mixed(total ^ np.uint64(n))
    runs = np.zeros(n - length + 1, np.uint64)
    for place in range(length):
        runs += words[place : n - length + 1 + place] * PLACES[place]
    return np.unique(mixed(runs))


_kept: dict = {}


def worker_keeps(owner: str, make=None):
    """What a worker process keeps for the next task of ``owner``, made if it is not there.

    Worker processes serve all operators in turn: whatever others kept is dropped, as it would take memory from this one.
    """
    for other in [k for k in _kept if k != owner]:
        del _kept[other]
    if make and owner not in _kept:
        _kept[owner] = make()
    return _kept.get(owner)


def release_memory() -> None:
    """Gives memory that is free within this process back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(task):
    """A task over batches that leaves its worker process with no more than what that keeps: the process waits beside the JVM for its next task."""
    @wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            release_memory()

    return run


def segment_slices(keys: np.ndarray, segments: int):
    """(segment, start, end) of sorted 64-bit keys cut by their highest bits; ``segments`` is a power of two."""
    shift = np.uint64(64 - (segments.bit_length() - 1))
    at = np.searchsorted(keys >> shift, np.arange(segments + 1, dtype=np.uint64)) if segments > 1 else [0, len(keys)]
    for segment in range(segments):
        if at[segment] < at[segment + 1]:
            yield segment, int(at[segment]), int(at[segment + 1])


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, compressed place by place: bytes that are mostly zero take next to nothing."""
    places = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + (pa.compress(places, codec="zstd", asbytes=True) if len(values) else b"")


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    places = pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(places, np.uint8).reshape(8, n).T).view("<u8")[:, 0]


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their distances."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def segments_for(nbytes: int, per_segment: int, least: int = 16) -> int:
    """A power of two that grows with the input, so that a segment stays of one size."""
    wanted = max(least, -(-int(nbytes) // per_segment))
    return 1 << (wanted - 1).bit_length()


def text_bytes(rows: DataFrame, text: str = "text") -> int:
    return rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
