"""Words, shingles and fingerprints of texts, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SEED = 42
PIECE = 1 << 15  # shingles held as bits at a time


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about ``most`` bytes of text at most, so that long texts do not add up.

    At the end of a task its worker gives unused memory back, as it stays for other tasks.
    """
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = np.cumsum(lengths) // most
        starts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else []
        for a, b in zip(starts, [*starts[1:], len(part)]):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle: A-Z lower-cased, words between ASCII white space, joined by one space."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    whole, digest = memoryview(b" ".join(words)), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.fromiter((digest(whole[a:b], SEED) for a, b in spans), np.uint64, len(words) - size + 1)


def mixed(x: np.ndarray, lane: int) -> np.ndarray:
    """A further 64-bit hash of a hash (splitmix64 finaliser); lane 0 is the hash itself."""
    if lane == 0:
        return x
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * lane) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def simhash(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """Fingerprint of 64 bits a lane: a bit is 1 if set in over half the hashes; no hashes give zero."""
    out = np.zeros(lanes, dtype=np.uint64)
    for lane in range(lanes):
        counts = np.zeros(64, dtype=np.int64)
        for a in range(0, len(hashes), PIECE):
            own = mixed(hashes[a : a + PIECE], lane)
            counts += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
        out[lane] = np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0]
    return out
