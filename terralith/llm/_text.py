"""Whole texts of Arrow columns as byte buffers, with words and their 64-bit hashes found by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_C = 0x9E3779B97F4A7C15 | 1
_CI = pow(_C, -1, 1 << 64)
_POW: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

#: White space that parts words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, up to n."""
    if len(_POW[0]) < n:
        m = max(n, 1 << 21)
        for i, c in enumerate((_C, _CI)):
            p = np.full(m, c, U64)
            p[0] = 1
            _POW[i] = np.multiply.accumulate(p)
    return _POW[0][:n], _POW[1][:n]


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the offsets of its rows."""
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if offs is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def chunks(col: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` bytes, whole rows only: (first row, end row, bytes, offsets)."""
    yield from parts(*column_bytes(col), limit)


def parts(buf: np.ndarray, offs: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The same for bytes with offsets."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


#: Bytes that part letter runs: all but ASCII letters, digits and bytes of longer characters.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words(buf: np.ndarray, offs: np.ndarray, parting: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and for each row the index of its first word (one more at the end)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    on = ~parting[buf]
    cut = offs[(offs > 0) & (offs < len(buf))]
    before = np.empty_like(on)
    before[0], before[1:] = False, on[:-1]
    before[cut] = False
    after = np.empty_like(on)
    after[-1], after[:-1] = False, on[1:]
    after[cut - 1] = False
    starts = np.flatnonzero(on & ~before)
    return starts, np.flatnonzero(on & ~after) + 1, np.searchsorted(starts, offs)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    power, inverse = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * power[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n neighbours in ``h``, one for each start."""
    if len(h) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(h) - n + 1, U64)
    for k in range(n):
        out = out * U64(0x2545F4914F6CDD1D) + h[k : k + len(out)]
    return mix(out)


def owners(offs: np.ndarray) -> np.ndarray:
    """The row of each item, from the rows' offsets."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def crc_mod(ids: np.ndarray, n: int) -> np.ndarray:
    """crc32 of the ids as text, modulo n."""
    import zlib

    return np.array([zlib.crc32(str(i).encode()) % n for i in ids], np.int64)
