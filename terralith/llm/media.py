"""Media columns: motion JPEG in AVI files, held as binary columns.

``store_texts`` writes byte payloads as frames; ``media_clips`` reads any such file through its RIFF index, decodes the intra
frames (baseline JPEG: Huffman, dequantisation, inverse DCT) and cuts shots where the luma histogram changes by more than the
recent changes explain.  All frames with equal headers in a block of rows are decoded side by side by numpy.

A payload byte is stored as one quantised DCT coefficient (byte - 128, quantiser 1), the unit that JPEG keeps without loss.
Frames are 24 x 24 grey pixels: 9 blocks of 64 coefficients, 576 bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import chunks, column_bytes
from .chat import arrow_rows

# The zigzag order and the typical Huffman tables for luminance of ITU-T T.81 (figure A.6, tables K.3 and K.5).
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]
DC_BITS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_VALUES = list(range(12))
AC_BITS = [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 0x7D]
AC_VALUES = [
    1, 2, 3, 0, 4, 17, 5, 18, 33, 49, 65, 6, 19, 81, 97, 7, 34, 113, 20, 50,
    129, 145, 161, 8, 35, 66, 177, 193, 21, 82, 209, 240, 36, 51, 98, 114, 130, 9, 10, 22,
    23, 24, 25, 26, 37, 38, 39, 40, 41, 42, 52, 53, 54, 55, 56, 57, 58, 67, 68, 69,
    70, 71, 72, 73, 74, 83, 84, 85, 86, 87, 88, 89, 90, 99, 100, 101, 102, 103, 104, 105,
    106, 115, 116, 117, 118, 119, 120, 121, 122, 131, 132, 133, 134, 135, 136, 137, 138, 146, 147, 148,
    149, 150, 151, 152, 153, 154, 162, 163, 164, 165, 166, 167, 168, 169, 170, 178, 179, 180, 181, 182,
    183, 184, 185, 186, 194, 195, 196, 197, 198, 199, 200, 201, 202, 210, 211, 212, 213, 214, 215, 216,
    217, 218, 225, 226, 227, 228, 229, 230, 231, 232, 233, 234, 241, 242, 243, 244, 245, 246, 247, 248,
    249, 250,
]

SIDE, BLOCKS, FRAME, FPS = 24, 9, 576, 25


def huffman(bits: list[int], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code and length by symbol, and length << 8 | symbol by the next 16 bits (0: no code)."""
    code, k = 0, 0
    codes, lengths, table = np.zeros(256, np.uint64), np.zeros(256, np.int64), np.zeros(1 << 16, np.int64)
    for length, n in enumerate(bits, 1):
        for v in values[k : k + n]:
            codes[v], lengths[v] = code, length
            table[code << 16 - length : code + 1 << 16 - length] = length << 8 | v
            code += 1
        k += n
        code <<= 1
    return codes, lengths, table


@lru_cache(1)
def standard() -> dict[tuple[int, int], tuple]:
    return {(0, 0): huffman(DC_BITS, DC_VALUES), (1, 0): huffman(AC_BITS, AC_VALUES)}


JPEG_HEAD = (
    b"\xff\xd8\xff\xdb" + struct.pack(">HB64B", 67, 0, *[1] * 64)
    + b"\xff\xc0" + struct.pack(">HBHHB3B", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
    + b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 0, 63, 0)
)


def entropy_code(payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stuffed scan bytes of all frames of a payload, and the frames' offsets in them."""
    (dc_codes, dc_len, _), (ac_codes, ac_len, _) = standard()[0, 0], standard()[1, 0]
    c = payload.reshape(-1, BLOCKS, 64).astype(np.int32) - 128
    n = len(c)
    v = c.copy()
    v[:, 1:, 0] -= c[:, :-1, 0]
    size = np.frexp(np.abs(v))[1].astype(np.int64)
    amp = np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)
    at = np.arange(64)
    there = v != 0
    there[:, :, 0] = True
    last = np.maximum.accumulate(np.where(there, at, 0), axis=2)
    run = np.zeros_like(size)
    run[:, :, 1:] = at[1:] - last[:, :, :-1] - 1
    sym = (run & 15) << 4 | size
    code, bits = ac_codes[sym], ac_len[sym] + size
    code[:, :, 0], bits[:, :, 0] = dc_codes[size[:, :, 0]], dc_len[size[:, :, 0]] + size[:, :, 0]
    code = code << size.astype(np.uint64) | amp
    zrl_code, zrl_len = ac_codes[0xF0], int(ac_len[0xF0])
    for z in (1, 2, 3):
        long = run >= 16 * z
        if long.any():
            code = np.where(long, code | zrl_code << bits.astype(np.uint64), code)
            bits = np.where(long, bits + zrl_len, bits)
    code, bits = np.where(there, code, 0).astype(np.uint64), np.where(there, bits, 0)
    ends = ~there[:, :, 63]
    code[:, :, 63][ends], bits[:, :, 63][ends] = ac_codes[0], ac_len[0]
    code, bits = code.reshape(n, -1), bits.reshape(n, -1)
    used = bits.sum(1)
    pad = -used % 8
    code = np.concatenate([code, ((1 << pad) - 1).astype(np.uint64)[:, None]], 1)
    bits = np.concatenate([bits, pad[:, None]], 1)
    starts = np.concatenate([[0], np.cumsum((used + pad) // 8)])
    keep = bits.ravel() > 0
    code, bits = code.ravel()[keep], bits.ravel()[keep]
    pos = np.cumsum(bits) - bits
    out = np.zeros(int(starts[-1]) // 8 + 2, np.uint64)
    word, room = pos >> 6, 64 - (pos & 63) - bits
    high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(high, first)
    spill = np.flatnonzero(room < 0)
    out[word[spill] + 1] |= code[spill] << (64 + room[spill]).astype(np.uint64)
    scan = out.byteswap().view(np.uint8)[: starts[-1]]
    ff = np.flatnonzero(scan == 255)
    return np.insert(scan, ff + 1, 0), starts + np.searchsorted(ff, starts)


def avi(frames: list[bytes], side: int = SIDE, fps: int = FPS) -> bytes:
    """An AVI file with one motion-JPEG stream and an index."""
    n, longest = len(frames), max(map(len, frames))
    parts, index, at = [], [], 4
    for f in frames:
        parts += [b"00dc", struct.pack("<I", len(f)), f, b"\0" * (len(f) % 2)]
        index.append(struct.pack("<4sIII", b"00dc", 16, at, len(f)))
        at += 8 + len(f) + len(f) % 2
    chunk = lambda kind, body: kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    avih = struct.pack("<14I", 1_000_000 // fps, longest * fps, 0, 0x10, n, 0, 1, longest, side, side, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIi4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, n, longest, 10_000, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    movi = b"LIST" + struct.pack("<I", at) + b"movi" + b"".join(parts)
    return chunk(b"RIFF", b"AVI " + hdrl + movi + chunk(b"idx1", b"".join(index)))


def stated(read: Callable) -> Callable:
    """``read``, with a ValueError for whatever is malformed."""

    @wraps(read)
    def run(raw: bytes):  # noqa: ANN202
        try:
            return read(raw)
        except (IndexError, KeyError, struct.error) as e:
            raise ValueError(f"malformed media: {e}") from e

    return run


@stated
def riff_frames(media: bytes) -> tuple[list[bytes], float]:
    """Frames of the first video stream, by the index (or by walking through movi where there is none), and seconds a frame.

    A file that ends before its lists or frames do is refused with a ValueError.
    """
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    view, frames, step = memoryview(media), [], 1 / FPS
    at, movi, index = 12, None, None
    stack = [(at, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if kind == b"LIST" and media[at + 8 : at + 12] == b"movi":
                if at + 8 + size > len(media):
                    raise ValueError("the file ends before its frames do")
                movi = (at + 8, min(end, at + 8 + size))
            elif kind == b"LIST":
                stack += [(at + 8 + size + size % 2, end)]
                at, end = at + 12, at + 8 + size
                continue
            elif kind == b"avih":
                step = struct.unpack_from("<I", media, at + 8)[0] / 1e6
            elif kind == b"idx1" and size >= 16:
                index = (at + 8, size // 16)
            at += 8 + size + size % 2
    if movi and index:
        table = np.frombuffer(media, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), index[1], index[0])
        base = movi[0] if media[movi[0] + int(table["at"][0]) :][:4] == table["id"][0] else 0
        video = np.char.endswith(table["id"], b"dc")
        if (base + 8 + table["at"][video].astype(np.int64) + table["size"][video] > len(media)).any():
            raise ValueError("the index leads beyond the file")
        frames = [bytes(view[base + a + 8 : base + a + 8 + s]) for a, s in zip(table["at"][video].tolist(), table["size"][video].tolist(), strict=True)]
    elif movi:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            size = struct.unpack_from("<I", media, at + 4)[0]
            if at + 8 + size > movi[1]:
                raise ValueError("a frame ends beyond its list")
            if media[at + 2 : at + 4] == b"dc":
                frames.append(bytes(view[at + 8 : at + 8 + size]))
            at += 8 + size + size % 2
    return frames, step


@dataclass
class Head:
    """What a JPEG header says: for each block of the scan in order its component, and tables by component."""

    size: int
    comps: np.ndarray
    quant: list[np.ndarray]
    dc: list[np.ndarray]
    ac: list[np.ndarray]
    luma: np.ndarray  # (luma blocks, 64) pixels inside the picture


@stated
def jpeg_head(frame: bytes) -> Head:
    at, tables, quants, parts, shape = 2, dict(standard()), {}, [], (0, 0)
    tables[0, 1], tables[1, 1] = tables[0, 0], tables[1, 0]
    while True:
        marker, length = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + length]
        if marker == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                quants[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(np.float32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = huffman(list(body[1:17]), list(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            shape = struct.unpack_from(">HH", body, 1)
            parts = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]] for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("only baseline JPEG frames can be decoded")
        elif marker == 0xDD and body != b"\0\0":
            raise ValueError("restart intervals aren't read")
        elif marker == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
        at += 2 + length
    if not parts or 0 in shape or any(0 in p[1:3] for p in parts):
        raise ValueError("a frame without extent")
    if len(parts) == 1:
        parts[0][1:3] = 1, 1
    hm, vm = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-shape[1] // (8 * hm)), -(-shape[0] // (8 * vm))
    one = [(i, x, y) for i, p in enumerate(parts) for y in range(p[2]) for x in range(p[1])]
    comps = np.array([i for i, _, _ in one] * (across * down))
    h, v = parts[0][1:3]
    inside = []
    for my in range(down):
        for mx in range(across):
            for _, x, y in (o for o in one if o[0] == 0):
                rows, cols = (my * v + y) * 8 + np.arange(8), (mx * h + x) * 8 + np.arange(8)
                inside.append(((rows * vm < shape[0] * v)[:, None] & (cols * hm < shape[1] * h)[None]).ravel())
    pick = [chosen[p[0]] for p in parts]
    return Head(at + 2 + length, comps, [quants[p[3]] for p in parts], [tables[0, c >> 4][2] for c in pick], [tables[1, c & 15][2] for c in pick], np.array(inside))


def decode_scans(frames: list[bytes], head: Head) -> np.ndarray:
    """Quantised coefficients in zigzag order (frames, blocks, 64) of frames with one header, all decoded side by side."""
    joined = np.frombuffer(b"".join([f[head.size :] for f in frames]) + b"\0" * 16, np.uint8)
    starts = np.cumsum([0, *(len(f) - head.size for f in frames)])[:-1]
    stuffed = np.flatnonzero((joined[1:] == 0) & (joined[:-1] == 255)) + 1
    data = np.delete(joined, stuffed)
    pos = (starts - np.searchsorted(stuffed, starts)) * 8
    most = len(data) - 8
    window = np.ndarray((len(data) - 7,), ">u8", data.tobytes(), strides=(1,))
    out = np.zeros((len(frames), len(head.comps), 64), np.int16)
    previous = np.zeros((len(frames), len(head.quant)), np.int64)

    def symbols(pos: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = window[np.minimum(pos >> 3, most)].astype(np.uint64) << (pos & 7).astype(np.uint64)
        found = table[(x >> np.uint64(48)).astype(np.int64)]
        length, sym = found >> 8, found & 255
        if not length.all():
            raise ValueError("a frame holds an unknown Huffman code")
        size = sym & 15
        x = x << length.astype(np.uint64)
        amp = ((x >> np.uint64(1)) >> (63 - size).astype(np.uint64)).astype(np.int64)
        low = 1 << size
        return sym, np.where(amp < low >> 1, amp - low + 1, amp), pos + length + size

    everyone = np.arange(len(frames))
    for b, comp in enumerate(head.comps):
        _, v, pos = symbols(pos, head.dc[comp])
        previous[:, comp] += v
        out[:, b, 0] = previous[:, comp]
        who, k = everyone, np.zeros(len(frames), np.int64)
        while len(who):
            sym, v, ends = symbols(pos[who], head.ac[comp])
            pos[who] = ends
            k = k + (sym >> 4) + 1
            real = (sym & 15) > 0
            if real.all():
                if k.max() > 63:
                    raise ValueError("a block holds more than 64 coefficients")
                out[who, b, k] = v
                on = k < 63
            else:
                if k[real].max(initial=0) > 63:
                    raise ValueError("a block holds more than 64 coefficients")
                out[who[real], b, k[real]] = v[real]
                on = (real | (sym == 0xF0)) & (k < 63)
            if not on.all():
                who, k = who[on], k[on]
    ends = np.append(starts[1:], len(joined) - 16)
    if (pos > (ends - np.searchsorted(stuffed, ends)) * 8).any():
        raise ValueError("a frame ends before its blocks do")
    return out


@lru_cache(1)
def idct() -> np.ndarray:
    """(zigzag coefficients, pixels) matrix of the inverse DCT."""
    x, u = np.meshgrid(np.arange(8), np.arange(8))
    basis = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)[ZIGZAG].astype(np.float32)


BINS = 16


def luma_histograms(coefs: np.ndarray, head: Head) -> np.ndarray:
    """Shares of the picture in each of 16 levels of luma, by frame."""
    luma = coefs[:, head.comps == 0]
    n = len(luma)
    pixels = (luma.reshape(-1, 64).astype(np.float32) * head.quant[0]) @ idct() + 128
    level = np.clip(np.rint(pixels), 0, 255).astype(np.int64) >> 4
    level += np.repeat(np.arange(n) * BINS, luma.shape[1])[:, None]
    inside = level.reshape(n, -1)[:, head.luma.ravel()]
    counts = np.bincount(inside.ravel(), minlength=n * BINS).reshape(n, BINS)
    return counts / max(1, int(head.luma.sum()))


def decode_all(videos: list[list[bytes]], block: int = 2048) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(video, first frame, coefficients, luma histograms), in order for each video; frames with equal headers go together."""
    heads: dict[bytes, Head] = {}
    flat = [(i, k) for i, frames in enumerate(videos) for k in range(len(frames))]
    last: tuple[bytes, Head] | None = None
    queue: list[tuple[int, int]] = []

    def done() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        coefs = decode_scans([videos[i][k] for i, k in queue], last[1])
        shares = luma_histograms(coefs, last[1])
        at = 0
        while at < len(queue):
            end = at + 1
            while end < len(queue) and queue[end][0] == queue[at][0]:
                end += 1
            yield queue[at][0], queue[at][1], coefs[at:end], shares[at:end]
            at = end

    for i, k in flat:
        frame = videos[i][k]
        if last is None or not frame.startswith(last[0]):
            if queue:
                yield from done()
                queue = []
            head = jpeg_head(frame)
            last = (frame[: head.size], heads.setdefault(frame[: head.size], head))
        queue.append((i, k))
        if len(queue) >= block:
            yield from done()
            queue = []
    if queue:
        yield from done()


def shot_starts(shares: np.ndarray, window: int = 8, sigmas: float = 2.0, least: float = 0.08) -> np.ndarray:
    """First frames of the shots.  A cut: the histogram difference exceeds ``least`` and the mean of the last ``window``
    differences by ``sigmas`` of their deviations; before two differences are known, twice ``least`` decides."""
    if not len(shares):
        return np.zeros(0, np.int64)
    d = np.abs(np.diff(shares, axis=0)).sum(1) / 2
    s1, s2 = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    at = np.arange(len(d))
    low = np.maximum(0, at - window)
    n = at - low
    mean = (s1[at] - s1[low]) / np.maximum(1, n)
    std = np.sqrt(np.maximum(0, (s2[at] - s2[low]) / np.maximum(1, n) - mean**2))
    cut = np.where(n < 2, d > 2 * least, (d > least) & (d > mean + sigmas * std))
    return np.concatenate([[0], np.flatnonzero(cut) + 1])


STORED = "doc_id long, n_bytes long, media binary"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as UTF-8, with bytes 255 appended up to a positive multiple of 576, as frames.

    Null and empty texts give one frame of 255s.  Repeated rows give repeated rows, an empty table none.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, buf, offs in chunks(batch.column("text"), 1 << 20):
                n = np.diff(offs)
                frames = np.maximum(1, -(-n // FRAME))
                first = np.concatenate([[0], np.cumsum(frames)])
                payload = np.full(int(first[-1]) * FRAME, 255, np.uint8)
                payload[np.arange(len(buf)) + np.repeat(first[:-1] * FRAME - offs[:-1], n)] = buf
                stored: list[bytes] = []
                for a in range(0, int(first[-1]), 2048):
                    scan, at = entropy_code(payload[a * FRAME : (a + 2048) * FRAME])
                    raw = scan.tobytes()
                    stored += [JPEG_HEAD + raw[x:y] + b"\xff\xd9" for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                media = [avi(stored[x:y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(n), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return source.mapInArrow(store, STORED)


def _rows(col: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes."""
    _, offs = column_bytes(col)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


CLIPS = "doc_id long, clip_no int, first_frame int, end_frame int, start_s double, end_s double, level double, error string"


def all_shares(files: list[list[bytes]]) -> list[np.ndarray | ValueError]:
    """The luma histograms of each file's frames; of a file that can't be decoded, the error.  All go side by side, or one by
    one where one of them is malformed."""
    shares: list[list[np.ndarray]] = [[np.zeros((0, BINS))] for _ in files]
    try:
        for v, _, _, s in decode_all(files):
            shares[v].append(s)
    except ValueError as e:
        return [e] if len(files) == 1 else [one for f in files for one in all_shares([f])]
    return [np.concatenate(s) for s in shares]


def media_clips(media: DataFrame, id_col: str = "doc_id", column: str = "media") -> DataFrame:
    """One row for each shot: its frames [first_frame, end_frame), its times, and its mean luma level (0 to 15).

    Null media give no row, and neither does a file without frames.  A file that is no AVI with baseline JPEG frames, or ends
    before its frames do, gives one row of nulls with the reason as ``error``; other files are not touched by it.
    """
    source = media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(column).alias("media")).where("media IS NOT NULL")

    def opened(raw: bytes) -> tuple[list[bytes], float, str | None]:
        try:
            return *riff_frames(raw), None
        except ValueError as e:
            return [], 0.0, str(e)

    def clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in _rows(batch.column("media")):
                files = [opened(x.as_py()) for x in batch.column("media")[i:j]]
                shares = all_shares([f for f, _, _ in files])
                out = []
                for doc, (_, step, error), s in zip(batch.column("doc_id")[i:j].to_pylist(), files, shares, strict=True):
                    error = str(s) if isinstance(s, ValueError) else error
                    out += [(doc, *[None] * 6, error)] if error else [(doc, *clip, None) for clip in clip_rows(s, step)]
                yield arrow_rows(out, CLIPS)

    return source.mapInArrow(clips, CLIPS)


def clip_rows(shares: np.ndarray, step: float) -> list[tuple]:
    starts = shot_starts(shares)
    levels = shares @ np.arange(BINS)
    ends = [*starts[1:].tolist(), len(shares)]
    return [(n, a, b, a * step, b * step, float(levels[a:b].mean())) for n, (a, b) in enumerate(zip(starts.tolist(), ends, strict=False)) if b > a]


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_clips long"


def media_digests(stored: DataFrame) -> DataFrame:
    """Digests of stored payloads as read back from the media, and a feature string made of the clips."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in _rows(batch.column("media")):
                media = [x.as_py() for x in batch.column("media")[i:j]]
                files = [riff_frames(x) for x in media]
                shares: list[list[np.ndarray]] = [[] for _ in files]
                hashes, tails, sizes = [hashlib.sha256() for _ in files], [b""] * len(files), [0] * len(files)
                for v, _, coefs, s in decode_all([f for f, _ in files]):
                    shares[v].append(s)
                    read = (coefs.reshape(-1) + 128).astype(np.uint8).tobytes()
                    hashes[v].update(read)
                    tails[v], sizes[v] = read[-32:], sizes[v] + len(read)
                out = []
                ids, lengths = batch.column("doc_id")[i:j].to_pylist(), batch.column("n_bytes")[i:j].to_pylist()
                for k, (_, step) in enumerate(files):
                    clips = clip_rows(np.concatenate(shares[k]), step)
                    feature = ";".join(f"{a}-{b}@{level:.3f}" for _, a, b, _, _, level in clips)
                    out.append((ids[k], lengths[k], sizes[k], hashes[k].hexdigest(), zlib.crc32(tails[k]), len(media[k]), hashlib.sha256(media[k]).hexdigest(), feature, len(clips)))
                yield arrow_rows(out, DIGESTS)

    return stored.mapInArrow(digests, DIGESTS)
