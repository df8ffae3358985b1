"""Media columns: bytes kept losslessly in an AVI motion-JPEG stream, read back, and cut into timed clips.

One frame holds 576 payload bytes as a 24x24 grey baseline JPEG of nine 8x8 blocks. The unit that carries a byte is a
quantised DCT coefficient: with every coefficient in size category 8, the eight bits that follow its Huffman code are the
byte itself (category 8 has exactly 256 values, -255..-128 and 128..255). The frame's own Huffman tables give that one
symbol an eight-bit code and a restart marker follows each block, so that DC prediction starts at 0 in every block.

Null text counts as empty; an empty text is one frame of 576 bytes of 255. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FRAME = 576
SIDE = 24
FPS = 25
_BLOCKS = FRAME // 64
_ONE_CODE = bytes([0, 0, 0, 0, 0, 0, 0, 1] + [0] * 8) + b"\x08"
HEADER = (
    b"\xff\xd8"
    + b"\xff\xdb" + struct.pack(">HB", 67, 0) + b"\x01" * 64
    + b"\xff\xc0" + struct.pack(">HBHHBBBB", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
    + b"\xff\xc4" + struct.pack(">HB", 20, 0x00) + _ONE_CODE
    + b"\xff\xc4" + struct.pack(">HB", 20, 0x10) + _ONE_CODE
    + b"\xff\xdd" + struct.pack(">HH", 4, 1)
    + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 0, 63, 0)
)
_SCAN = _BLOCKS * 130 - 2
_SIZE = len(HEADER) + _SCAN + 2
_PLAIN = _SIZE + _SIZE % 2


def _zigzag() -> np.ndarray:
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """Zigzag coefficients to pixels, in 1/1024: whole numbers, so that float32 products and sums are exact."""
    k = np.arange(8)
    c = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(0.5), 1)[:, None] / 2
    full = np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)
    return np.rint(full[ZIGZAG] * 1024).astype(np.float32)


BASIS = _basis()


def pad(data: bytes) -> bytes:
    """The payload: data and bytes 255 up to a positive multiple of 576."""
    return data + b"\xff" * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))


def _frames(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames without byte stuffing as rows of chunks, and which of them hold a byte 255, so that they need it."""
    p = np.frombuffer(payload, np.uint8).reshape(-1, _BLOCKS, 64)
    scan = np.zeros((len(p), _BLOCKS, 130), np.uint8)
    scan[:, :, 1:128:2] = p
    scan[:, :, 128] = 0xFF
    scan[:, :, 129] = 0xD0 + np.arange(_BLOCKS) % 8
    out = np.zeros((len(p), 8 + _PLAIN), np.uint8)
    out[:, :8] = np.frombuffer(b"00dc" + struct.pack("<I", _SIZE), np.uint8)
    out[:, 8 : 8 + len(HEADER)] = np.frombuffer(HEADER, np.uint8)
    at = 8 + len(HEADER)
    out[:, at : at + _SCAN] = scan.reshape(len(p), -1)[:, :_SCAN]
    out[:, at + _SCAN] = 0xFF
    out[:, at + _SCAN + 1] = 0xD9
    return out, (p == 255).any(axis=(1, 2))


def _stuffed(chunk: np.ndarray) -> bytes:
    at = 8 + len(HEADER)
    scan = chunk[at : at + _SCAN]
    data = np.flatnonzero(scan == 255)
    data = data[(data % 130 < 128) & (data % 130 % 2 == 1)]
    jpeg = HEADER + np.insert(scan, data + 1, 0).tobytes() + b"\xff\xd9"
    return b"00dc" + struct.pack("<I", len(jpeg)) + jpeg + b"\0" * (len(jpeg) % 2)


def encode(payload: bytes) -> bytes:
    """An AVI file with one motion-JPEG video stream that holds the payload (a positive multiple of 576 bytes)."""
    chunks, odd = _frames(payload)
    n = len(chunks)
    parts, sizes, start = [], np.full(n, _SIZE, np.int64), 0
    for i in np.flatnonzero(odd):
        parts += [chunks[start:i].tobytes(), one := _stuffed(chunks[i])]
        sizes[i] = struct.unpack_from("<I", one, 4)[0]
        start = i + 1
    movi = b"movi" + b"".join([*parts, chunks[start:].tobytes()])
    index = np.zeros((n, 4), "<u4")
    index[:, 0] = struct.unpack("<I", b"00dc")[0]
    index[:, 1] = 0x10
    step = 8 + sizes + sizes % 2
    index[:, 2] = 4 + np.cumsum(step) - step
    index[:, 3] = sizes
    avih = struct.pack("<14I", 1_000_000 // FPS, int(sizes.max()) * FPS, 0, 0x10, n, 0, 1, int(sizes.max()), SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, FPS, 0, n, int(sizes.max()), -1, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body
    strl = b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)
    hdrl = b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", strl)
    body = b"AVI " + chunk(b"LIST", hdrl) + chunk(b"LIST", movi) + chunk(b"idx1", index.tobytes())
    return chunk(b"RIFF", body)


def parse_riff(data: bytes) -> tuple[list[tuple[int, int]], float]:
    """(offset, size) of each video frame, from the index, and the frames per second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, fps = None, None, float(FPS)

    def walk(at: int, end: int) -> None:
        nonlocal movi, index, fps
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST":
                if data[at + 8 : at + 12] == b"movi":
                    movi = at + 8
                else:
                    walk(at + 12, at + 8 + size)
            elif name == b"strh" and data[at + 8 : at + 12] == b"vids":
                scale, rate = struct.unpack_from("<II", data, at + 8 + 20)
                fps = rate / scale
            elif name == b"idx1":
                index = np.frombuffer(data, "<u4", size // 4, at + 8).reshape(-1, 4)
            at += 8 + size + size % 2

    walk(12, 8 + struct.unpack_from("<I", data, 4)[0])
    if movi is None or index is None:
        raise ValueError("no frames or no index")
    rows = index[index[:, 0] == struct.unpack("<I", b"00dc")[0]]
    return [(movi + int(o) + 8, int(s)) for o, s in rows[:, 2:]], fps


def _codes(spec: bytes) -> dict[tuple[int, int], int]:
    """Canonical Huffman codes of a DHT segment: (length, code) to symbol."""
    out, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            out[length, code] = spec[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def decode_jpeg(jpeg: bytes) -> np.ndarray:
    """Quantised zigzag coefficients of a grey baseline JPEG of any tables, a row for each block."""
    dc, ac, at, every, shape = {}, {}, 2, 0, (0, 0)
    while True:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = _codes(body[1:n])
                body = body[n:]
        elif marker == 0xC0:
            shape = struct.unpack_from(">HH", body, 1)
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            tables = dc[body[2] >> 4], ac[body[2] & 15]
            break
    blocks = -(-shape[0] // 8) * -(-shape[1] // 8)
    out = np.zeros((blocks, 64), np.int32)
    data, ends = jpeg[at:], []
    runs, i, run = [], 0, bytearray()
    while i < len(data):
        if data[i] == 0xFF:
            if data[i + 1] == 0:
                run.append(0xFF)
            else:
                runs.append(bytes(run))
                run = bytearray()
                ends.append(data[i + 1])
                if data[i + 1] == 0xD9:
                    break
            i += 2
        else:
            run.append(data[i])
            i += 1
    block = 0
    for r in runs:
        bits, p, pred = "".join(f"{x:08b}" for x in r), 0, 0

        def symbol(codes: dict, bits: str = bits) -> int:
            nonlocal p
            code = 0
            for length in range(1, 17):
                code = code << 1 | (bits[p] == "1")
                p += 1
                if (length, code) in codes:
                    return codes[length, code]
            raise ValueError("bad Huffman code")

        def value(size: int, bits: str = bits) -> int:
            nonlocal p
            if not size:
                return 0
            v = int(bits[p : p + size], 2)
            p += size
            return v if v >> (size - 1) else v - (1 << size) + 1

        for _ in range(every or blocks):
            if block == blocks:
                break
            pred += value(symbol(tables[0]))
            out[block, 0] = pred
            k = 1
            while k < 64:
                s = symbol(tables[1])
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    out[block, k] = value(s & 15)
                k += 1
            block += 1
    return out


_MARKS = np.array([130 * b + i for b in range(_BLOCKS - 1) for i in (128, 129)])
_MARK_BYTES = np.array([x for b in range(_BLOCKS - 1) for x in (0xFF, 0xD0 + b % 8)], np.uint8)
_CODE_AT = np.array([130 * b + i for b in range(_BLOCKS) for i in range(0, 128, 2)])
_HEAD = np.frombuffer(HEADER, np.uint8)


def coefficients(data: bytes, frames: list[tuple[int, int]]) -> np.ndarray:
    """Coefficients of all frames (frames, blocks, 64). Frames with this module's tables are decoded together."""
    raw = np.frombuffer(data, np.uint8)
    out = np.empty((len(frames), _BLOCKS, 64), np.int16)
    at, sizes = np.array(frames, np.int64).T
    scans = np.empty((len(frames), _SCAN), np.uint8)
    good = np.zeros(len(frames), bool)
    plain = np.flatnonzero(sizes == _SIZE)
    for lo in range(0, len(plain), 4096):
        part = plain[lo : lo + 4096]
        rows = np.lib.stride_tricks.sliding_window_view(raw, _SIZE)[at[part]]
        good[part] = (rows[:, : len(HEADER)] == _HEAD).all(axis=1)
        scans[part] = rows[:, len(HEADER) : -2]
    for i in np.flatnonzero(sizes != _SIZE):
        one = raw[at[i] : at[i] + sizes[i]]
        if len(one) > len(HEADER) and (one[: len(HEADER)] == _HEAD).all():
            scan = one[len(HEADER) : -2]
            scan = np.delete(scan, np.flatnonzero((scan[:-1] == 255) & (scan[1:] == 0)) + 1)
            if len(scan) == _SCAN:
                scans[i], good[i] = scan, True
    good &= (scans[:, _MARKS] == _MARK_BYTES).all(axis=1) & (scans[:, _CODE_AT] == 0).all(axis=1)
    v = scans[:, _CODE_AT + 1].astype(np.int16)
    out[:] = np.where(v >= 128, v, v - 255).reshape(out.shape)
    for i in np.flatnonzero(~good):
        out[i] = decode_jpeg(data[at[i] : at[i] + sizes[i]])
    return out


def payload_of(coef: np.ndarray) -> bytes:
    return np.where(coef >= 128, coef, coef + 255).astype(np.uint8).tobytes()


def histograms(coef: np.ndarray) -> np.ndarray:
    """16-bin grey histogram of each decoded frame."""
    n = len(coef)
    out = np.empty((n, 16), np.int64)
    for lo in range(0, n, 1024):
        part = coef[lo : lo + 1024].reshape(-1, 64).astype(np.float32)
        bins = (np.clip((part @ BASIS) / 1024 + 128.5, 0, 255).astype(np.int32) >> 4).reshape(-1, FRAME)
        key = bins + 16 * np.arange(len(bins), dtype=np.int32)[:, None]
        out[lo : lo + len(bins)] = np.bincount(key.ravel(), minlength=16 * len(bins)).reshape(-1, 16)
    return out


def shots(hist: np.ndarray, window: int = 12, k: float = 3.0, least: int = 115) -> np.ndarray:
    """First frames of the shots. A cut is where the L1 change of the histogram exceeds mean + k deviations of up to
    `window` changes before it, and `least` pixels."""
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1)
    if not len(d):
        return np.zeros(1, np.int64)
    s1, s2 = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    hi = np.arange(len(d))
    lo = np.maximum(0, hi - window)
    n = np.maximum(hi - lo, 1)
    mean = (s1[hi] - s1[lo]) / n
    dev = np.sqrt(np.maximum((s2[hi] - s2[lo]) / n - mean * mean, 0))
    return np.concatenate([[0], np.flatnonzero((hi > lo) & (d > mean + k * dev) & (d > least)) + 1])


def features(media: bytes) -> tuple[bytes, np.ndarray, np.ndarray, float]:
    """Payload, histograms, first frames of the shots and frames per second of a stored file."""
    frames, fps = parse_riff(media)
    coef = coefficients(media, frames)
    hist = histograms(coef)
    return payload_of(coef), hist, shots(hist), fps


def _texts(b: pa.RecordBatch):
    for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
        yield i, t or b""


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """A row for each document: what was stored and what is read back from the stored form."""

    def run(batches):
        for b in batches:
            rows = []
            for i, text in _texts(b):
                media = encode(pad(text))
                payload, hist, cuts, fps = features(media)
                mean = hist.sum(axis=0) * 255 // (len(hist) * FRAME)
                feature = f"frames={len(hist)};fps={fps:g};shots={len(cuts)};hist={bytes(mean.astype(np.uint8)).hex()}"
                row = [i, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature]
                rows.append([*row, media] if keep_media else row)
            for part in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[part : part + 1000], strict=True), types, strict=True)], names)

    names = [x.split()[0] for x in STORED.split(", ")] + ["media"] * keep_media
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * keep_media
    return docs.select("doc_id", "text").mapInArrow(run, STORED + ", media binary" * keep_media)


def media_clips(docs: DataFrame) -> DataFrame:
    """Timed clip rows, one for each shot of each document's stored stream."""

    def run(batches):
        for b in batches:
            rows = []
            for i, text in _texts(b):
                _, hist, cuts, fps = features(encode(pad(text)))
                ends = [*cuts[1:].tolist(), len(hist)]
                rows += [(i, n, lo, hi, lo / fps, hi / fps) for n, (lo, hi) in enumerate(zip(cuts.tolist(), ends, strict=True))]
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "clip", "first_frame", "end_frame", "start_s", "end_s"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, clip long, first_frame long, end_frame long, start_s double, end_s double")
