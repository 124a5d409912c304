"""AVI motion-JPEG columns.

A payload becomes 8-bit grey frames of 64 columns and up to 64 rows. Each frame is a
lossless JPEG (SOF3, predictor 1); every row of pixels is a restart interval, so all
rows of a batch are coded and decoded in step by numpy, one column at a time. Frames
lie in a RIFF AVI file with an idx1 index, which the reader follows. Shots are cut
where the histogram of a frame differs from the one before by more than its
surroundings explain.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, chunks, lean

SIDE = 64
FRAMES_PER_SECOND = 25
#: Size in bytes of the texts or media that one numpy pass codes.
PASS_BYTES = 1 << 20
#: A cut: the histogram difference is above FLOOR and above the mean of the NEAR frames
#: around it by SPREAD times their standard deviation.
FLOOR, SPREAD, NEAR = 0.2, 1.5, 4
#: Lengths of the codes of difference sizes 0..8, most frequent in text: 4 and 7.
CODE_LENGTHS = (4, 5, 4, 3, 2, 3, 5, 2, 5)


def _canonical(lengths):
    """JPEG's canonical codes: (counts by length 1..16, symbols in order, {symbol: code})."""
    order = sorted(range(len(lengths)), key=lambda s: (lengths[s], s))
    codes, code, last = {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = code
        code += 1
    return [lengths.count(i) for i in range(1, 17)], order, codes


_COUNTS, _SYMBOLS, _CODES = _canonical(list(CODE_LENGTHS))
_DIFF = np.arange(-255, 256)
_SIZE = np.array([int(abs(d)).bit_length() for d in _DIFF.tolist()])
_EXTRA = np.where(_DIFF > 0, _DIFF, _DIFF + (1 << _SIZE) - 1)
_CODE = (np.array([_CODES[s] for s in _SIZE.tolist()]) << _SIZE | np.where(_SIZE > 0, _EXTRA, 0)).astype(np.uint64)
_BITS = (np.array(CODE_LENGTHS)[_SIZE] + _SIZE).astype(np.uint64)


def _jpeg_head(rows: int) -> bytes:
    table = bytes([0]) + bytes(_COUNTS) + bytes(_SYMBOLS)
    return (
        b"\xff\xd8\xff\xc4" + struct.pack(">H", 2 + len(table)) + table
        + b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, rows, SIDE, 1, 1, 0x11, 0)
        + b"\xff\xdd" + struct.pack(">HH", 4, SIDE)
        + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
    )


_HEADS = {r: _jpeg_head(r) for r in range(1, SIDE + 1)}


def _code_rows(pixels: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of rows of 64 pixels, each stuffed and closed by the marker
    0xFF tail; and the bounds of the rows in them."""
    n = len(pixels)
    before = np.empty((n, SIDE), np.int16)
    before[:, 0] = 128
    before[:, 1:] = pixels[:, :-1]
    at = pixels.astype(np.int16) - before + 255
    code, bits = _CODE[at], _BITS[at]
    for _ in range(2):  # four pixels, at most 52 bits, to a word
        code = code[:, ::2] << bits[:, 1::2] | code[:, 1::2]
        bits = bits[:, ::2] + bits[:, 1::2]
    ends = np.cumsum(bits, axis=1)
    begins, total = ends - bits, ends[:, -1]
    words = np.zeros((n, 15), np.uint64)
    every = np.arange(n)
    for j in range(code.shape[1]):
        word, shift = (begins[:, j] >> np.uint64(6)).astype(np.int64), begins[:, j] & np.uint64(63)
        left = code[:, j] << (np.uint64(64) - bits[:, j])
        words[every, word] |= left >> shift
        words[every, word + 1] |= np.where(shift > 0, left << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    out = words.astype(">u8").view(np.uint8).reshape(n, -1)
    length = ((total + np.uint64(7)) >> np.uint64(3)).astype(np.int64)
    spare = (length * 8 - total.astype(np.int64)).astype(np.uint8)
    out[every, length - 1] |= ((1 << spare.astype(np.int64)) - 1).astype(np.uint8)
    out[every, length], out[every, length + 1] = 255, tails
    place = np.arange(out.shape[1])
    flat = out[place[None, :] < (length + 2)[:, None]]
    bound = np.concatenate(([0], np.cumsum(length + 2)))
    stuffed = flat == 255
    stuffed[bound[1:] - 2] = False
    shift = np.cumsum(stuffed)
    final = np.zeros(len(flat) + (int(shift[-1]) if n else 0), np.uint8)
    final[np.arange(len(flat)) + shift - stuffed] = flat
    return final, bound + np.concatenate(([0], shift[bound[1:] - 1]))


def _avi(frames: list[bytes], rows: int) -> bytes:
    """A RIFF AVI file of JPEG frames."""
    chunk = lambda tag, body: tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    most = max(map(len, frames))
    head = chunk(b"avih", struct.pack("<14I", 1_000_000 // FRAMES_PER_SECOND, most * FRAMES_PER_SECOND, 0, 0x10, len(frames), 0, 1, most, SIDE, rows, 0, 0, 0, 0))
    stream = chunk(b"strh", b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, FRAMES_PER_SECOND, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, rows))
    stream += chunk(b"strf", struct.pack("<IiiHH4sIiiII", 40, SIDE, rows, 1, 8, b"MJPG", SIDE * rows, 0, 0, 0, 0))
    header = chunk(b"LIST", b"hdrl" + head + chunk(b"LIST", b"strl" + stream))
    body, index, at = [], [], 4
    for f in frames:
        body.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(body[-1])
    return chunk(b"RIFF", b"AVI " + header + chunk(b"LIST", b"movi" + b"".join(body)) + chunk(b"idx1", b"".join(index)))


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """AVI files of payloads, each of a positive multiple of 64 bytes."""
    pixels = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, SIDE)
    counts = [len(p) // SIDE for p in payloads]
    inside = np.concatenate([np.arange(c) for c in counts])
    left = np.concatenate([np.arange(c, 0, -1) for c in counts])
    last = (inside % SIDE == SIDE - 1) | (left == 1)
    data, bound = _code_rows(pixels, np.where(last, 0xD9, 0xD0 + inside % 8).astype(np.uint8))
    data, bound = data.tobytes(), bound.tolist()
    out, row = [], 0
    for c in counts:
        frames = []
        for i in range(0, c, SIDE):
            rows = min(SIDE, c - i)
            frames.append(_HEADS[rows] + data[bound[row + i] : bound[row + i + rows]])
        out.append(_avi(frames, min(SIDE, c)))
        row += c
    return out


def frames_of(avi: bytes) -> list[tuple[int, int]]:
    """Offset and length of each video frame, by the RIFF index; without one, by the
    chunks of the movi list. An offset counts from the movi list or from the file."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index = 12, None, None
    while at + 8 <= len(avi):
        tag, size = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        if tag == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movi = (at + 8, at + 8 + size)
        elif tag == b"idx1":
            index = (at + 8, size)
        at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("no movi list")
    if index:
        found = [(o, n) for tag, _, o, n in struct.iter_unpack("<4sIII", avi[index[0] : index[0] + index[1] // 16 * 16]) if tag[2:] in (b"dc", b"db")]
        base = movi[0] if found and avi[movi[0] + found[0][0] : movi[0] + found[0][0] + 4] == b"00dc" else 0
        return [(base + o + 8, n) for o, n in found]
    found, at = [], movi[0] + 4
    while at + 8 <= movi[1]:
        size = struct.unpack_from("<I", avi, at + 4)[0]
        if avi[at + 2 : at + 4] in (b"dc", b"db"):
            found.append((at + 8, size))
        at += 8 + size + (size & 1)
    return found


def _parse(jpeg: memoryview) -> tuple[int, int, bytes, int, int]:
    """rows, columns, Huffman table, restart interval, start of the scan's data."""
    at, rows, cols, table, interval = 2, 0, 0, b"", 0
    while True:
        kind, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        if kind == 0xC4:
            table = bytes(jpeg[at + 5 : at + 2 + size])
        elif kind == 0xC3:
            rows, cols = struct.unpack_from(">HH", jpeg, at + 5)
        elif kind == 0xDD:
            interval = struct.unpack_from(">H", jpeg, at + 4)[0]
        elif kind == 0xDA:
            if cols != SIDE or interval != SIDE or jpeg[at + 7] != 1:
                raise ValueError("not a frame of 64 columns with a restart at each row and predictor 1")
            return rows, cols, table, interval, at + 2 + size
        elif 0xC0 <= kind <= 0xCF:
            raise ValueError("not a lossless JPEG")
        at += 2 + size


_TABLES: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """By the next 16 bits: bits of code and extra << 16 | difference & 0xFFFF."""
    if table not in _TABLES:
        out, code, at, peek = np.zeros(1 << 16, np.int64), 0, 16, np.arange(1 << 16)
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                size = table[at]
                if length + size > 16:
                    raise ValueError("code too long")
                low = code << (16 - length)
                own = peek[low : low + (1 << (16 - length))]
                extra = (own >> (16 - length - size)) & ((1 << size) - 1)
                diff = np.where(extra >> max(size - 1, 0) > 0, extra, extra - (1 << size) + 1) if size else np.zeros(len(own), int)
                out[low : low + len(own)] = (length + size) << 16 | (diff & 0xFFFF)
                code, at = code + 1, at + 1
            code <<= 1
        _TABLES[table] = out
    return _TABLES[table]


def decode_all(files: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """Pixels (rows of 64) of all frames of the files, and each file's number of rows."""
    scans, table, rows, counts = [], None, 0, []
    for f in files:
        view, own = memoryview(f), 0
        for o, n in frames_of(f):
            height, _, t, _, start = _parse(view[o : o + n])
            if table not in (None, t):
                raise ValueError("Huffman tables differ within a pass")
            table = t
            scans.append(view[o + start : o + n])
            own += height
        counts.append(own)
        rows += own
    raw = np.frombuffer(b"".join(scans), np.uint8)
    mark = np.flatnonzero(raw[:-1] == 255)
    follow = raw[mark + 1]
    ends = mark[(follow >= 0xD0) & (follow <= 0xD9)]
    if len(ends) != rows:
        raise ValueError("rows are missing")
    keep = np.ones(len(raw), bool)
    keep[mark[follow == 0] + 1] = False
    keep[ends] = keep[ends + 1] = False
    data = np.concatenate((raw[keep], np.zeros(4, np.uint8))).astype(np.int64)
    kept = np.cumsum(keep)
    bit = np.concatenate(([0], kept[ends[:-1]])) * 8
    wide = data[:-3] << 16 | data[1:-2] << 8 | data[2:-1]
    look = _lookup(table)
    diff = np.empty((rows, SIDE), np.int16)
    for j in range(SIDE):
        got = look[(wide[bit >> 3] >> (8 - (bit & 7))) & 0xFFFF]
        bit += got >> 16
        diff[:, j] = got.astype(np.int16)
    pixels = np.cumsum(diff, axis=1, dtype=np.int16) + np.int16(128)
    return pixels.astype(np.uint8), counts


def shots(pixels: np.ndarray) -> list[tuple[int, int]]:
    """First and last frame of each shot of a file's pixel rows."""
    frames = -(-len(pixels) // SIDE)
    if frames == 1:
        return [(0, 0)]
    level = (pixels >> 3).astype(np.int64) + (np.arange(len(pixels)) // SIDE * 32)[:, None]
    hist = np.bincount(level.ravel(), minlength=frames * 32).reshape(frames, 32)
    hist = hist / hist.sum(axis=1, keepdims=True)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1)
    sums, squares = (np.concatenate(([0.0], np.cumsum(v))) for v in (diff, diff * diff))
    i = np.arange(len(diff))
    lo, hi = np.maximum(0, i - NEAR), np.minimum(len(diff), i + NEAR + 1)
    mean = (sums[hi] - sums[lo]) / (hi - lo)
    std = np.sqrt(np.maximum(0, (squares[hi] - squares[lo]) / (hi - lo) - mean * mean))
    cuts = (np.flatnonzero((diff > FLOOR) & (diff > mean + SPREAD * std)) + 1).tolist()
    return [(a, b - 1) for a, b in zip([0, *cuts], [*cuts, frames], strict=True)]


def _payload(text: bytes) -> bytes:
    return text + b"\0" * ((-len(text)) % SIDE or SIDE * (not text))


@lean
def _encode(batches):
    for batch in batches:
        raw, off = buffers(batch.column(1))
        for i, j in chunks(off, PASS_BYTES):
            files = encode_all([_payload(raw[off[k] : off[k + 1]].tobytes()) for k in range(i, j)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array((off[i + 1 : j + 1] - off[i:j])), pa.array(files, pa.binary())], ["id", "n_bytes", "media"])


CLIPS = "array<struct<clip:int,first_frame:int,last_frame:int,start_ms:long,end_ms:long>>"


def _read(files: list[bytes | None]) -> list[np.ndarray | str]:
    """Of each file its pixels, or why it cannot be read. Files of one Huffman table are
    decoded together."""
    out: list[np.ndarray | str] = ["no media"] * len(files)
    by_table: dict[bytes, list[int]] = {}
    for k, f in enumerate(files):
        if f is not None:
            try:
                tables = {_parse(memoryview(f)[o : o + n])[2] for o, n in frames_of(f)}
                if len(tables) != 1:
                    raise ValueError("no frames" if not tables else "more than one Huffman table")
                by_table.setdefault(tables.pop(), []).append(k)
            except (ValueError, IndexError, struct.error) as e:
                out[k] = str(e)
    for group in by_table.values():
        for some in (group, *[[k] for k in group]):
            if any(isinstance(out[k], str) for k in some):
                try:
                    pixels, counts = decode_all([files[k] for k in some])
                    ends = np.cumsum(counts)
                    for k, a, b in zip(some, ends - counts, ends, strict=True):
                        out[k] = pixels[a:b]
                except (ValueError, IndexError, struct.error) as e:  # one of them is broken: each alone
                    if len(some) == 1:
                        out[some[0]] = str(e)
    return out


@lean
def _decode(batches):
    for batch in batches:
        raw, off = buffers(batch.column(2))
        there = batch.column(2).is_valid().to_pylist()
        for i, j in chunks(off, PASS_BYTES):
            files = [raw[off[k] : off[k + 1]].tobytes() if there[k] else None for k in range(i, j)]
            out = []
            for file, own in zip(files, _read(files), strict=True):
                if isinstance(own, str):
                    out.append((None, None, None, None if file is None else len(file), None if file is None else hashlib.sha256(file).hexdigest(), [], own))
                    continue
                payload = own.tobytes()
                clips = [
                    {"clip": c, "first_frame": a, "last_frame": b, "start_ms": a * 1000 // FRAMES_PER_SECOND, "end_ms": (b + 1) * 1000 // FRAMES_PER_SECOND}
                    for c, (a, b) in enumerate(shots(own))
                ]
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), clips, None))
            clip = pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64())])
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(clip), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *(pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True))],
                ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips", "error"],
            )


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: each whole text as an AVI file in a binary column.

    A null or empty text is 64 zero bytes. Equal texts give equal files, repeated rows
    stay, rows are independent, so no shuffle; other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_encode, "id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Decodes the media column (id, n_bytes, media): digests of payload and file, the timed
    clips, and error. Read are AVI files of lossless JPEG frames as to_media writes them: 64
    columns, a restart at each row. A null file has null results, no clips and the error
    "no media"; any other file that cannot be read, foreign, cut off or broken, has its size and
    digest, no clips and the reason; others beside it are read all the same."""
    schema = f"id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips {CLIPS}, error string"
    return media.select("id", "n_bytes", "media").mapInArrow(_decode, schema)


def clip_rows(read: DataFrame) -> DataFrame:
    """One row for each clip: id, clip, first and last frame, start and end in ms."""
    return read.select("id", F.inline("clips"))
