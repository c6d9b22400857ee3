"""Media columns: AVI files of lossless motion JPEG, read by their RIFF index, with shots by adaptive histogram differences.

A frame is 24 x 8 grey samples in lossless JPEG (the predictive process, left neighbour). The Huffman table gives the
difference class of s bits a code of 9 - s bits, so that each sample takes 9 bits and a frame's samples are coded and
decoded as a matrix; other tables are decoded bit by bit.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import table

WIDTH, HEIGHT, FPS = 24, 8, 25
FRAME = WIDTH * HEIGHT
#: Frames are coded and decoded in runs of this many.
RUN = 4096
#: A RIFF segment is closed at this size, before its 32-bit lengths run out; the file goes on in a further segment.
SEGMENT = 1_000_000_000

# class s (0-8) → code of 9 - s bits: 0, 10, 110, ... for 8, 7, 6, ...
CODES = [((1 << (9 - s)) - 2, 9 - s) for s in range(9)]
DHT = b"\xff\xc4" + struct.pack(">HB", 2 + 1 + 16 + 9, 0) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))


def jpeg_header(width: int, height: int) -> bytes:
    sof = b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\x01\x11\x00"
    sos = b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00" + b"\x01\x00\x00"
    return b"\xff\xd8" + DHT + sof + sos


HEADER, END = jpeg_header(WIDTH, HEIGHT), b"\xff\xd9"
#: For each difference from -255 to 255 its 9-bit code.
CODE_OF = np.zeros(511, np.uint16)
for _d in range(-255, 256):
    _s = abs(_d).bit_length()
    _bits = (_d if _d >= 0 else _d + (1 << _s) - 1) & ((1 << _s) - 1)
    CODE_OF[_d + 255] = CODES[_s][0] << _s | _bits
#: And back; 0x7FFF marks what is no code.
DIFF_OF = np.full(512, 0x7FFF, np.int16)
DIFF_OF[CODE_OF] = np.arange(-255, 256)


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """JPEG files of frames (n, HEIGHT, WIDTH) of 8-bit samples."""
    x = frames.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    codes = CODE_OF[d.reshape(len(x), FRAME) + 255]
    bits = ((codes[:, :, None] >> np.arange(8, -1, -1, dtype=np.uint16)) & 1).astype(np.uint8)
    packed = np.packbits(bits.reshape(len(x), -1), axis=1)  # FRAME * 9 bits are whole bytes
    return [HEADER + row.tobytes().replace(b"\xff", b"\xff\x00") + END for row in packed]


def decode_frames(files: list[bytes]) -> np.ndarray:
    """The samples (n, HEIGHT, WIDTH) of JPEG files with our header; others go through :func:`decode_any`."""
    size, h = FRAME * 9 // 8, len(HEADER)
    rows = []
    for f in files:
        if not (f.startswith(HEADER) and f.endswith(END)):
            return np.stack([decode_any(x) for x in files])
        rows.append(f[h:-2].replace(b"\xff\x00", b"\xff"))
    if any(len(r) != size for r in rows):
        raise ValueError("a frame's coded samples have the wrong length")
    bits = np.unpackbits(np.frombuffer(b"".join(rows), np.uint8)).reshape(len(rows), FRAME, 9)
    codes = bits.astype(np.int16) @ (1 << np.arange(8, -1, -1, dtype=np.int16))
    d = DIFF_OF[codes]
    if (d == 0x7FFF).any():
        raise ValueError("a frame holds bits that are no code")
    d = d.reshape(len(rows), HEIGHT, WIDTH).astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return np.cumsum(d, axis=2).astype(np.uint8)


def decode_any(f: bytes) -> np.ndarray:
    """A lossless JPEG of one component and 8 bits with any table and any of the seven predictors, without restarts."""
    if f[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, table_of, width, height = 2, {}, 0, 0
    while True:
        marker, size = f[at + 1], struct.unpack(">H", f[at + 2 : at + 4])[0]
        body = f[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            counts, values, code, k = body[1:17], body[17:], 0, 0
            for length, n in enumerate(counts, 1):
                for _ in range(n):
                    table_of[(length, code)] = values[k]
                    code, k = code + 1, k + 1
                code <<= 1
        elif marker == 0xC3:
            height, width = struct.unpack(">HH", body[1:5])
        elif marker == 0xDA:
            predictor = body[3]
            break
        elif marker in range(0xC0, 0xD0):
            raise ValueError("only lossless frames are decoded")
    data = f[at : f.rindex(END)].replace(b"\xff\x00", b"\xff")
    bits, place = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0
    out = np.zeros((height, width), np.int64)
    for y in range(height):
        for x in range(width):
            length = code = 0
            while (length, code) not in table_of:
                code, length, place = code << 1 | bits[place], length + 1, place + 1
            s = table_of[(length, code)]
            v = int("".join(map(str, bits[place : place + s])) or "0", 2)
            place += s
            diff = v if not s or v >> (s - 1) else v - (1 << s) + 1
            a, b, c = (int(out[y, x - 1]) if x else 0), (int(out[y - 1, x]) if y else 0), (int(out[y - 1, x - 1]) if x and y else 0)
            guess = 128 if not x and not y else a if not y else b if not x else (a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[predictor - 1]
            out[y, x] = (guess + diff) & 0xFF
    return out.astype(np.uint8)


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes], fps: int = FPS) -> bytes:
    """An AVI file of JPEG frames: headers, a movie list, and an index; further RIFF segments for what is over SEGMENT."""
    parts, at = [], 0
    while at < len(frames) or not parts:
        size, end = 0, at
        while end < len(frames) and (end == at or size < SEGMENT):
            size += len(frames[end]) + 9
            end += 1
        movie, index, offset = [], [], 4
        for f in frames[at:end]:
            movie.append(chunk(b"00dc", f))
            index.append(struct.pack("<4sIII", b"00dc", 0x10, offset, len(f)))
            offset += len(movie[-1])
        movi = chunk(b"LIST", b"movi" + b"".join(movie)) + chunk(b"idx1", b"".join(index))
        if parts:
            parts.append(chunk(b"RIFF", b"AVIX" + movi))
        else:
            main = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10, len(frames), 0, 1, 0, WIDTH, HEIGHT, 0, 0, 0, 0)
            stream = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
            picture = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
            head = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", picture)))
            parts.append(chunk(b"RIFF", b"AVI " + head + movi))
        at = end
    return b"".join(parts)


def indexed_frames(data: bytes) -> tuple[int, list[bytes]]:
    """Frames per second (at least 1) and the frames that the index names, in its order; ValueError where the file ends early."""
    fps, frames, at = 1, [], 0

    def word(p: int, end: int) -> int:
        if p + 4 > end:
            raise ValueError(f"the file ends within a chunk at byte {p}")
        return struct.unpack_from("<I", data, p)[0]

    if len(data) < 12:
        raise ValueError("no RIFF segment")
    while at + 12 <= len(data):
        if data[at : at + 4] != b"RIFF":
            raise ValueError(f"no RIFF segment at byte {at}")
        end = at + 8 + word(at + 4, len(data))
        if end > len(data):
            raise ValueError(f"the segment at byte {at} is cut off")
        p, movie = at + 12, 0
        while p + 8 <= end:
            name, size = data[p : p + 4], word(p + 4, end)
            if p + 8 + size > end:
                raise ValueError(f"the chunk at byte {p} is cut off")
            if name == b"LIST" and data[p + 8 : p + 12] == b"hdrl":
                fps = max(1, round(1_000_000 / max(1, word(p + 20, end))))
            elif name == b"LIST" and data[p + 8 : p + 12] == b"movi":
                movie = p + 8
            elif name == b"idx1":
                for kind, _, offset, length in struct.iter_unpack("<4sIII", data[p + 8 : p + 8 + size - size % 16]):
                    if kind[2:] in (b"dc", b"db"):
                        first = movie + offset + 8
                        if not movie or first + length > end:
                            raise ValueError(f"the index names a frame beyond the segment at byte {at}")
                        frames.append(data[first : first + length])
            p += 8 + size + (size & 1)
        at = end + (end - at & 1)
    if not frames:
        raise ValueError("no index names a frame")
    return fps, frames


def shots(hist: np.ndarray, window: int = 12, factor: int = 3, least: int = 96) -> list[int]:
    """The first frame of each shot: where the difference from the frame before stands out from those around it.

    A cut is where the sum of absolute differences of the histograms is at least ``least`` and more than ``factor`` times
    the mean of the differences within ``window`` frames (its own left out). All in whole numbers.
    """
    if not len(hist):
        return []
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1)
    total = np.concatenate([[0], np.cumsum(d)])
    i = np.arange(len(d))
    lo, hi = np.maximum(i - window, 0), np.minimum(i + window + 1, len(d))
    around, n = total[hi] - total[lo] - d, hi - lo - 1
    return [0, *(np.flatnonzero((d >= least) & (d * n > factor * around)) + 1).tolist()]


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "replace")
    return len(data), data + b" " * (FRAME - len(data) if not data else -len(data) % FRAME)


def store(payload: bytes) -> bytes:
    frames: list[bytes] = []
    for at in range(0, len(payload), RUN * FRAME):
        part = np.frombuffer(payload[at : at + RUN * FRAME], np.uint8)
        frames += encode_frames(part.reshape(-1, HEIGHT, WIDTH))
    return avi(frames)


def read(data: bytes) -> tuple[bytes, int, np.ndarray, list[int]]:
    """The payload, frames per second, histograms of 16 bins, and the shots of a stored file."""
    fps, files = indexed_frames(data)
    payload, hists = [], []
    for at in range(0, len(files), RUN):
        x = decode_frames(files[at : at + RUN])
        payload.append(x.tobytes())
        flat = (x.reshape(len(x), -1) >> 4) + (np.arange(len(x))[:, None] << 4)
        hists.append(np.bincount(flat.ravel(), minlength=len(x) * 16).reshape(-1, 16))
    hist = np.concatenate(hists) if hists else np.zeros((0, 16), int)
    return b"".join(payload), fps, hist, shots(hist)


def attempt(data: bytes | None) -> tuple[tuple[bytes, int, np.ndarray, list[int]] | None, str | None]:
    """What ``read`` gives, or why there is nothing to read: no file, or a file that is cut off, damaged or of another kind."""
    if data is None:
        return None, "no file"
    try:
        return read(data), None
    except (ValueError, IndexError, KeyError, struct.error) as e:
        return None, f"{type(e).__name__}: {e}"


def spans(fps: int, n_frames: int, cuts: list[int]) -> list[dict]:
    """The shots as timed clips."""
    return [{"clip": c, "start_s": s / fps, "end_s": e / fps, "first_frame": s, "n_frames": e - s} for c, (s, e) in enumerate(zip(cuts, [*cuts[1:], n_frames], strict=True))]


def to_media(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, n_bytes, media``: each whole text (null: empty) as the samples of an AVI file, padded with spaces.

    Repeated rows are each stored; an empty table gives no rows; other columns are ignored. A text is one file in memory.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                made = [(n, store(p)) for n, p in map(padded, part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], [key, "n_bytes", "media"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, n_bytes long, media binary")


CLIP = "array<struct<clip:int,start_s:double,end_s:double,first_frame:int,n_frames:int>>"


def clips(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, clip, start_s, end_s, first_frame, n_frames``: a row for each shot of each file; a null or broken file has none."""
    return describe(media.select(key, F.lit(0).cast("long").alias("n_bytes"), "media"), key).select(key, F.inline("clips"))


def describe(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """What is read back from each file: digests of payload and file, its shots as timed clips, and ``error``.

    ``media``: ``key, n_bytes, media``. Where a file is null, cut off, damaged or no AVI of lossless frames, ``error`` says
    so, what would be read from it is null and ``clips`` is empty; the size and digest of a file that is there stay. For
    others ``error`` is null. Repeated rows are each answered; an empty table gives no rows; other columns are ignored.
    """
    kind = media.schema[key].dataType.simpleString()
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips", "error"]
    clip = pa.list_(pa.struct([("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("first_frame", pa.int32()), ("n_frames", pa.int32())]))
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), clip, pa.string()]

    def facts(data: bytes | None) -> tuple:
        got, error = attempt(data)
        size, digest = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
        if got is None:
            return None, None, None, size, digest, None, [], error
        payload, fps, hist, cuts = got
        mean = hist.sum(axis=0) * 1000 // max(1, hist.sum())
        feature = f"frames={len(hist)};fps={fps};shots={len(cuts)};cuts={zlib.crc32(np.array(cuts, np.int64).tobytes()):08x};mean={'-'.join(map(str, mean))}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), size, digest, feature, spans(fps, len(hist), cuts), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                cols = zip(*(facts(x.as_py()) for x in part.column("media")), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("n_bytes"), *[pa.array(v, t) for v, t in zip(cols, types, strict=True)]], names)

    out = f"{key} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips {CLIP}, error string"
    return media.select(key, "n_bytes", "media").mapInArrow(run, out)


def op3_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(to_media(table(spark, sf_dir, "documents")))
