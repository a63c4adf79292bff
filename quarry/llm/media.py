"""Media columns: AVI files of motion JPEG, written and read without loss, with shots from adaptive histogram differences.

Storage. A text's UTF-8 bytes are padded with zero bytes to a positive multiple of 64: one 8 x 8 block of a baseline JPEG for each 64
bytes, whose unit is the quantised coefficient. A byte is the 8 extra bits of a coefficient of size class 8 (128 to 255 or
-255 to -128), in zigzag order, so every byte is kept as it is. Frames are grey, 64 x 64 pixels; each block is a restart
interval, so blocks decode independently. Blocks without coefficients fill the last frame.

Reading. The RIFF chunks and the index give the frames; tables, components, scan and restart intervals are parsed from each frame.
Intervals that consist of such coefficients are unpacked at once, all others by a general Huffman reader: any baseline JPEG that
holds its tables, grey or in colour (of which the luminance counts). Pixels come from the
inverse cosine transform. A frame starts a shot if its grey histogram differs from the one before by more than the median and three
deviations (by median deviation) of the differences around it, leaving itself out.

Null texts are empty, that is one block of zero bytes. Null, empty, broken and unsupported files (progressive ones, or without their
tables) give a row with the reason as ``problem``; the rest of the table is read. Repeated rows come out as often as they stand; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_batches

SIDE, BLOCKS = 64, 64  # pixels on a side, blocks of a frame
RATE = 10  # frames a second
BINS, AROUND, LEAST = 16, 8, 0.05
DEVIATION = 1.4826  # standard deviations in a median deviation
#: Zigzag order of an 8 x 8 block, by rule: diagonals, taken up and down in turn.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_u = np.arange(8)
_COS = np.cos((2 * _u[None, :] + 1) * _u[:, None] * np.pi / 16) * np.where(_u == 0, np.sqrt(1 / 8), 0.5)[:, None]  # [frequency, place]
_INVERSE = np.kron(_COS, _COS)[ZIGZAG].astype(np.float32)  # zigzag coefficients to pixels


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Codes "0" for size class 8 and "10" for 0 (end of block), alike for DC and AC.
_LENGTHS = bytes([1, 1, *[0] * 14])
_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\0" + b"\1" * 64)
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\x00" + _LENGTHS + b"\x08\x00")
    + _segment(0xC4, b"\x10" + _LENGTHS + b"\x08\x00")
    + _segment(0xDD, b"\0\1")
    + _segment(0xDA, b"\1\1\0\0\x3f\0")
)
_EMPTY = 0b10101111  # both end codes, filled up with ones


def encode_frame(payload: np.ndarray) -> bytes:
    """A JPEG of up to BLOCKS x 64 bytes."""
    n = len(payload) // 64
    bits = np.zeros((n * 64, 9), np.uint8)
    bits[:, 1:] = np.unpackbits(payload).reshape(-1, 8)
    data = np.zeros((n, 74), np.uint8)
    data[:, :72] = np.packbits(bits.reshape(-1)).reshape(n, 72)
    data[:, 72], data[:, 73] = 0xFF, 0xD0 + np.arange(n) % 8
    flat = data.reshape(-1)
    stuff = np.flatnonzero(data[:, :72].reshape(-1) == 0xFF)
    body = np.insert(flat, stuff // 72 * 74 + stuff % 72 + 1, 0).tobytes()
    rest = b"".join(bytes([_EMPTY, 0xFF, 0xD0 + i % 8]) for i in range(n, BLOCKS))
    return _HEAD + (body + rest)[:-2] + b"\xff\xd9"


def encode(payload: bytes) -> bytes:
    """An AVI file of the payload, whose length is a positive multiple of 64."""
    data = np.frombuffer(payload, np.uint8)
    frames = [encode_frame(data[i : i + 64 * BLOCKS]) for i in range(0, len(data), 64 * BLOCKS)]
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        movi.append(b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) % 2))
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += len(movi[-1])
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body
    most = max(map(len, frames))
    avih = chunk(b"avih", struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0))
    strh = chunk(b"strh", b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE))
    strf = chunk(b"strf", struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0))
    hdrl = chunk(b"LIST", b"hdrl" + avih + chunk(b"LIST", b"strl" + strh + strf))
    return chunk(b"RIFF", b"AVI " + hdrl + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index)))


def read_frames(avi: bytes) -> tuple[list[memoryview], float]:
    """The frames by the index, and the seconds of each. Offsets of the index count from the list of frames or from the file's start."""
    view = memoryview(avi)
    if view[:4] != b"RIFF" or view[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, step, index = 0, 1 / RATE, []

    def walk(at: int, end: int) -> None:
        nonlocal movi, step
        while at + 8 <= end:
            name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", avi, at + 4)[0]
            kind = bytes(view[at + 8 : at + 12])
            if name == b"LIST" and kind == b"movi":
                movi = at + 8
            elif name == b"LIST" and kind == b"hdrl":
                walk(at + 12, min(end, at + 8 + size))
            elif name == b"avih" and size >= 4:
                step = struct.unpack_from("<I", avi, at + 8)[0] / 1e6
            elif name == b"idx1":
                index.extend(struct.iter_unpack("<4sIII", view[at + 8 : at + 8 + min(size, end - at - 8) // 16 * 16]))
            at += 8 + size + size % 2

    walk(12, len(avi))
    places = [(offset, length) for kind, _, offset, length in index if kind[2:] in (b"dc", b"db")]
    if places and not movi:
        raise ValueError("no list of frames")
    base = 0 if places and places[0][0] >= movi + 4 else movi
    frames = [view[base + offset + 8 : base + offset + 8 + length] for offset, length in places]
    if not frames:
        raise ValueError("no frames")
    if any(len(f) != length for f, (_, length) in zip(frames, places, strict=True)):
        raise ValueError("truncated file")
    return frames, step


def _codes(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    table, code, k = {}, 0, 0
    for length, n in enumerate(lengths, 1):
        for _ in range(n):
            table[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


class _Bits:
    """The bits of a restart interval, and Huffman codes read from them."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, len(data) * 8

    def take(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        self.at += n
        if self.at > self.end:
            raise ValueError("truncated scan")
        return int.from_bytes(self.data[first:last], "big") >> (last * 8 - self.at) & ((1 << n) - 1)

    def symbol(self, table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("unknown code")

    def signed(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v if n == 0 or v >> (n - 1) else v - (1 << n) + 1

    def block(self, dc: dict, ac: dict, before: int) -> list[int]:
        """64 coefficients in zigzag order; before: the last DC value of the component."""
        out = [0] * 64
        size = self.symbol(dc)
        if size > MOST_DC:
            raise ValueError("bad size class")
        out[0] = before + self.signed(size)
        k = 1
        while k < 64:
            s = self.symbol(ac)
            if s == 0:
                break
            k += s >> 4
            if s & 15:
                if s & 15 > MOST_AC:
                    raise ValueError("bad size class")
                if k > 63:
                    raise ValueError("too many coefficients")
                out[k] = self.signed(s & 15)
            k += 1
        return out


#: Size classes of baseline coefficients, at most (fixed values).
MOST_DC, MOST_AC = 11, 10
#: Blocks of a picture that is read, at most (67 million pixels).
LARGEST = 1 << 20


@dataclass
class Picture:
    """The first component (luminance) of a baseline JPEG."""

    blocks: np.ndarray  # [blocks, 64] coefficients in zigzag order, row by row of the picture, padding included
    quant: np.ndarray  # [64]
    size: tuple[int, int]  # (width, height) in pixels
    across: int  # blocks in a row


def _segments(jpeg: bytes) -> dict:
    """Quantisation and Huffman tables, components, restart interval, and where the scan starts."""
    found = {"quant": {}, "huffman": {}, "every": 0}
    at = 2
    while True:
        while at + 1 < len(jpeg) and jpeg[at] == 0xFF and jpeg[at + 1] == 0xFF:
            at += 1  # fill bytes
        if at + 4 > len(jpeg) or jpeg[at] != 0xFF:
            raise ValueError("no scan")
        marker, length = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + length]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                found["quant"][body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(float)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                found["huffman"][body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            _, height, width, n = struct.unpack_from(">BHHB", body)
            found["size"] = (width, height)
            found["parts"] = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDD:
            found["every"] = struct.unpack(">H", body[:2])[0]
        at += 2 + length
        if marker == 0xDA:
            found["scan"] = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            return found | {"at": at}


def _intervals(jpeg: bytes, at: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a scan without stuffing, and the length of each restart interval."""
    end = jpeg.rfind(b"\xff\xd9")
    scan = np.frombuffer(jpeg, np.uint8, (end if end >= at else len(jpeg)) - at, at)
    after = np.append(scan[1:], 0xD9)
    mark = scan == 0xFF
    cut = mark & (after >= 0xD0) & (after <= 0xD7)
    keep = ~cut
    keep[1:] &= ~(mark[:-1] & (after[:-1] == 0)) & ~cut[:-1]
    part = np.cumsum(cut)[keep]
    return scan[keep], np.bincount(part, minlength=int(cut.sum()) + 1)


def _plain(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of our own codes, one an interval, unpacked at once, and which intervals are of that kind."""
    part = np.repeat(np.arange(len(lengths)), lengths)
    out, whole = np.zeros((len(lengths), 64), np.int32), lengths == 72
    if whole.any():
        bits = np.unpackbits(data[whole[part]]).reshape(-1, 64, 9)
        fits = ~bits[:, :, 0].any(1)
        whole[np.flatnonzero(whole)[~fits]] = False
        v = np.packbits(bits[fits, :, 1:], axis=2)[:, :, 0].astype(np.int32)
        out[whole] = np.where(v >= 128, v, v - 255)
    empty = lengths == 1
    empty[empty] = data[np.cumsum(lengths)[empty] - 1] == _EMPTY
    return out, whole | empty


def decode_frame(jpeg) -> Picture:
    """The luminance of a baseline JPEG: any tables, components and sampling, with or without restart intervals."""
    jpeg = bytes(jpeg)
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    head = _segments(jpeg)
    if "parts" not in head:
        raise ValueError("no size")
    (width, height), parts, scan = head["size"], head["parts"], head["scan"]
    if any(name not in parts for name, _, _ in scan) or not width or not height or any(not h or not v for h, v, _ in parts.values()):
        raise ValueError("bad components")
    if any(key not in head["huffman"] for _, dc, ac in scan for key in (dc, 16 + ac)):
        raise ValueError("no Huffman table")
    across_most, down_most = max(h for h, _, _ in parts.values()), max(v for _, v, _ in parts.values())
    lead = scan[0][0]
    h0, v0, table = parts[lead]
    if len(scan) == 1:  # blocks of one component stand row by row
        sampling = [(1, 1)]
        wide, tall = -(-(-(-width * h0 // across_most)) // 8), -(-(-(-height * v0 // down_most)) // 8)
    else:
        sampling = [parts[name][:2] for name, _, _ in scan]
        wide, tall = -(-width // (8 * across_most)), -(-height // (8 * down_most))
    quant = head["quant"].get(table)
    if quant is None or len(quant) != 64:
        raise ValueError("no quantisation table")
    units, every = wide * tall, head["every"] or wide * tall
    data, lengths = _intervals(jpeg, head["at"])
    if len(lengths) < -(-units // every):
        raise ValueError("truncated scan")
    lengths = lengths[: -(-units // every)]
    ends = np.cumsum(lengths)
    h, v = sampling[0]
    if units * h * v > LARGEST:
        raise ValueError("picture too large")
    if units * sum(a * d for a, d in sampling) > 4 * len(data):  # a block takes two bits or more
        raise ValueError("truncated scan")
    out = np.zeros((tall * v, wide * h, 64), np.int32)
    done = np.zeros(len(lengths), bool)
    own = (_LENGTHS, b"\x08\x00")
    if len(scan) == 1 and every == 1 and all(head["huffman"][k] == own for k in (scan[0][1], 16 + scan[0][2])):
        plain, done = _plain(data[: ends[-1]], lengths)
        out = plain.reshape(tall, wide, 64)
    if not done.all():
        codes = [(_codes(*head["huffman"][dc]), _codes(*head["huffman"][16 + ac])) for _, dc, ac in scan]
        for i in np.flatnonzero(~done).tolist():
            bits, before = _Bits(data[ends[i] - lengths[i] : ends[i]].tobytes()), [0] * len(scan)
            for unit in range(i * every, min(units, (i + 1) * every)):
                for c, ((dc, ac), (across, down)) in enumerate(zip(codes, sampling, strict=True)):
                    for j in range(across * down):
                        block = bits.block(dc, ac, before[c])
                        before[c] = block[0]
                        if c == 0:
                            out[unit // wide * down + j // across, unit % wide * across + j % across] = block
    return Picture(out.reshape(-1, 64), quant, (width, height), out.shape[1])


def payload_of(coefficients: np.ndarray) -> bytes:
    """The bytes of the blocks that hold some: all coefficients of size class 8."""
    size = np.abs(coefficients)
    full = coefficients[((size >= 128) & (size <= 255)).all(1)]
    return np.where(full > 0, full, full + 255).astype(np.uint8).tobytes()


def histogram(picture: Picture) -> np.ndarray:
    """Shares of grey levels over the pixels of the blocks that aren't empty (of all, if all are)."""
    some = picture.blocks.any(1)
    full = picture.blocks[some] if some.any() else picture.blocks
    pixels = np.clip(np.rint((full * picture.quant).astype(np.float32) @ _INVERSE) + 128, 0, 255).astype(np.int64)
    return np.bincount(pixels.reshape(-1) * BINS >> 8, minlength=BINS) / max(1, pixels.size)


def shots(histograms: np.ndarray) -> list[int]:
    """First frames of shots; frame 0 is one.

    A difference is held against the median of its neighbours, and three deviations by their median deviation from it; it isn't one of
    them itself, so cuts near an end, in short files and close to another cut count. Without neighbours both are 0.
    """
    d = np.abs(np.diff(histograms, axis=0)).sum(1) / 2
    first = [0]
    for i, x in enumerate(d):
        near = np.delete(d[max(0, i - AROUND) : i + AROUND + 1], i - max(0, i - AROUND))
        middle = np.median(near) if len(near) > 1 else 0.0  # one neighbour alone may be a cut as well
        spread = DEVIATION * np.median(np.abs(near - middle)) if len(near) > 1 else 0.0
        if x > middle + 3 * spread + LEAST:
            first.append(i + 1)
    return first


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the AVI file of each text."""

    def run(batches):
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                raw = (text.as_py() or "").encode()
                media = encode(raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64)))
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.int64()), pa.array([len(raw)], pa.int64()), pa.array([media], pa.binary())], ["doc_id", "n_bytes", "media"])

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


CLIP = pa.struct([("start", pa.float64()), ("end", pa.float64()), ("level", pa.float64())])
READ = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("clips", pa.list_(CLIP)), ("problem", pa.string())]


def _read(media: bytes | None) -> tuple:
    if media is None:
        return (*[None] * 7, "no media")
    of_file = len(media), hashlib.sha256(media).hexdigest()
    try:
        frames, step = read_frames(media)
        digest, tail, size, grey = hashlib.sha256(), b"", 0, []
        for frame in frames:
            picture = decode_frame(frame)
            part = payload_of(picture.blocks)
            digest.update(part)
            tail, size = (tail + part)[-64:], size + len(part)
            grey.append(histogram(picture))
    except Exception as e:  # whatever one file does wrong, its row says so and the others are read
        return (None, None, None, *of_file, None, None, str(e) or "broken file")
    grey = np.array(grey)
    first = shots(grey)
    level = grey @ (np.arange(BINS) + 0.5) * (256 / BINS)
    clips = [{"start": a * step, "end": b * step, "level": round(float(level[a:b].mean()), 3)} for a, b in zip(first, [*first[1:], len(frames)], strict=True)]
    feature = f"frames={len(frames)};shots={','.join(map(str, first))};grey={','.join(str(int(x)) for x in np.rint(grey.mean(0) * 1000))}"
    return size, digest.hexdigest(), zlib.crc32(tail), *of_file, feature, clips, None


def read(stored_media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, what the stored files hold, a feature, the clips (seconds and mean grey level) and what is wrong with each file.

    n_bytes is null where the table hasn't got it. A null or broken file has a problem, and null in what can't be told of it.
    """

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                columns = zip(*[_read(media.as_py()) for media in part.column("media")], strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *[pa.array(c, t) for c, (_, t) in zip(columns, READ, strict=True)]], ["doc_id", "n_bytes", *[name for name, _ in READ]])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<start:double,end:double,level:double>>, problem string"
    n_bytes = F.col("n_bytes") if "n_bytes" in stored_media.columns else F.lit(None)
    return stored_media.select(F.col("doc_id").cast("long"), n_bytes.cast("long").alias("n_bytes"), "media").mapInArrow(run, schema)


def clips(media: DataFrame) -> DataFrame:
    """(doc_id, clip, start, end, level): one row for each shot."""
    return read(media).select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.start", "c.end", "c.level")
