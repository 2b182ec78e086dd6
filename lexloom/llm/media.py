"""Media columns: AVI files of motion JPEG as binary columns.

A payload becomes grey 32x32 frames, or one smaller frame if it is shorter. Each 8x8 block holds 64 payload bytes as its quantised coefficients, the unit in
which JPEG is lossless: byte b is the magnitude 256 + b, which always has size category 9. With the one-bit code for
that category every coefficient takes ten bits, so a block is 80 bytes of entropy-coded data and arrays of frames are
packed and unpacked without a loop over symbols. The DC coefficients carry their byte as differences of alternating
sign, which keeps them in range. Every AVI reader can walk the files: RIFF headers, a movi list and an idx1 index.

Files of other programs are read too: baseline JPEG with the tables that a frame brings (or, where it has none, the
standard Huffman tables), any sampling, restart intervals. Frames of equal tables are decoded in step, one symbol of each
at a time. Shots come from histograms of the decoded pixels; the inverse DCT is exact in integers, so equal files have
equal shots wherever they are decoded.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, BLOCKS, SIDE, FPS = 64, 16, 32, 25  # bytes in a block, blocks and pixels a side in a frame, frames a second


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_CODE = bytes([1] + [0] * 15 + [9])  # a Huffman table of one code of one bit, for size category 9
_TABLES = _segment(0xDB, bytes([0] + [1] * 64)) + _segment(0xC4, b"\x00" + _CODE) + _segment(0xC4, b"\x10" + _CODE)
_SCAN = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def pack_blocks(payload: np.ndarray) -> np.ndarray:
    """Entropy-coded bytes, 80 for each 64."""
    c = payload.reshape(-1, BLOCK).astype(np.uint16) | 256  # bits 0 1bbbbbbbb
    c[1::2, 0] = 511 - c[1::2, 0]  # a negative difference: the complement, bits 0 0xxxxxxxx
    a, b, d, e = c[:, 0::4], c[:, 1::4], c[:, 2::4], c[:, 3::4]
    out = np.empty((len(c), BLOCK // 4, 5), np.uint8)
    out[:, :, 0] = a >> 2
    out[:, :, 1] = (a & 3) << 6 | b >> 4
    out[:, :, 2] = (b & 15) << 4 | d >> 6
    out[:, :, 3] = (d & 63) << 2 | e >> 8
    out[:, :, 4] = e & 255
    return out.reshape(-1)


def unpack_blocks(coded: np.ndarray) -> np.ndarray:
    """Magnitudes (256 + byte) of the coefficients, blocks x 64."""
    x = coded.reshape(-1, BLOCK // 4, 5).astype(np.uint16)
    c = np.empty((len(x), BLOCK // 4, 4), np.uint16)
    c[:, :, 0] = x[:, :, 0] << 2 | x[:, :, 1] >> 6
    c[:, :, 1] = (x[:, :, 1] & 63) << 4 | x[:, :, 2] >> 4
    c[:, :, 2] = (x[:, :, 2] & 15) << 6 | x[:, :, 3] >> 2
    c[:, :, 3] = (x[:, :, 3] & 3) << 8 | x[:, :, 4]
    c = c.reshape(-1, BLOCK)
    c[1::2, 0] = 511 - c[1::2, 0]
    if ((c >> 8) != 1).any():
        raise ValueError("not a coefficient of size category 9")
    return c


def pad(payload: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return payload.ljust(max(BLOCK, -(-len(payload) // BLOCK) * BLOCK), b"\0")


def encode_avi(payload: bytes) -> bytes:
    """The AVI file of a payload whose length is a positive multiple of 64. A comment in each frame tells how many bytes
    of it are payload; blocks beyond are zero."""
    blocks = min(BLOCKS, len(payload) // BLOCK)
    width, height, size = SIDE if blocks == BLOCKS else 8, SIDE if blocks == BLOCKS else 8 * blocks, blocks * BLOCK
    n = -(-len(payload) // size)
    coded = pack_blocks(np.frombuffer(payload.ljust(n * size, b"\0"), np.uint8)).reshape(n, -1)
    head = b"\xff\xd8" + _TABLES + _segment(0xC0, struct.pack(">BHHB3B", 8, height, width, 1, 1, 0x11, 0))
    movi, index, at = [], [], 4
    for k in range(n):
        used = min(size, len(payload) - k * size)
        frame = head + _segment(0xFE, struct.pack(">I", used)) + _SCAN + coded[k].tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
        chunk = b"00dc" + struct.pack("<I", len(frame)) + frame + b"\0" * (len(frame) & 1)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(frame)))
        movi.append(chunk)
        at += len(chunk)
    largest = max(map(len, movi))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl)
    return chunk(b"RIFF", b"AVI " + hdrl + chunk(b"LIST", b"movi" + b"".join(movi)) + chunk(b"idx1", b"".join(index)))


def frames(avi: bytes) -> list[bytes]:
    """The images of the first video stream, in the order of the idx1 index; without an index, in file order."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index = 12, None, None
    while at + 8 <= len(avi):
        name, n = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        if name == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movi = (at + 8, at + 8 + n)
        elif name == b"idx1":
            index = avi[at + 8 : at + 8 + n]
        if at + 8 + n > len(avi):
            raise ValueError("the file is cut")
        at += 8 + n + (n & 1)
    if movi is None:
        return []
    out, stream = [], None
    if index is not None:
        for k in range(0, len(index) - 15, 16):
            name, (offset, n) = index[k : k + 4], struct.unpack_from("<II", index, k + 8)
            if name[2:] in (b"dc", b"db") and name == (stream := stream or name):
                start = next((x for x in (movi[0] + offset, offset) if avi[x : x + 4] == name), None)  # some count from the file's begin
                if start is None or struct.unpack_from("<I", avi, start + 4)[0] != n:
                    raise ValueError("the index does not fit the file")
                out.append(avi[start + 8 : start + 8 + n])
        return out
    at = movi[0] + 4
    while at + 8 <= movi[1]:
        name, n = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        if name == b"LIST":  # a group of chunks
            at += 12
            continue
        if name[2:] in (b"dc", b"db") and name == (stream := stream or name):
            out.append(avi[at + 8 : at + 8 + n])
        at += 8 + n + (n & 1)
    return out


def frame_rate(avi: bytes) -> float:
    """Frames a second by the main header; FPS where it has none."""
    at = avi.find(b"avih", 12, 1 << 12)
    micros = struct.unpack_from("<I", avi, at + 8)[0] if 0 < at < len(avi) - 12 else 0
    return 1_000_000 / micros if micros else float(FPS)


_SYMBOLS = [r << 4 | s for r in range(16) for s in range(1, 11)]


def _ascending(first: str) -> bytes:
    """Symbols of a standard table: those given, then the rest in ascending order."""
    given = bytes.fromhex(first)
    return given + bytes(sorted({*_SYMBOLS, 0x00, 0xF0} - set(given)))


# The standard Huffman tables, as how many codes there are of each length and their symbols.
STANDARD = {
    (0, 0): (bytes.fromhex("00010501010101010100000000000000"), bytes(range(12))),
    (0, 1): (bytes.fromhex("00030101010101010101010000000000"), bytes(range(12))),
    (1, 0): (bytes.fromhex("0002010303020403050504040000017d"), _ascending("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a")),
    (1, 1): (bytes.fromhex("00020102040403040705040400010277"), _ascending("0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a")),
}

_ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_SCALE = 12  # bits of the inverse DCT's factors


def _inverse_dct() -> np.ndarray:
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1.0) / 2
    return np.round(np.kron(c, c).T * (1 << _SCALE))


_DCT = _inverse_dct()  # whole numbers: in double precision every product and sum is exact


def pixels(coefficients: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """Samples (blocks x 64, rows of eight) of quantised coefficients in zigzag order."""
    natural = np.zeros(coefficients.shape, np.float64)
    natural[:, _ZIGZAG] = coefficients * quantiser
    level = (natural @ _DCT + float((128 << _SCALE) + (1 << (_SCALE - 1)))) // float(1 << _SCALE)
    return np.clip(level, 0, 255).astype(np.uint8)


def _lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For every 16 bits the length of the code they begin with (0: none) and its symbol."""
    length, symbol, code, k = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8), 0, 0
    for n, many in enumerate(counts, 1):
        for _ in range(many):
            at = slice(code << (16 - n), (code + 1) << (16 - n))
            length[at], symbol[at] = n, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


class Image:
    """A baseline JPEG image's headers and the entropy-coded data of its restart intervals."""

    def __init__(self, jpeg: bytes):
        if jpeg[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG image")
        self.quantisers, self.huffman, self.components, self.interval = {}, dict(STANDARD), [], 0
        at = 2
        while True:
            while jpeg[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 4 > len(jpeg) or jpeg[at] != 0xFF:
                raise ValueError("the image is cut")
            marker, n = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
            body = jpeg[at + 4 : at + 2 + n]
            if len(body) != n - 2:
                raise ValueError("the image is cut")
            at += 2 + n
            if marker == 0xDB:
                while body:
                    wide, k = body[0] >> 4, body[0] & 15
                    self.quantisers[k] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                    body = body[65 + 64 * bool(wide) :]
            elif marker == 0xC4:
                while body:
                    many = sum(body[1:17])
                    self.huffman[body[0] >> 4, body[0] & 15] = (body[1:17], body[17 : 17 + many])
                    body = body[17 + many :]
            elif marker in (0xC0, 0xC1):
                self.height, self.width, n = struct.unpack_from(">HHB", body, 1)
                self.components = [(c[0], c[1] >> 4, c[1] & 15, c[2]) for c in (body[6 + 3 * k : 9 + 3 * k] for k in range(n))]
                if body[0] != 8 or not self.width or not self.height:
                    raise ValueError("samples of other than eight bits, or no size")
            elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
                raise ValueError("not a baseline image")
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body[:2])[0]
            elif marker == 0xDA:
                self.tables = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
                break
        if not self.components or set(self.tables) != {c[0] for c in self.components}:
            raise ValueError("not one scan of all components")
        if len(self.components) == 1:
            self.components = [(*self.components[0][:1], 1, 1, self.components[0][3])]
        self.wide, self.high = max(c[1] for c in self.components), max(c[2] for c in self.components)
        self.across, self.down = -(-self.width // (8 * self.wide)), -(-self.height // (8 * self.high))
        end = jpeg.rfind(b"\xff\xd9")
        data = jpeg[at : end if end >= at else len(jpeg)]
        parts, begin, k = [], 0, data.find(b"\xff")
        while self.interval and k >= 0:
            if k + 1 < len(data) and 0xD0 <= data[k + 1] <= 0xD7:
                parts.append(data[begin:k])
                begin = k + 2
            k = data.find(b"\xff", k + 2)
        self.parts = [x.replace(b"\xff\x00", b"\xff") for x in (*parts, data[begin:])]

    def pattern(self) -> list[int]:
        """The component of each block of an MCU."""
        return [k for k, c in enumerate(self.components) for _ in range(c[1] * c[2])]

    def kind(self) -> tuple:
        """Images of one kind are decoded together."""
        return (self.width, self.height, self.interval, tuple(self.components), tuple(sorted(self.tables.items())), tuple(sorted(self.huffman.items())), tuple((k, v.tobytes()) for k, v in sorted(self.quantisers.items())))


def coefficients(images: list[Image]) -> np.ndarray:
    """Quantised coefficients in zigzag order (images x MCUs x blocks x 64) of images of one kind. Every restart interval is
    a lane; in each step all lanes decode one symbol."""
    one, pattern = images[0], np.array(images[0].pattern())
    total = one.across * one.down
    each = one.interval or total
    lanes = [(i, k, x) for i, im in enumerate(images) for k, x in enumerate(im.parts)]
    if any(len(im.parts) != -(-total // each) for im in images):
        raise ValueError("restart intervals are missing")
    size = max(len(x) for _, _, x in lanes) + 8
    data = np.frombuffer(b"".join(x.ljust(size, b"\xff") for _, _, x in lanes), np.uint8).astype(np.int64)
    base, limit = np.arange(len(lanes)) * size, np.array([8 * len(x) for _, _, x in lanes])
    blocks = np.array([min(each, total - k * each) for _, k, _ in lanes]) * len(pattern)
    out = np.zeros((len(lanes), each * len(pattern), 64), np.int32)
    names = [c[0] for c in one.components]
    luts = [_lookup(*one.huffman[kind, one.tables[n][kind]]) for kind in (0, 1) for n in names]
    length, symbol = np.stack([x for x, _ in luts]), np.stack([x for _, x in luts])
    bit, block, k, last = (np.zeros(len(lanes), np.int64) for _ in range(4))
    last = np.zeros((len(lanes), len(names)), np.int64)
    live = np.flatnonzero(blocks > 0)

    def peek(lane: np.ndarray) -> np.ndarray:
        at = base[lane] + (bit[lane] >> 3)
        return (data[at] << 16 | data[at + 1] << 8 | data[at + 2]) >> (8 - (bit[lane] & 7)) & 0xFFFF

    while len(live):
        comp, first = pattern[block[live] % len(pattern)], k[live] == 0
        table, bits = np.where(first, comp, comp + len(names)), peek(live)
        n, sym = length[table, bits].astype(np.int64), symbol[table, bits].astype(np.int64)
        if (n == 0).any() or (bit[live] + n > limit[live]).any():
            raise ValueError("the image is damaged")
        bit[live] += n
        s, run = sym & 15, sym >> 4
        v = peek(live) >> (16 - s)
        v = np.where(s == 0, 0, np.where(v < 1 << np.maximum(s - 1, 0), v - (1 << s) + 1, v))
        bit[live] += s
        last[live, comp] += np.where(first, v, 0)
        to = np.where(first, 0, k[live] + run)
        end = ~first & (sym == 0)
        put = first | ~end & (s > 0)
        if (to[put] > 63).any():
            raise ValueError("the image is damaged")
        out[live[put], block[live[put]], to[put]] = np.where(first, last[live, comp], v)[put]
        k[live] = np.where(end, 64, to + 1)
        full = k[live] > 63
        block[live[full]] += 1
        k[live[full]] = 0
        live = live[block[live] < blocks[live]]
    if (bit > limit).any():
        raise ValueError("the image is cut")
    whole = np.zeros((len(images), -(-total // each) * each * len(pattern), 64), np.int32)
    for (i, j, _), x in zip(lanes, out, strict=True):
        whole[i, j * each * len(pattern) : (j + 1) * each * len(pattern)] = x
    return whole[:, : total * len(pattern)].reshape(len(images), total, len(pattern), 64)


def decode_images(jpegs: list[bytes]) -> list[np.ndarray]:
    """The first component's samples (height x width, grey or luma) of each image."""
    images = [Image(x) for x in jpegs]
    kinds: dict[tuple, list[int]] = {}
    for k, im in enumerate(images):
        kinds.setdefault(im.kind(), []).append(k)
    out: list = [None] * len(images)
    for group in kinds.values():
        for at in range(0, len(group), 64):
            some = group[at : at + 64]
            im = images[some[0]]
            _, h, v, q = im.components[0]
            if q not in im.quantisers:
                raise ValueError("no quantiser")
            c = coefficients([images[k] for k in some])[:, :, : h * v]
            p = pixels(c.reshape(-1, 64), im.quantisers[q]).reshape(len(some), im.down, im.across, v, h, 8, 8)
            plane = p.transpose(0, 1, 3, 5, 2, 4, 6).reshape(len(some), im.down * v * 8, im.across * h * 8)
            for k, x in zip(some, plane, strict=True):
                out[k] = x[: -(-im.height * v // im.high), : -(-im.width * h // im.wide)]
    return out


_OWN = b"\xff\xd8" + _TABLES


def _scan(jpeg: bytes) -> tuple[int, bytes]:
    """Payload bytes of an own frame and its entropy-coded data."""
    at = len(_OWN)
    at += 2 + struct.unpack_from(">H", jpeg, at + 2)[0]  # the frame header
    used = struct.unpack_from(">I", jpeg, at + 4)[0]
    at += 8 + len(_SCAN)
    return used, jpeg[at:-2].replace(b"\xff\x00", b"\xff")


def decode_avi(avi: bytes) -> tuple[bytes | None, np.ndarray]:
    """The payload (None in files of other programs), and the histogram of 32 levels of each frame's samples, as shares.

    Raises ValueError for a file that is no AVI, is cut or damaged, or holds other than baseline JPEG images.
    """
    images = frames(avi)
    if images and all(x.startswith(_OWN) for x in images):
        scans = [_scan(x) for x in images]
        c = unpack_blocks(np.frombuffer(b"".join(x for _, x in scans), np.uint8))
        bytes_ = (c & 255).astype(np.uint8).reshape(len(scans), -1)
        c = c.astype(np.int64).reshape(len(scans), -1, BLOCK)
        c[:, 1::2, 0] *= -1
        c[:, :, 0] = np.cumsum(c[:, :, 0], axis=1)
        samples = np.concatenate([pixels(x.reshape(-1, BLOCK), np.int64(1)) for x in np.array_split(c, -(-len(c) // 64))]).reshape(len(scans), -1)
        return b"".join(bytes_[k, :n].tobytes() for k, (n, _) in enumerate(scans)), histograms([*samples])
    return None, histograms(decode_images(images))


def histograms(images: list[np.ndarray]) -> np.ndarray:
    return np.array([np.bincount(x.ravel() >> 3, minlength=32) / x.size for x in images]).reshape(len(images), 32)


def shots(hist: np.ndarray, window: int = 8, factor: float = 3.0, floor: float = 0.05) -> list[tuple[int, int]]:
    """First and last frame of each shot, from the frames' histograms.

    The difference of two frames is half the L1 distance of their histograms. A cut is where it exceeds the mean plus factor
    deviations of the differences before it in the shot, of window at most, and floor.
    """
    n = len(hist)
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    out, start = [], 0
    for k in range(1, n):
        past = diff[max(start, k - 1 - window) : k - 1]
        bound = max(floor, past.mean() + factor * past.std()) if len(past) >= 2 else max(floor, 0.5)
        if diff[k - 1] > bound:
            out.append((start, k - 1))
            start = k
    return [*out, (start, n - 1)] if n else out


def _to_avi(texts: pa.Array) -> pa.Array:
    return pa.array([encode_avi(pad((x or "").encode())) for x in texts.to_pylist()], pa.binary())


READ = "struct<payload:binary,clips:array<struct<clip:int,first_frame:int,last_frame:int,start_s:double,end_s:double,level:double>>,problem:string>"


def _from_avi(media: pa.Array) -> pa.Array:
    payloads, clips, problems = [], [], []
    for x in media:
        payload, hist, rate, problem = None, np.zeros((0, 32)), float(FPS), None
        if x.is_valid:
            raw = x.as_buffer().to_pybytes()
            try:
                payload, hist = decode_avi(raw)
                rate = frame_rate(raw)
            except (ValueError, IndexError, KeyError, struct.error) as e:
                problem = str(e) or type(e).__name__
        payloads.append(payload)
        problems.append(problem)
        level = hist @ (np.arange(32) * 8 + 4.0)
        clips.append([
            {"clip": k, "first_frame": a, "last_frame": b, "start_s": a / rate, "end_s": (b + 1) / rate, "level": round(float(level[a : b + 1].mean()), 3)}
            for k, (a, b) in enumerate(shots(hist))
        ])
    kind = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("level", pa.float64())]))
    return pa.StructArray.from_arrays([pa.array(payloads, pa.binary()), pa.array(clips, kind), pa.array(problems, pa.string())], ["payload", "clips", "problem"])


def to_media(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """df with the AVI file of every whole text, UTF-8 padded by bytes 0 to a positive multiple of 64.

    Null and empty texts give one block of zeros. Equal texts give equal files. A column that already has the name of
    media_col is replaced; all others stay.
    """
    return df.withColumn(media_col, F.arrow_udf(_to_avi, "binary")(F.col(text_col)))


def read_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with payload (the bytes stored; null in files that to_media() didn't write), clips (the shots found in the decoded
    frames) and problem (null, or why the file can't be read), replacing such columns.

    A null cell has a null payload, no clips and no problem. A file that is cut, damaged or no motion JPEG has a null payload,
    no clips and a problem; the other rows are read all the same.
    """
    read = F.col("media read")
    out = df.withColumn("media read", F.arrow_udf(_from_avi, READ)(F.col(media_col)))
    return out.withColumns({x: read[x] for x in ("payload", "clips", "problem")}).drop("media read")


def clips(df: DataFrame, media_col: str = "media") -> DataFrame:
    """One row for each shot: df's columns but the media, with clip, first_frame, last_frame, start_s, end_s, level. Files
    that are null or can't be read have none."""
    rows = read_media(df, media_col).drop("payload", "problem", media_col)
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in ("clips", "clip", "first_frame", "last_frame", "start_s", "end_s", "level")]
    return rows.select(*rest, F.inline("clips"))
