"""Media columns: AVI files with motion-JPEG frames, read through their RIFF index, and shots within them.

What is written: a sample is an 8 x 8 block of one grey value, so that a frame of 16 x 12 blocks (128 x 96 pixels) carries 192 samples
without loss in baseline JPEG: the quantiser of the DC term is 8, which makes the term the grey value less 128, and all AC
terms are zero. Any decoder shows the same values. Frames are intra coded: each has its own tables and DC prediction.

What is read: any AVI file with baseline motion-JPEG frames, of other writers too. ``read_avi`` walks the RIFF chunks and
takes the frames' places from ``idx1``, or from the chunks themselves where there is none. Frames are decoded after their
own tables (DQT, DHT or the standard's, SOF, SOS, DRI), all terms of all components, frames with equal headers in step.
Progressive and arithmetic coding, and other codecs than motion-JPEG, raise ValueError. ``shots`` compares the grey histograms of neighbouring frames: a cut lies where
the difference exceeds the mean of the last differences by DEVIATIONS of their standard deviations and a least difference.

Cases: a null or empty text gives one frame of spaces; the last frame is filled up with spaces and ``n_bytes`` says where
the text ends; a text whose file would pass the 4 GB of a RIFF size (from about 1.2 GB on) raises ValueError; broken files
raise ValueError; equal texts give equal files, repeated rows and ids one row each; null ids stay null; empty tables give
no rows; other columns of the input are ignored, whatever their names. A task holds BLOCK frames and OUT bytes of files."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

UNIT, COLUMNS, ROWS, FPS = 192, 16, 12, 25
#: Histogram bins, past differences that a cut is held against, standard deviations, least difference for a cut.
BINS, PAST, DEVIATIONS, LEAST = 16, 8, 3.0, 0.30
#: Frames that are coded at once; bounds the memory of a worker.
BLOCK = 4096
#: Bytes of files in a batch of rows that goes out.
OUT = 16 << 20
#: Huffman codes: DC categories 0 to 8 have 4 bits each, the end of a block has one bit, 0.
_DC_BITS, _AC_END_BITS = 4, 1


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0, 8]) + bytes([1]) * 63)
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * ROWS, 8 * COLUMNS, 1, 1, 0x11, 0))
    + _segment(0xC4, bytes([0x00, 0, 0, 0, 9] + [0] * 12) + bytes(range(9)))
    + _segment(0xC4, bytes([0x10, 1] + [0] * 15) + bytes([0]))
    + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)
_END = b"\xff\xd9"


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of frames, given as rows of UNIT samples."""
    n = len(samples)
    value = samples.astype(np.int16) - 128
    diff = np.diff(value, axis=1, prepend=np.zeros((n, 1), np.int16)).astype(np.int64)
    category = np.zeros(diff.shape, np.int64)
    for k in range(8):
        category += np.abs(diff) >= 1 << k
    extra = np.where(diff < 0, diff + (1 << category) - 1, diff)
    width = _DC_BITS + category + _AC_END_BITS
    code = ((category << category) | extra) << _AC_END_BITS
    ends = np.cumsum(width, axis=1)
    size = (ends[:, -1] + 7) // 8
    longest = int(size.max()) if n else 0
    buffer = np.zeros((n, longest + 4), np.uint8)
    # a code has at most 13 bits and so touches at most three bytes; neighbours meet in the same byte, so they are added
    at = ends - width
    shifted = code << (24 - width - (at & 7))
    flat = (at >> 3) + np.arange(n)[:, None] * buffer.shape[1]
    total = np.zeros(buffer.size, np.int64)
    for k in range(3):
        total += np.bincount((flat + k).ravel(), weights=((shifted >> (16 - 8 * k)) & 255).ravel(), minlength=buffer.size).astype(np.int64)
    buffer = total.astype(np.uint8).reshape(buffer.shape)
    fill = (-ends[:, -1]) % 8  # the last byte is filled up with ones
    buffer[np.arange(n), size - 1] |= ((1 << fill) - 1).astype(np.uint8)
    return [_HEAD + row[:k].tobytes().replace(b"\xff", b"\xff\0") + _END for row, k in zip(buffer, size.tolist())]


# -- reading JPEG --

# fixed values: the order of coefficients, and the Huffman codes of the JPEG standard's annex K (counts by length, then
# symbols), which files of motion-JPEG may leave out
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
_DC_LUMA = "00010501010101010100000000000000 000102030405060708090a0b"
_DC_CHROMA = "00030101010101010101010000000000 000102030405060708090a0b"
_AC_LUMA = (
    "0002010303020403050504040000017d 01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738"
    "393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3"
    "c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
)
_AC_CHROMA = (
    "00020102040403040705040400010277 0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738"
    "393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2"
    "c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
)
# end of fixed values


def _codes(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits: the symbol whose code they begin with, and its length; length 0 if no code does."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code = at = 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            if at >= len(symbols) or code >= 1 << n:
                raise ValueError("broken Huffman table")
            low = code << (16 - n)
            symbol[low : low + (1 << (16 - n))] = symbols[at]
            length[low : low + (1 << (16 - n))] = n
            code, at = code + 1, at + 1
        code <<= 1
    return symbol, length


def _standard(said: str) -> tuple[np.ndarray, np.ndarray]:
    data = bytes.fromhex(said.replace(" ", ""))
    return _codes(data[:16], data[16:])


@dataclass
class Component:
    id: int
    across: int
    down: int
    quantiser: int
    dc: int = 0
    ac: int = 0


@dataclass
class Header:
    """What the segments of a baseline JPEG file before its scan say."""

    height: int
    width: int
    components: list[Component]
    quantisers: dict[int, np.ndarray]
    codes: dict[int, tuple[np.ndarray, np.ndarray]]
    restart: int


@lru_cache(maxsize=64)
def header(head: bytes) -> Header:
    """The header of a file, up to its scan's data: quantisers, Huffman codes, the frame and its one scan."""
    quantisers: dict[int, np.ndarray] = {}
    codes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    frame, restart, at = None, 0, 2
    if head[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while at + 4 <= len(head):
        if head[at] != 0xFF:
            raise ValueError("no marker where one is due")
        kind = head[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            k = 0
            while k < len(body):
                wide, slot = body[k] >> 4, body[k] & 15
                n = 128 if wide else 64
                values = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.int64)
                quantisers[slot] = values
                k += 1 + n
        elif kind == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                codes[body[k]] = _codes(body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                k += 17 + n
        elif kind in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not height or not width:
                raise ValueError("not a baseline frame of 8 bits")
            frame = (height, width, [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)])
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xDA:
            if frame is None or body[0] != len(frame[2]):
                raise ValueError("a scan without all components of a frame")
            tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            for c in frame[2]:
                c.dc, c.ac = tables[c.id] >> 4, 0x10 | (tables[c.id] & 15)
                if c.quantiser not in quantisers:
                    raise ValueError("a component without a quantiser")
            for slot, said in ((0, _DC_LUMA), (1, _DC_CHROMA), (0x10, _AC_LUMA), (0x11, _AC_CHROMA)):
                if slot not in codes:
                    codes[slot] = _standard(said)
            return Header(*frame, quantisers, codes, restart)
    raise ValueError("no scan")


def _split(file: bytes) -> tuple[bytes, bytes]:
    """A file's header, and its scan's data with stuffed bytes and what follows the end still in it."""
    at = 2
    while at + 4 <= len(file):
        if file[at] == 0xFF and file[at + 1] == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", file, at + 2)[0]
        if file[at + 1] == 0xDA:
            return file[: at + 2 + size], file[at + 2 + size :]
        at += 2 + size
    raise ValueError("no scan")


_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
_LAST = re.compile(rb"\xff(?![\x00\xd0-\xd7\xff])")


class _Bits:
    """The scans of files with one header, read in step."""

    def __init__(self, scans: list[bytes]):
        sizes = np.array([len(s) for s in scans], np.int64)
        self.at = 8 * (np.cumsum(sizes + 8) - sizes - 8)
        self.limit = self.at + 8 * sizes
        data = np.frombuffer(b"".join(s + b"\xff" * 8 for s in scans), np.uint8).astype(np.uint32)
        self.word = data.copy()  # at each byte, the 32 bits from there
        for k in (1, 2, 3):
            self.word <<= 8
            self.word[:-k] |= data[k:]

    def symbol(self, codes: tuple[np.ndarray, np.ndarray], who=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """The next symbol of each file, and the bits from there on that a value could have."""
        at = np.minimum(self.at[who], self.limit[who])
        bits = (self.word[at >> 3].astype(np.int64) << (at & 7)) & 0xFFFFFFFF
        peek = bits >> 16
        length = codes[1][peek]
        if not length.all():
            raise ValueError("broken scan data")
        self.at[who] += length
        return codes[0][peek], length

    def value(self, size: np.ndarray, who=slice(None)) -> np.ndarray:
        """The next signed value of ``size`` bits of each file."""
        at = np.minimum(self.at[who], self.limit[who])
        bits = (self.word[at >> 3].astype(np.int64) << (at & 7)) & 0xFFFFFFFF
        extra = bits >> (32 - size)
        self.at[who] += size
        return np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)


def _scan(head: Header, scans: list[bytes], blocks: list[list[np.ndarray]], first: int, count: int) -> None:
    """Decodes ``count`` units of files' scans into ``blocks``: for each component arrays (unit, block of the unit,
    coefficient or, where no block has other terms, the first alone, file)."""
    bits, before = _Bits(scans), [np.zeros(len(scans), np.int64) for _ in head.components]
    for unit in range(first, first + count):
        for k, c in enumerate(head.components):
            across, down = (c.across, c.down) if len(head.components) > 1 else (1, 1)
            for _ in range(across * down):
                size, _n = bits.symbol(head.codes[c.dc])
                before[k] = before[k] + bits.value(size)
                terms: list[tuple] = []
                left = np.ones(len(scans), bool)
                place = np.zeros(len(scans), np.int64)
                while True:
                    who = np.flatnonzero(left) if terms or not left.all() else slice(None)
                    symbol, _n = bits.symbol(head.codes[c.ac], who)
                    if not symbol.any():
                        break
                    who = np.arange(len(scans))[who]
                    done = symbol == 0
                    left[who[done]] = False
                    who, symbol = who[~done], symbol[~done]
                    run, size = symbol >> 4, symbol & 15
                    place[who] += run + 1
                    if (place[who] > 63).any():
                        raise ValueError("broken scan data")
                    real = size > 0
                    terms.append((who[real], place[who[real]], bits.value(size[real], who[real])))
                    left[who[place[who] == 63]] = False
                    if not left.any():
                        break
                blocks[k].append((before[k], terms))
    if (bits.at > bits.limit).any():
        raise ValueError("broken scan data")


def _decoded(files: list[bytes]) -> Iterator[tuple[list[int], Header, list[list[tuple]]]]:
    """Files with equal headers together: their places, the header, and for each component the blocks in scan order."""
    groups: dict[bytes, tuple[list[int], list[bytes]]] = {}
    for i, f in enumerate(files):
        head, data = _split(f)
        end = _LAST.search(data)
        if end is None:
            raise ValueError("a file without an end")
        where, scans = groups.setdefault(head, ([], []))
        where.append(i)
        scans.append(data[: end.start()])
    for head, (where, scans) in groups.items():
        h = header(head)
        most_across, most_down = max(c.across for c in h.components), max(c.down for c in h.components)
        wide, high = (8, 8) if len(h.components) == 1 else (8 * most_across, 8 * most_down)
        units = -(-h.width // wide) * -(-h.height // high)
        step = h.restart or units
        parts = [_RESTART.split(s) for s in scans] if h.restart else [[s] for s in scans]
        if any(len(p) != -(-units // step) for p in parts):
            raise ValueError("broken scan data")
        blocks: list[list] = [[] for _ in h.components]
        for r, first in enumerate(range(0, units, step)):
            _scan(h, [p[r].replace(b"\xff\0", b"\xff") for p in parts], blocks, first, min(step, units - first))
        yield where, h, blocks


def _basis() -> np.ndarray:
    k, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    out = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    out[0] /= np.sqrt(2)
    return out


_COSINES = _basis()


def _grid(h: Header, c: Component) -> tuple[int, int, np.ndarray]:
    """Blocks across and down of a component, and the place of each of its blocks in scan order."""
    if len(h.components) == 1:
        across, down = -(-h.width // 8), -(-h.height // 8)
        return across, down, np.arange(across * down)
    most_across, most_down = max(x.across for x in h.components), max(x.down for x in h.components)
    units, rows = -(-h.width // (8 * most_across)), -(-h.height // (8 * most_down))
    across = units * c.across
    u, r, y, x = np.meshgrid(np.arange(units), np.arange(rows), np.arange(c.down), np.arange(c.across), indexing="ij")
    at = (r * c.down + y) * across + u * c.across + x  # [unit, row, y, x]
    return across, rows * c.down, at.transpose(1, 0, 2, 3).ravel()


def decode_frames(files: list[bytes]) -> np.ndarray:
    """The first component (grey) of frames at one value for each block of 8 x 8: its mean, which is the block itself in
    the frames that this module writes. A row each; all frames have one size, others raise ValueError."""
    out = None
    for where, h, blocks in _decoded(files):
        across, down, at = _grid(h, h.components[0])
        if out is None:
            out = np.empty((len(files), across * down), np.uint8)
        if out.shape[1] != across * down:
            raise ValueError("frames of different sizes")
        q = int(h.quantisers[h.components[0].quantiser][0])
        dc = np.stack([b[0] for b in blocks[0]])
        grey = np.empty(dc.shape, np.int64)
        grey[at] = np.floor_divide(dc * q + 4, 8) + 128
        if (grey.min() < 0 or grey.max() > 255) and not any(terms for _, terms in blocks[0]):
            raise ValueError("broken scan data")  # a block of one value has none beyond a sample's
        out[where] = np.clip(grey, 0, 255).T
    return np.empty((0, UNIT), np.uint8) if out is None else out


def decode_pictures(files: list[bytes]) -> list[np.ndarray]:
    """Whole pictures of baseline JPEG files: arrays (component, height, width) of samples as stored, components with
    fewer samples spread out by repeating them."""
    out: list = [None] * len(files)
    for where, h, blocks in _decoded(files):
        most_across, most_down = max(c.across for c in h.components), max(c.down for c in h.components)
        planes = [[] for _ in where]
        for c, found in zip(h.components, blocks):
            across, down, at = _grid(h, c)
            q = h.quantisers[c.quantiser]
            for f in range(len(where)):
                coefficients = np.zeros((across * down, 64))
                for k, (dc, terms) in enumerate(found):
                    row = coefficients[at[k]]
                    row[0] = dc[f] * q[0]
                    for who, place, value in terms:
                        for n in np.flatnonzero(who == f):
                            row[ZIGZAG[place[n]]] = value[n] * q[place[n]]
                block = _COSINES.T @ coefficients.reshape(-1, 8, 8) @ _COSINES
                plane = block.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * down, 8 * across)
                plane = np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8)
                if len(h.components) > 1:
                    plane = plane.repeat(most_down // c.down, 0).repeat(most_across // c.across, 1)
                planes[f].append(plane[: h.height, : h.width])
        for f, i in enumerate(where):
            out[i] = np.stack(planes[f])
    return out


# -- AVI --


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes]) -> bytes:
    """A file of RIFF chunks: headers, ``movi`` with the frames, ``idx1`` with their places."""
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, 8 * COLUMNS, 8 * ROWS, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, 8 * COLUMNS, 8 * ROWS)
    picture = struct.pack("<IiiHH4sIiiII", 40, 8 * COLUMNS, 8 * ROWS, 1, 8, b"MJPG", 64 * UNIT, 0, 0, 0, 0)
    head = b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(c)
        at += len(c)
    if at + 16 * len(index) + 4096 > 0xFFFFFFFF:
        raise ValueError("more frames than a RIFF file can hold")
    body = b"AVI " + _chunk(b"LIST", head) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, place of the body and size of each chunk between two places; a list's body begins with its own kind."""
    while at + 8 <= end:
        kind, size = struct.unpack_from("<4sI", data, at)
        if at + 8 + size > end:
            raise ValueError("the file is cut short")
        yield kind, at + 8, size
        at += 8 + size + (size & 1)


def _frames_of(data: bytes, at: int, end: int, stream: bytes) -> Iterator[tuple[int, int]]:
    """Place and size of a stream's frames, in the order of the file, within lists of records too."""
    for kind, body, size in _chunks(data, at, end):
        if kind == b"LIST" and data[body : body + 4] == b"rec ":
            yield from _frames_of(data, body + 4, body + size, stream)
        elif kind[:2] == stream and kind[2:] in (b"dc", b"db"):
            yield body, size


def read_avi(data: bytes) -> list[bytes]:
    """The frames of the first video stream: by the index ``idx1``, whose places count from the list of frames or from the
    file's begin, or, without one, by the chunks themselves, over all RIFF parts of a large file. Frames of no bytes,
    which say that a frame is dropped, repeat the one before."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    if len(data) < 8 + struct.unpack_from("<I", data, 4)[0]:
        raise ValueError("the file is cut short")
    parts, index, stream, number, handler = [], None, None, 0, None
    for kind, body, size in _chunks(data, 0, len(data)):
        if kind != b"RIFF":
            continue
        for k, b, n in _chunks(data, body + 4, body + size):
            if k == b"LIST" and data[b : b + 4] == b"movi":
                parts.append((b, b + n))
            elif k == b"LIST" and data[b : b + 4] == b"hdrl":
                for k2, b2, n2 in _chunks(data, b + 4, b + n):
                    if k2 == b"LIST" and data[b2 : b2 + 4] == b"strl":
                        for k3, b3, _ in _chunks(data, b2 + 4, b2 + n2):
                            if k3 == b"strh" and data[b3 : b3 + 4] == b"vids" and stream is None:
                                stream, handler = b"%02d" % number, data[b3 + 4 : b3 + 8]
                        number += 1
            elif k == b"idx1" and index is None:
                index = (b, n)
    if not parts or stream is None:
        raise ValueError("no frames")
    if handler.upper() not in (b"MJPG", b"\0\0\0\0"):
        raise ValueError("not motion-JPEG")
    places: list[tuple[int, int]] = []
    if index is not None and len(parts) == 1:
        entries = [(at, size) for kind, _, at, size in struct.iter_unpack("<4sIII", data[index[0] : index[0] + index[1] // 16 * 16]) if kind[:2] == stream and kind[2:] in (b"dc", b"db")]
        movi = parts[0][0]
        base = next((x for x in (movi, 0) if entries and data[x + entries[0][0] : x + entries[0][0] + 2] == stream), None)
        for at, size in entries:
            if base is None or data[base + at : base + at + 2] != stream or base + at + 8 + size > len(data) or struct.unpack_from("<I", data, base + at + 4)[0] != size:
                raise ValueError("the index points elsewhere")
            places.append((base + at + 8, size))
    else:
        for begin, end in parts:
            places += _frames_of(data, begin + 4, end, stream)
    out: list[bytes] = []
    for at, size in places:
        if size or out:
            out.append(data[at : at + size] if size else out[-1])
    return out


def rate_of(data: bytes) -> float:
    """Frames a second, by the header of the first video stream; 25 where it has none."""
    at = data.find(b"vids", 0, 1 << 16)
    scale, rate = struct.unpack_from("<II", data, at + 20) if at >= 0 else (0, 0)
    return rate / scale if scale and rate else float(FPS)


def shots(samples: np.ndarray) -> list[tuple[int, int]]:
    """First frame and end of each shot."""
    n = len(samples)
    if n < 2:
        return [(0, n)] if n else []
    bins = (samples >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    histogram = np.bincount(bins.ravel(), minlength=n * BINS).reshape(n, BINS)
    diff = np.abs(np.diff(histogram, axis=0)).sum(axis=1) / (2 * samples.shape[1])
    one, two = np.concatenate([[0], np.cumsum(diff)]), np.concatenate([[0], np.cumsum(diff**2)])
    k = np.arange(len(diff))
    low = np.maximum(0, k - PAST)
    count = np.maximum(1, k - low)
    mean = (one[k] - one[low]) / count
    spread = np.sqrt(np.maximum(0, (two[k] - two[low]) / count - mean**2))
    cuts = (np.flatnonzero((diff > LEAST) & (diff > mean + DEVIATIONS * spread)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, n]))


def payload(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8, filled up with spaces to a positive multiple of UNIT, and its own length."""
    raw = (text or "").encode()
    return raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw)), len(raw)


def stored(texts: Iterable[str | None]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """For each text its length in bytes, its AVI file, and the samples read back from that file."""
    todo: list[tuple[int, bytes]] = []

    def block() -> Iterator[tuple[int, bytes, np.ndarray]]:
        samples = np.frombuffer(b"".join(p for _, p in todo), np.uint8).reshape(-1, UNIT)
        counts = [len(p) // UNIT for _, p in todo]
        frames = [f for at in range(0, len(samples), BLOCK) for f in encode_frames(samples[at : at + BLOCK])]
        files, at = [], 0
        for k in counts:
            files.append(write_avi(frames[at : at + k]))
            at += k
        del frames
        back = [f for x in files for f in read_avi(x)]
        read = np.concatenate([decode_frames(back[at : at + BLOCK]) for at in range(0, len(back), BLOCK)])
        at = 0
        for (n, _), file, k in zip(todo, files, counts):
            yield n, file, read[at : at + k]
            at += k

    held = 0
    for text in texts:
        p, n = payload(text)
        todo.append((n, p))
        held += len(p)
        if held >= BLOCK * UNIT:
            yield from block()
            todo, held = [], 0
    if todo:
        yield from block()


def _media(batches: Iterator[pa.RecordBatch], row) -> Iterator[list]:
    """``row`` of each text and what is stored of it, in lists of about OUT bytes of files; texts come one by one."""
    for batch in batches:
        ids, rows, held = batch.column(0).to_pylist(), [], 0
        for i, found in zip(ids, stored(x.as_py() for x in batch.column(1))):
            rows.append(row(i, *found))
            held += len(found[1])
            if held >= OUT:
                yield rows
                rows, held = [], 0
        if rows:
            yield rows


def describe_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature: digests of the
    stored file and of what is read back from it. The feature lists the frames at which shots begin."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def row(doc_id, n, file, samples):
        p = samples.tobytes()
        said = f"frames={len(samples)};shots=" + ",".join(str(a) for a, _ in shots(samples))
        return doc_id, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(file), hashlib.sha256(file).hexdigest(), said

    def run(batches):
        for rows in _media(batches, row):
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], pa.schema(
                [(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in schema.split(", ")]))

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the AVI file)."""

    def run(batches):
        for rows in _media(batches, lambda i, n, file, _: (i, n, file)):
            i, n, files = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(n, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """doc_id, clip, start_s, end_s, n_frames: a row for each shot of the AVI files in column ``media``; a null file has
    none."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data is not None:
                    frames, fps = read_avi(data), rate_of(data)
                    samples = [decode_frames(frames[at : at + BLOCK]) for at in range(0, len(frames), BLOCK)]
                    rows += [(i, k, a / fps, b / fps, b - a) for k, (a, b) in enumerate(shots(np.concatenate(samples) if samples else np.empty((0, UNIT), np.uint8)))]
            c = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], ["doc_id", "clip", "start_s", "end_s", "n_frames"])

    return media.selectExpr("cast(doc_id as long) doc_id", "media").mapInArrow(run, "doc_id long, clip long, start_s double, end_s double, n_frames long")
