"""Pixels: baseline JPEG, PNG and BMP in numpy, white canvases, thumbnails.

Images are uint8 arrays (height, width, 3). JPEG is written with 4:2:0 sampling, tables of its own
rule, and one scan; it is read with any sampling, restart intervals, and tables from a prefix.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from functools import cache, lru_cache

import numpy as np

from slidemill.functions.bytes import FRAME_MARKERS, segments
from slidemill.operators.layout import CHROMINANCE, LUMINANCE

SOI, EOI = b"\xff\xd8", b"\xff\xd9"
#: Equal small pictures, such as blank tiles, are coded once a worker: bytes of a picture, and pictures kept.
MEMO_BYTES, MEMO_SIZE = 6144, 8192


@cache
def zigzag() -> np.ndarray:
    """Places in reading order of the coefficients in diagonal order."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


@cache
def transform() -> np.ndarray:
    """The orthonormal DCT of eight points."""
    k = np.arange(8)
    m = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) / 2
    m[0] /= np.sqrt(2)
    return m


def scaled_table(table: list[int], quality: int) -> np.ndarray:
    """A standard table at a quality of 1 to 100."""
    if not 1 <= quality <= 100:
        raise ValueError("quality must be 1 to 100")
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * scale + 50) // 100, 1, 255)


@cache
def _luminance_tables() -> np.ndarray:
    return np.stack([scaled_table(LUMINANCE, q) for q in range(1, 101)])


def estimate_quality(table: list[int]) -> int:
    """The quality whose scaled luminance table is nearest; the lower of equals."""
    return _nearest_quality(tuple(table))


@lru_cache(1024)
def _nearest_quality(table: tuple[int, ...]) -> int:
    return int(np.abs(_luminance_tables() - np.array(table)).sum(axis=1).argmin()) + 1


def code_lengths(weights: dict[int, float]) -> dict[int, int]:
    """Huffman code lengths; an unused symbol takes the code of ones, which JPEG forbids."""
    heap = [(w, i, (s,)) for i, (s, w) in enumerate(weights.items())] + [(0.0, -1, ())]
    heapq.heapify(heap)
    length = dict.fromkeys(weights, 0)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        n += 1
        heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
    return length


@cache
def code_table(ac: bool) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(segment body, code, length by symbol) of a rule: short differences and short runs are likelier."""
    if ac:
        weights = {0: 0.2, 0xF0: 2e-3} | {r << 4 | s: 0.4 * 2.0 ** -(s + 0.45 * r) + 3e-4 for r in range(16) for s in range(1, 11)}
    else:
        weights = {s: 2.0 ** -abs(s - 2) + 1e-3 for s in range(12)}
    length = code_lengths(weights)
    symbols = sorted(length, key=lambda s: (length[s], s))
    counts = [sum(v == k for v in length.values()) for k in range(1, 17)]
    if sum(counts) != len(symbols):
        raise AssertionError("a code is longer than 16 bits")
    codes, sizes, code, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in symbols:
        code <<= length[s] - last
        last = length[s]
        codes[s], sizes[s] = code, last
        code += 1
    return bytes(counts) + bytes(symbols), codes, sizes


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@cache
def tables_of(quality: int) -> bytes:
    """The quantisation and code tables of a quality."""
    z = zigzag()
    out = b"".join(segment(0xDB, bytes([i]) + scaled_table(t, quality)[z].astype(np.uint8).tobytes()) for i, t in enumerate((LUMINANCE, CHROMINANCE)))
    return out + segment(0xC4, b"\x00" + code_table(False)[0]) + segment(0xC4, b"\x10" + code_table(True)[0])


def to_ycbcr(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., c].astype(np.float64) for c in range(3))
    out = np.empty((*r.shape, 3))
    out[..., 0] = y = 0.299 * r + 0.587 * g + 0.114 * b
    out[..., 1], out[..., 2] = (b - y) / 1.772 + 128, (r - y) / 1.402 + 128
    return out


def to_rgb(ycc: np.ndarray) -> np.ndarray:
    y, cb, cr = (ycc[..., c] for c in range(3))
    out = np.empty(ycc.shape)
    out[..., 0] = r = y + 1.402 * (cr - 128)
    out[..., 2] = b = y + 1.772 * (cb - 128)
    out[..., 1] = (y - 0.299 * r - 0.114 * b) / 0.587
    return np.clip(np.rint(out, out=out), 0, 255, out=out).astype(np.uint8)


def _blocks(plane: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    return plane.reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2)


@cache
def _size_table() -> np.ndarray:
    return np.array([i.bit_length() for i in range(1 << 12)])


def _sizes(x: np.ndarray) -> np.ndarray:
    return _size_table()[np.abs(x)]


def _bits(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(x < 0, x + (1 << size) - 1, x)


@cache
def _divisors(quality: int) -> np.ndarray:
    """The quantisation of a unit's six blocks."""
    return np.stack([scaled_table(LUMINANCE, quality)] * 4 + [scaled_table(CHROMINANCE, quality)] * 2).astype(np.float64)


def jpeg_head(h: int, w: int, quality: int, interval: int = 0) -> bytes:
    """All that stands before the scan's data; with an ``interval`` of units a restart marker follows each so many."""
    if not 0 < h <= 65535 or not 0 < w <= 65535:
        raise ValueError("an edge is empty or over 65535")
    frame = segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
    return SOI + tables_of(quality) + frame + (segment(0xDD, struct.pack(">H", interval)) if interval else b"") + segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))


def units_of(ycc: np.ndarray, quality: int) -> np.ndarray:
    """Quantised coefficients in diagonal order: rows and columns of 4:2:0 units, six blocks each (four luma, two chroma)."""
    h, w = ycc.shape[:2]
    padded = (np.pad(ycc, ((0, -h % 16), (0, -w % 16), (0, 0)), mode="edge") if h % 16 or w % 16 else ycc) - 128
    rows, cols = padded.shape[0] // 16, padded.shape[1] // 16
    m = transform()
    luma = m @ _blocks(padded[..., 0]) @ m.T
    out = np.empty((rows, cols, 6, 64))
    out[:, :, :4] = luma.reshape(rows, 2, cols, 2, 8, 8).transpose(0, 2, 1, 3, 4, 5).reshape(rows, cols, 4, 64)
    half = padded[..., 1:].reshape(rows * 8, 2, cols * 8, 2, 2).mean(axis=(1, 3))
    for c in (0, 1):
        out[:, :, 4 + c] = (m @ _blocks(half[..., c]) @ m.T).reshape(rows, cols, 64)
    return np.rint(out / _divisors(quality)).astype(np.int64)[..., zigzag()]


def encode_ycbcr(ycc: np.ndarray, quality: int) -> bytes:
    head = jpeg_head(*ycc.shape[:2], quality)
    return head + scan_data(units_of(ycc, quality).reshape(-1, 64)) + EOI


def scan_data(units: np.ndarray) -> bytes:
    """Huffman codes of the blocks of 4:2:0 units, packed."""
    each = units.reshape(-1, 6, 64)
    diff = each[..., 0].copy()
    luma = diff[:, :4].ravel()
    luma[1:] = luma[1:] - luma[:-1]
    diff[:, :4] = luma.reshape(-1, 4)
    diff[1:, 4:] = diff[1:, 4:] - diff[:-1, 4:]
    diff = diff.ravel()
    _, codes, sizes = code_table(False)
    size, start = _sizes(diff), np.arange(len(units)) * 256
    parts = [(start, codes[size] << size | _bits(diff, size), sizes[size] + size)]
    _, codes, sizes = code_table(True)
    block, place = np.nonzero(units[:, 1:])
    last = np.zeros(len(units), np.int64)
    if len(block):
        value = units[block, place + 1]
        before = np.where(np.concatenate([[True], block[1:] != block[:-1]]), -1, np.concatenate([[-1], place[:-1]]))
        run = place - before - 1
        size = _sizes(value)
        symbol = (run % 16) << 4 | size
        at = block * 256 + (place + 1) * 3
        parts.append((at + 2, codes[symbol] << size | _bits(value, size), sizes[symbol] + size))
        for k in range(1, 4):  # runs of 16 zeros
            own = at[run >= 16 * k]
            parts.append((own - 1 + (k > 1), np.full(len(own), codes[0xF0]), np.full(len(own), sizes[0xF0])))
        np.maximum.at(last, block, place + 1)
    own = start[last < 63]
    parts.append((own + 255, np.full(len(own), codes[0]), np.full(len(own), sizes[0])))
    order, code, length = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(order, kind="stable")
    code, length = code[by], length[by]
    end = np.cumsum(length)
    left = np.repeat(end, length) - np.arange(1, end[-1] + 1)  # bits of the own code that follow
    bits = (np.repeat(code, length) >> left) & 1
    bits = np.concatenate([bits.astype(np.uint8), np.ones(-len(bits) % 8, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


@lru_cache(MEMO_SIZE)
def _encode_small(pixels: bytes, shape: tuple[int, ...], quality: int) -> bytes:
    return encode_ycbcr(to_ycbcr(np.frombuffer(pixels, np.uint8).reshape(shape)), quality)


def encode_jpeg(rgb: np.ndarray, quality: int = 75) -> bytes:
    if rgb.nbytes <= MEMO_BYTES and rgb.dtype == np.uint8:
        return _encode_small(rgb.tobytes(), rgb.shape, quality)
    return encode_ycbcr(to_ycbcr(rgb), quality)


class _Codes:
    """Decodes one code table by its next 16 bits."""

    def __init__(self, body: bytes):
        counts, symbols = body[:16], body[16:]
        self.symbol, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        code = k = 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.symbol[code << (16 - length) : (code + 1) << (16 - length)] = symbols[k]
                self.length[code << (16 - length) : (code + 1) << (16 - length)] = length
                code, k = code + 1, k + 1
            code <<= 1
        self.symbol, self.length = self.symbol.tolist(), self.length.tolist()
        self.used = 17 + k


@lru_cache(64)
def _codes(body: bytes) -> _Codes:
    """Tiles of a page share their tables, so a worker keeps the last ones."""
    return _Codes(body)


def _scan(data: bytes, start: int) -> list[bytes]:
    """The entropy-coded intervals from ``start``, without stuffing."""
    out, at = [], start
    while True:
        end = data.find(b"\xff", at)
        while end >= 0 and end + 1 < len(data) and data[end + 1] == 0:
            end = data.find(b"\xff", end + 2)
        stop = len(data) if end < 0 else end
        out.append(data[at:stop].replace(b"\xff\x00", b"\xff"))
        while end >= 0 and end + 1 < len(data) and data[end + 1] == 0xFF:
            end += 1
        if end < 0 or end + 1 >= len(data) or not 0xD0 <= data[end + 1] <= 0xD7:
            return out
        at = end + 2


def decode_ycbcr(data: bytes) -> np.ndarray:
    """YCbCr (or grey as three equal planes' Y) of a baseline JPEG, as floats."""
    if data[:2] != SOI:
        raise ValueError("not a JPEG")
    quant, dc, ac, frame, interval, scan = {}, {}, {}, None, 0, None
    for marker, a, b in segments(data):
        body = data[a:b]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                table = _codes(body[1 : 17 + sum(body[1:17])])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = table
                body = body[table.used :]
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker in (0xC0, 0xC1):
            frame = body
        elif marker in FRAME_MARKERS:
            raise ValueError("only baseline JPEG can be decoded")
        elif marker == 0xDA:
            scan = (body, b)
    if frame is None or scan is None:
        raise ValueError("JPEG without frame or scan")
    h, w, n = int.from_bytes(frame[1:3], "big"), int.from_bytes(frame[3:5], "big"), frame[5]
    if n == 2:
        raise ValueError("a JPEG of two components is no picture")
    comps = [(frame[6 + 3 * i], frame[7 + 3 * i] >> 4, frame[7 + 3 * i] & 15, frame[8 + 3 * i]) for i in range(n)]
    coded = {scan[0][1 + 2 * i]: scan[0][2 + 2 * i] for i in range(scan[0][0])}
    most_h, most_v = max(c[1] for c in comps), max(c[2] for c in comps)
    if n == 1:
        comps, most_h, most_v = [(comps[0][0], 1, 1, comps[0][3])], 1, 1
    cols, rows = -(-w // (8 * most_h)), -(-h // (8 * most_v))
    held = [([], []) for _ in comps]  # places and values of the coefficients that are not 0
    todo = rows * cols
    per, mcu = interval or todo, 0
    coded_by = [(dc[coded[cid] >> 4], ac[coded[cid] & 15], hh, v, *held[i]) for i, (cid, hh, v, _) in enumerate(comps)]
    for part in _scan(data, scan[1]):
        chunk = _Reader(part)
        symbol, value = chunk.symbol, chunk.value
        last = [0] * n
        for _ in range(min(per, todo - mcu)):
            y, x = divmod(mcu, cols)
            for i, (d, a, hh, v, places, values) in enumerate(coded_by):
                for k in range(hh * v):
                    block = ((y * v + k // hh) * cols * hh + x * hh + k % hh) * 64
                    last[i] += value(symbol(d))
                    places.append(block)
                    values.append(last[i])
                    p = 1
                    while p < 64:
                        s = symbol(a)
                        if s == 0:
                            break
                        p += s >> 4
                        if s & 15:
                            if p > 63:
                                raise ValueError("corrupt JPEG data")
                            places.append(block + p)
                            values.append(value(s & 15))
                        p += 1
            mcu += 1
    m, z = transform(), zigzag()
    out = np.empty((h, w, 3))
    for i, ((_, hh, v, q), (places, values)) in enumerate(zip(comps[:3], held, strict=False)):
        places, full = np.array(places, np.int64), np.zeros(rows * v * cols * hh * 64)
        full[places - places % 64 + z[places % 64]] = np.array(values, np.int64) * quant[q][places % 64]
        pixels = m.T @ full.reshape(rows * v, cols * hh, 8, 8) @ m + 128
        plane = pixels.swapaxes(1, 2).reshape(rows * v * 8, cols * hh * 8)
        if most_v > v:
            plane = np.repeat(plane, most_v // v, axis=0)
        if most_h > hh:
            plane = np.repeat(plane, most_h // hh, axis=1)
        out[..., i] = plane[:h, :w]
    if n == 1:
        out[..., 1:] = 128
    return np.clip(out, 0, 255, out=out)


class _Reader:
    """Bits of one interval; after its end come ones."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.have = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.have < n:
            part = self.data[self.at : self.at + 8]
            part += b"\xff" * (8 - len(part))
            self.at += 8
            self.held = (self.held & (1 << self.have) - 1) << 64 | int.from_bytes(part, "big")
            self.have += 64

    def symbol(self, codes: _Codes) -> int:
        self.need(16)
        peek = self.held >> (self.have - 16) & 0xFFFF
        n = codes.length[peek]
        if not n or self.at > len(self.data) + 64:
            raise ValueError("corrupt JPEG data")
        self.have -= n
        return codes.symbol[peek]

    def value(self, size: int) -> int:
        if not size:
            return 0
        self.need(size)
        self.have -= size
        v = self.held >> self.have & (1 << size) - 1
        return v if v >> (size - 1) else v - (1 << size) + 1


_decoded: dict[bytes, np.ndarray] = {}


def decode_jpeg(data: bytes) -> np.ndarray:
    data = bytes(data)
    found = _decoded.get(data) if len(data) <= MEMO_BYTES else None
    if found is None:
        found = to_rgb(decode_ycbcr(data))
        if len(data) > MEMO_BYTES or found.nbytes > MEMO_BYTES:
            return found
        if len(_decoded) >= MEMO_SIZE:
            _decoded.pop(next(iter(_decoded)), None)
        _decoded[data] = found
    return found.copy()


def transcode_420(data: bytes, quality: int) -> bytes:
    """Decoded to YCbCr and encoded anew with 4:2:0 sampling; lossy, without a way through RGB."""
    return encode_ycbcr(decode_ycbcr(data), quality)


def decode_bmp(data: bytes) -> np.ndarray:
    start, w, h, bits = struct.unpack_from("<I", data, 10)[0], *struct.unpack_from("<ii", data, 18), struct.unpack_from("<H", data, 28)[0]
    if bits not in (24, 32):
        raise ValueError("only BMP of 24 or 32 bits can be decoded")
    step = -(-w * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, step * abs(h), start).reshape(abs(h), step)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    return np.ascontiguousarray((rows[::-1] if h > 0 else rows)[..., 2::-1])


def decode_png(data: bytes) -> np.ndarray:
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += size + 12
    w, h, depth, colour, *_, lace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or lace:
        raise ValueError("only plain PNG of 8 bits can be decoded")
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w * channels + 1)
    out = np.zeros((h, w, channels), np.int64)
    for y in range(h):
        line, above = raw[y, 1:].reshape(w, channels).astype(np.int64), out[y - 1] if y else np.zeros((w, channels), np.int64)
        how = raw[y, 0]
        if how == 0:
            out[y] = line
        elif how == 1:
            out[y] = np.cumsum(line, axis=0) & 255
        elif how == 2:
            out[y] = (line + above) & 255
        else:
            left = corner = np.zeros(channels, np.int64)
            for x in range(w):
                up = above[x]
                if how == 3:
                    guess = (left + up) >> 1
                else:
                    p = left + up - corner
                    da, db, dc = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
                    guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
                left, corner = (line[x] + guess) & 255, up
                out[y, x] = left
    out = out.astype(np.uint8)
    if colour in (4, 6):
        return flatten_alpha(out if colour == 6 else np.concatenate([np.repeat(out[..., :1], 3, axis=2), out[..., 1:]], axis=2))
    return np.repeat(out, 3, axis=2) if channels == 1 else out


def flatten_alpha(rgba: np.ndarray) -> np.ndarray:
    """RGBA over white."""
    alpha = rgba[..., 3:].astype(np.float64) / 255
    return np.rint(rgba[..., :3] * alpha + 255 * (1 - alpha)).astype(np.uint8)


def decode_image(data: bytes) -> np.ndarray:
    if data[:2] == SOI:
        return decode_jpeg(data)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return decode_png(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    raise ValueError("neither JPEG, PNG nor BMP")


def split_tables(data: bytes) -> tuple[bytes, bytes]:
    """(tables alone, the JPEG without them), each a stream with start and end markers."""
    if data[:2] != SOI or data[-2:] != EOI:
        raise ValueError("not a whole JPEG")
    tables, rest, end = SOI, SOI, 2
    for marker, a, b in segments(data):
        if marker in (0xDB, 0xC4):
            tables += data[a - 4 : b]
        else:
            rest += data[a - 4 : b]
        end = b
    return tables + EOI, rest + data[end:]


def join_tables(tables: bytes, strip: bytes) -> bytes:
    if not tables:
        return strip
    body = tables.removesuffix(EOI) + strip.removeprefix(SOI)
    return body if body.endswith(EOI) else body + EOI


def white(width: int, height: int) -> np.ndarray:
    return np.full((height, width, 3), 255, np.uint8)


@cache
def white_tile(width: int, height: int, quality: int) -> bytes:
    """A white tile without tables, encoded once a worker."""
    return split_tables(encode_jpeg(white(width, height), quality))[1]


def encode_tile(image: np.ndarray, quality: int) -> bytes:
    """A tile without tables."""
    h, w = image.shape[:2]
    return white_tile(w, h, quality) if (image == 255).all() else split_tables(encode_jpeg(image, quality))[1]


def paste(target: np.ndarray, image: np.ndarray, left: int, top: int, src_x: int = 0, src_y: int = 0, width: int | None = None, height: int | None = None) -> None:
    """Copies a rectangle, clipped to both images."""
    w = min(width if width is not None else image.shape[1], image.shape[1] - src_x, target.shape[1] - left)
    h = min(height if height is not None else image.shape[0], image.shape[0] - src_y, target.shape[0] - top)
    if w > 0 and h > 0:
        target[top : top + h, left : left + w] = image[src_y : src_y + h, src_x : src_x + w]


def stack(pieces: list[np.ndarray]) -> np.ndarray:
    """Strips under each other, as wide as the first."""
    if not pieces:
        raise ValueError("no strips")
    out = white(pieces[0].shape[1], sum(p.shape[0] for p in pieces))
    top = 0
    for p in pieces:
        paste(out, p, 0, top)
        top += p.shape[0]
    return out


def trim(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Cut to the declared size; 0 leaves an edge as it is, and nothing grows."""
    return image[: height or None, : width or None]


def _weights(source: int, target: int) -> np.ndarray:
    """Lanczos weights (three lobes) of the source for each target pixel."""
    ratio = source / target
    reach = 3 * max(ratio, 1.0)
    centre = (np.arange(target) + 0.5) * ratio
    x = (np.arange(source) + 0.5 - centre[:, None]) / max(ratio, 1.0)
    w = np.where(np.abs(x) * max(ratio, 1.0) < reach, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def thumbnail(image: np.ndarray, limit: int) -> np.ndarray:
    """Fitted to ``limit``, never grown; sizes in single precision, cut, at least 1."""
    h, w = image.shape[:2]
    one = np.float32
    scale = min(one(limit) / one(w), one(limit) / one(h), one(1))
    tw, th = max(int(one(w) * scale), 1), max(int(one(h) * scale), 1)
    if (tw, th) == (w, h):
        return image
    out = np.einsum("ij,jkc->ikc", _weights(h, th), image.astype(np.float64))
    return np.clip(np.rint(np.einsum("ij,kjc->kic", _weights(w, tw), out)), 0, 255).astype(np.uint8)
