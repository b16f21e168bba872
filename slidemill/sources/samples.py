"""Writes small synthetic containers of each format, for queries and tests."""

from __future__ import annotations

import base64
import os
import struct
import zlib
from functools import lru_cache

import numpy as np

from slidemill.functions import codec as C
from slidemill.sources.formats import containers as S
from slidemill.sources.svs_sink import directory, page_fields


def picture(w, h, seed=0):
    y, x = np.mgrid[:h, :w]
    return np.stack([(x * 2 + seed) % 200 + 20, (y * 3) % 200 + 20, np.full_like(x, 60 + 40 * (seed % 4))], -1).astype(np.uint8)


def cut(image, size):
    """JPEG tiles in row-major order, each at its own size."""
    h, w = image.shape[:2]
    return [C.encode_jpeg(image[y : y + size, x : x + size], 90) for y in range(0, h, size) for x in range(0, w, size)]


def padded(image, size):
    h, w = image.shape[:2]
    if not (h % size or w % size):
        return image
    out = C.white(-(-w // size) * size, -(-h // size) * size)
    out[:h, :w] = image
    return out


class Body:
    """Bytes with appended blobs."""

    def __init__(self, head: bytes):
        self.data = bytearray(head)

    def put(self, blob: bytes) -> tuple[int, int]:
        at = len(self.data)
        self.data += blob
        return at, len(blob)


def tiff(path, images, size=64, big=False, strips=(), tables=False, quality=80, description="Slide|AppMag = 20", subfile=None, compression=7):
    """Tiled levels, then strip pages (description, image)."""
    body = Body(bytes(16))
    pages = []
    for i, image in enumerate(images):
        h, w = image.shape[:2]
        blobs = cut_padded(image, size, quality)
        shared = b""
        if tables:
            shared = C.split_tables(blobs[0])[0]
            blobs = [C.split_tables(b)[1] for b in blobs]
        at = [body.put(b) for b in blobs]
        pages.append({"width": w, "height": h, "tile_w": size, "tile_h": size, "reduced": i > 0 if subfile is None else subfile, "resolution": 3780.0, "description": description if i == 0 else None, "offsets": [a for a, _ in at], "counts": [n for _, n in at], "tables": shared})
    for text, image in strips:
        half = image.shape[0] // 2 // 16 * 16
        pieces = [C.split_tables(C.encode_jpeg(p, quality)) for p in ((image[:half], image[half:]) if half else (image,))]
        at = [body.put(p[1]) for p in pieces]
        pages.append({"width": image.shape[1], "height": image.shape[0], "tile_w": 0, "tile_h": 0, "reduced": False, "resolution": 1.0, "description": text, "offsets": [a for a, _ in at], "counts": [n for _, n in at], "tables": b"", "shared": pieces[0][0]})
    body.data += bytes(-len(body.data) % 8)
    start = len(body.data)
    for i, p in enumerate(pages):
        fields = page_fields(p, big)
        if p.get("shared"):
            fields = sorted([*fields, (347, 7, len(p["shared"]), p["shared"])])
        fields = [(t, k, n, struct.pack("<H", compression) if t == 259 else v) for t, k, n, v in fields]
        body.data += directory(fields, len(body.data), big, i == len(pages) - 1)
    body.data[:16] = struct.pack("<2sHHHQ", b"II", 43, 8, 0, start) if big else struct.pack("<2sHI", b"II", 42, start).ljust(16, b"\0")
    write(path, body.data)


def blocks(image, w, h):
    """Tiles of a whole number of columns and rows, in row-major order, each in one piece of memory."""
    rows, cols = image.shape[0] // h, image.shape[1] // w
    return np.ascontiguousarray(image.reshape(rows, h, cols, w, -1).swapaxes(1, 2)).reshape(rows * cols, h, w, -1)


def cut_padded(image, size, quality=80):
    return [C.encode_jpeg(b, quality) for b in blocks(padded(image, size), size, size)]


def write(path, data):
    try:
        f = open(path, "wb", buffering=0)
    except FileNotFoundError:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        f = open(path, "wb", buffering=0)
    with f:
        left = memoryview(data)
        while left:
            left = left[f.write(left) :]


def bmp(image):
    h, w = image.shape[:2]
    rows = b"".join(r.tobytes().ljust(-(-w * 3 // 4) * 4, b"\0") for r in image[::-1, :, ::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def png(image):
    h, w = image.shape[:2]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + r.tobytes() for r in image)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def dmetrix(path, top, low, size=16, label=None, macro=None, swap=False):
    """Two levels, the larger stored column by column."""
    data = bytearray(0x400)
    data[:8] = b"DmetrixN"
    struct.pack_into("<ddI", data, 0x30, 0.25, 0.26, 20)
    grids = [(9, low), (10, top)]
    index = 320
    for i, (ident, image) in enumerate(grids):
        rows, cols = -(-image.shape[0] // size), -(-image.shape[1] // size)
        struct.pack_into("<HIII", data, 0xC2 + 14 * i, ident, cols - 1, rows - 1, index)
        index += 22 * rows * cols
    struct.pack_into("<HIII", data, 0xC2 + 28, 11, 0, 0, 0)
    body, index = Body(bytes(data)), 320
    for (ident, image), step in zip(grids, (0, 1), strict=True):
        rows, cols = -(-image.shape[0] // size), -(-image.shape[1] // size)
        blobs = cut(image, size)
        order = [(x, y) for x in range(cols) for y in range(rows)] if step else [(x, y) for y in range(rows) for x in range(cols)]
        for x, y in order:
            at, n = body.put(blobs[y * cols + x])
            struct.pack_into("<HIIQI", body.data, index, ident, x, y, at, n)
            index += 22
    for i, (ident, image) in enumerate(((0xFFFF, label), (0xFFFE, macro))):
        at, n = body.put(bmp(image))
        struct.pack_into("<HIIQI", body.data, 320 - 44 + 22 * i, ident, 0, 0, at, n)
    write(path, body.data)


def sdpc(path, levels, size, images, thumb, compression=0, quality=75, scales=None):
    """Levels at scales 1, 1/2, ...; a chain of blocks."""
    head = bytearray(struct.calcsize("<H16sIQIIIIIIIIIBBB3sfdIQQB"))
    person = len(head)
    body = Body(bytes(head))
    h, w = levels[0].shape[:2]
    body.put(struct.pack("<HI", 0x4950, 0) + bytes(64 + 64 + 1 + 1 + 64 + 64 + 1024 + 2048 + 2048 + 64 + 64 + 1024) + struct.pack("<Q", 0) + bytes(264))
    links = [person + 6 + 6530]
    at = len(body.data)

    def link():
        struct.pack_into("<Q", body.data, links.pop(), len(body.data))

    for image in images:
        link()
        blob = C.encode_jpeg(image, 90)
        here = len(body.data)
        body.put(struct.pack("<H8s8s16sQB", 0x494D, b"", b"", b"", len(blob), 0) + struct.pack("<Q", 0) + bytes(72) + blob)
        links.append(here + 43)

    def info(tiles, cols, rows, scale):
        link()
        here = len(body.data)
        table = b"".join(struct.pack("<i", len(t)) for t in tiles) if tiles is not None else b""
        blob = table + b"".join(tiles or [])
        body.put(struct.pack("<HIIIIIQQf", 0x4649, 122, 0, cols * rows, cols, rows, len(blob), 0, scale) + bytes(80) + blob)
        links.append(here + 30)

    link()
    here, blob = len(body.data), C.encode_jpeg(thumb, 90)
    body.put(struct.pack("<HIIIIIQQf", 0x4649, 122, 0, 1, 1, 1, len(blob), 0, 1.0) + bytes(80) + blob)
    links.append(here + 30)
    for i, image in enumerate(levels):
        cols, rows = -(-image.shape[1] // size[0]), -(-image.shape[0] // size[1])
        p = C.white(cols * size[0], rows * size[1])
        p[: image.shape[0], : image.shape[1]] = image
        tiles = [C.encode_jpeg(b, quality) for b in blocks(p, *size)]
        info(tiles, cols, rows, (scales or [0.5**k for k in range(9)])[i])
    body.data[: len(head)] = struct.pack("<H16sIQIIIIIIIIIBBB3sfdIQQB", 0x5153, b"", person, len(body.data), len(images), 0, len(levels), w, h, *size, thumb.shape[1], thumb.shape[0], 0, quality, 0, b"", 1.0, 0.25, 20, 0, 0, compression)
    assert at
    write(path, body.data)


def kfb(path, image, tile, placed, images, ids=None):
    """placed: (level, x, y, image); images: macro, label, preview."""
    h, w = image
    body = Body(bytes(96))

    def embedded(pic):
        if pic is None:
            return 0
        blob = C.encode_jpeg(pic, 90)
        return body.put(struct.pack("<8siiiI", b"", pic.shape[0], pic.shape[1], 0, len(blob)) + bytes(28) + blob)[0]

    at = [embedded(p) for p in images]
    blobs = [C.encode_jpeg(p, 90) for *_, p in placed]
    start = len(body.data)
    size, offset = S.KF_TILE.itemsize * len(placed), 0
    for i, ((level, x, y, p), b) in enumerate(zip(placed, blobs, strict=True)):
        ident = ids[i] if ids else 10**9 - level * 8388608
        body.put(struct.pack("<iiiiii", 0, x, y, p.shape[1], p.shape[0], ident) + bytes(8) + struct.pack("<iq", len(b), size + offset) + bytes(20))
        offset += len(b)
    for b in blobs:
        body.put(b)
    head = struct.pack("<i4s8siiii4siiqIIQQf8si", 0, b"KFB\0", b"", len(placed), h, w, 40, b"JPG\0", 0, 0, 0, at[0], at[1], at[2], start, 0.25, b"", tile)
    body.data[: len(head)] = head
    write(path, body.data)


def csp(path, levels, images, first_wins=False):
    """levels: lists of (x, y, image); images: (width, height, image)."""
    header = bytearray(4096)
    header[:5] = b"MEDIC"
    start = 3000
    header[start : start + 4] = b"\xff\xd8\xff\xe0"
    body = Body(bytes(header))
    at = 64
    for w, h, pic in images:
        o, n = body.put(C.encode_jpeg(pic, 90))
        rec = bytes.fromhex("020001000e00") + b"".join(S.csp_item(2, i, k, s) + v.to_bytes(s, "little") for i, k, s, v in ((3, 5, 4, w), (4, 5, 4, h), (5, 7, 8, o - start), (6, 7, 8, n)))
        body.data[at : at + len(rec)] = rec
        at += 224
    tail = S.csp_item(4, 10, 9, 4) + struct.pack("<f", 0.5) + S.csp_item(4, 9, 9, 4) + struct.pack("<f", 20)
    for level in levels:
        for x, y, pic in level:
            o, n = body.put(C.encode_jpeg(pic, 90))
            tail += S.CS_MARK + struct.pack("<IIIIIIIII", pic.shape[1], pic.shape[0], o - start, 0, n, 0, x, y, 0)
        tail += b"gap"
    struct.pack_into("<Q", body.data, 0x1E, len(body.data))
    body.put(tail)
    write(path, body.data)


def bkio(path, levels, size, label, macro, wide=True):
    h, w = levels[0].shape[:2]
    body = Body(bytes(164 + 16 * len(levels)))
    body.data[:4] = b"BKIO"
    layers = []
    for i, image in enumerate(levels):
        blobs = cut_padded(image, size)
        cols, rows = -(-image.shape[1] // size), -(-image.shape[0] // size)
        ranges = [body.put(b) for b in blobs]
        at, n = body.put(struct.pack("<I", len(blobs)) + b"".join(struct.pack("<HII", 0, o, k) for o, k in ranges))
        struct.pack_into("<8sII", body.data, 164 + 16 * i, b"", at, n)
        layers.append(f'<Layer{i} value="x"><Rows value="{rows}"/><Cols value="{cols}"/></Layer{i}>')
    slide = f'<Slide><ImageMatrix><Width value="{w}"/><Height value="{h}"/><CellWidth value="{size}"/><CellHeight value="{size}"/><LayerCount value="{len(levels)}"/>{"".join(layers)}</ImageMatrix></Slide>'
    values = '<P><Scale value="0.5"/><ScanObjective value="20"/><CompressQuality value="80"/></P>'
    code = (lambda t: base64.encodebytes(t.encode("utf-16-le"))) if wide else (lambda t: t.encode())
    at = [body.put(code(values)), body.put(C.encode_jpeg(macro, 90)), body.put(C.encode_jpeg(label, 90)), body.put(code(slide))]
    first = len(body.data)
    body.put(bytes(20) + struct.pack("<II", *at[0]) + b"".join(bytes(6) + struct.pack("<II", *r) for r in at[1:]))
    struct.pack_into("<I", body.data, 84 + 8, first)
    write(path, body.data)


def restart_jpeg(image, interval):
    """A 4:2:0 JPEG with a restart marker after each ``interval`` units; equal pictures are coded once, as by the codec."""
    return _restart_jpeg(image.tobytes(), image.shape, interval)


@lru_cache(1024)
def _restart_jpeg(pixels, shape, interval):
    image = np.frombuffer(pixels, np.uint8).reshape(shape)
    h, w = shape[:2]
    units = C.units_of(C.to_ycbcr(image), 90)
    out = C.jpeg_head(h, w, 90, interval)
    parts = [C.scan_data(row[x : x + interval].reshape(-1, 64)) for row in units for x in range(0, len(row), interval)]
    for i, p in enumerate(parts):
        out += p + (b"\xff" + bytes([0xD0 + i % 8]) if i < len(parts) - 1 else b"\xff\xd9")
    return out


def ndpi(path, pages):
    """pages: (lens, strip, width, height)."""
    body = Body(bytes(8))
    out = []
    for lens, strip, w, h in pages:
        at, n = body.put(strip)
        out.append({256: (4, 1, struct.pack("<I", w)), 257: (4, 1, struct.pack("<I", h)), 259: (3, 1, struct.pack("<H", 7)), 273: (4, 1, struct.pack("<I", at)), 279: (4, 1, struct.pack("<I", n)), 282: (5, 1, struct.pack("<II", 40000, 1)), 296: (3, 1, struct.pack("<H", 3)), 65421: (11, 1, struct.pack("<f", lens))})
    body.data += bytes(-len(body.data) % 8)
    struct.pack_into("<2sHI", body.data, 0, b"II", 42, len(body.data))
    for i, f in enumerate(out):
        body.data += directory([(t, *f[t]) for t in sorted(f)], len(body.data), False, i == len(out) - 1)
    write(path, body.data)


def mrxs(path, image, overlap, across, down, positions=None, packed=False, label=None):
    """One zoom level of whole camera images, and one that concatenates two by two."""
    folder, slide_id = path.rpartition(".")[0], "SLIDE-1"
    write(path, b"")
    size = image[0].shape
    data = Body(b"\0")
    ranges0 = [data.put(C.encode_jpeg(p, 90)) for p in image]
    half = [np.concatenate([np.concatenate([image[y * across + x][::2, ::2] for x in (cx, cx + 1)], 1) for y in (cy, cy + 1)], 0) for cy in range(0, down, 2) for cx in range(0, across, 2)]
    ranges1 = [data.put(C.encode_jpeg(p, 90)) for p in half]
    beside = []
    if positions is not None:
        raw = b"".join(struct.pack("<Bii", 1, x, y) for x, y in positions)
        beside.append(("StitchingIntensityLayer", "StitchingIntensityLevel", data.put(zlib.compress(raw) if packed else raw)) if packed else ("Scan data layer", "VIMSLIDE_POSITION_BUFFER", data.put(raw)))
    if label is not None:
        beside.append(("Scan data layer", "ScanDataLayer_SlideBarcode", data.put(C.encode_jpeg(label, 90))))
    write(f"{folder}/Data0000.dat", data.data)
    index = Body(b"01.02" + slide_id.encode() + bytes(8))
    root = 5 + len(slide_id)

    def page(records):
        at = index.put(struct.pack("<ii", len(records), 0) + b"".join(struct.pack("<iiii", *r) for r in records))[0]
        return index.put(struct.pack("<ii", 0, at))[0]

    tops = [page([(i, o, n, 0) for i, (o, n) in enumerate(ranges0)]), page([(y * across + x, o, n, 0) for (y, x), (o, n) in zip([(y, x) for y in range(0, down, 2) for x in range(0, across, 2)], ranges1, strict=True)])]
    struct.pack_into("<i", index.data, root, index.put(struct.pack("<ii", *tops))[0])
    pointers = []
    order = sorted(beside, key=lambda b: b[0])
    for *_, (o, n) in order:
        at = index.put(struct.pack("<iiiiiii", 1, 0, 0, 0, o, n, 0))[0]
        pointers.append(index.put(struct.pack("<ii", 0, at))[0])
    struct.pack_into("<i", index.data, root + 4, index.put(b"".join(struct.pack("<i", p) for p in pointers))[0])
    write(f"{folder}/Index.dat", index.data)
    ini = [f"[GENERAL]\nSLIDE_ID = {slide_id}\nIMAGENUMBER_X = {across}\nIMAGENUMBER_Y = {down}\nOBJECTIVE_MAGNIFICATION = 20\n[HIERARCHICAL]\nINDEXFILE = Index.dat\nHIER_COUNT = 1\nHIER_0_NAME = Slide zoom level\nHIER_0_COUNT = 2\nHIER_0_VAL_0_SECTION = L0\nHIER_0_VAL_1_SECTION = L1"]
    layers = list(dict.fromkeys(b[0] for b in order))
    ini.append(f"NONHIER_COUNT = {len(layers)}")
    for i, layer in enumerate(layers):
        values = [b[1] for b in order if b[0] == layer]
        ini += [f"NONHIER_{i}_NAME = {layer}", f"NONHIER_{i}_COUNT = {len(values)}", *(f"NONHIER_{i}_VAL_{k} = {v}" for k, v in enumerate(values))]
    ini.append("[DATAFILE]\nFILE_COUNT = 1\nFILE_0 = Data0000.dat")
    for k, concat in enumerate((0, 1)):
        ini.append(f"[L{k}]\nIMAGE_FORMAT = JPEG\nIMAGE_CONCAT_FACTOR = {concat}\nOVERLAP_X = {overlap}\nOVERLAP_Y = {overlap}\nMICROMETER_PER_PIXEL_X = 0.25\nMICROMETER_PER_PIXEL_Y = 0.27\nDIGITIZER_WIDTH = {size[1]}\nDIGITIZER_HEIGHT = {size[0]}")
    write(f"{folder}/Slidedat.ini", ("﻿" + "\n".join(ini)).encode())


def grey(key: int, level: int, slot: int) -> int:
    return (key * 7 + level * 31 + slot * 13) % 200 + 20


def flat(key: int, level: int, slot: int, w: int, h: int) -> np.ndarray:
    """A picture of the one grey that stands for key, level and slot; embedded images have level 9."""
    return np.full((h, w, 3), grey(key, level, slot), np.uint8)


def tiled(key: int, level: int, w: int, h: int, tile_w: int, tile_h: int) -> np.ndarray:
    """A level each of whose tiles is of one grey."""
    slot = np.arange(h)[:, None] // tile_h * -(-w // tile_w) + np.arange(w) // tile_w
    out = np.empty((h, w, 3), np.uint8)
    out[:] = ((key * 7 + level * 31 + slot * 13) % 200 + 20)[..., None]
    return out


def numbered(form: str, k: int, folder: str) -> str:
    """Writes a container of a format whose shape and greys follow from the number ``k``; its path."""
    image = lambda slot, w, h: flat(k, 9, slot, w, h)
    cols, rows = 2 * (k % 2 + 1), 2 * (k % 3 + 1)
    if form == "tiff":
        c, r = k % 3 + 1, k % 2 + 1
        path = f"{folder}/s{k}.tif"
        tiff(path, [tiled(k, 0, c * 16, r * 16, 16, 16), tiled(k, 1, (c + 1) // 2 * 16, (r + 1) // 2 * 16, 16, 16)], 16, big=k % 2 == 1, tables=k % 3 == 0, strips=[("a label", image(0, 32, 16)), ("Macro", image(1, 32, 32))])
    elif form == "dmetrix":
        w, h = 16 * (k % 3 + 2) - k % 5, 16 * (k % 2 + 1) + k % 4
        path = f"{folder}/s{k}.dmetrix"
        dmetrix(path, tiled(k, 0, w, h, 16, 16), tiled(k, 1, (w + 1) // 2, (h + 1) // 2, 16, 16), label=image(0, 9, 13), macro=image(1, 11, 8))
    elif form == "sdpc":
        path = f"{folder}/s{k}.{('sdpc', 'dyqx')[k % 2]}"
        sdpc(path, [tiled(k, 0, cols * 32, rows * 16, 32, 16), tiled(k, 1, cols * 16, rows * 8, 32, 16)], (32, 16), [image(0, 16, 16), image(1, 32, 16)], image(2, 24, 16))
    elif form == "kfb":
        path = f"{folder}/s{k}.kfb"
        placed = [(0, i * 20, i % 2 * 10, flat(k, 0, i, 16 + i % 2 * 16, 16)) for i in range(k % 4 + 1)] + [(1, 5, 7, flat(k, 1, 0, 16, 16))]
        kfb(path, (90, 100 + k % 50), 64, placed, [image(0, 32, 16), image(1, 16, 16), image(2, 24, 16)])
    elif form == "csp":
        path = f"{folder}/s{k}.csp"
        # The second tile at the origin and the one off the grid stay out; one place may have no tile.
        placed = [(256 * i, 0, flat(k, 0, i, 32, 16)) for i in range(k % 3 + 1) if (k % 3, i) != (2, 1)]
        csp(path, [[*placed, (0, 0, flat(k, 0, 50, 16, 16)), (100, 30, flat(k, 0, 60, 16, 16))], [(0, 0, flat(k, 1, 0, 32, 16))]], [(48, 32, image(1, 48, 32)), (16, 16, image(0, 16, 16)), (32, 16, image(2, 32, 16))])
    elif form == "bkio":
        path = f"{folder}/s{k}.{('mdsx', 'msdx', 'mdss')[k % 3]}"
        bkio(path, [tiled(k, 0, cols * 16, rows * 16, 16, 16), tiled(k, 1, cols * 8, rows * 8, 16, 16)], 16, image(0, 16, 16), image(1, 32, 16), k % 2 == 0)
    elif form == "ndpi":
        c, r = k % 3 + 1, k % 2 + 1
        path = f"{folder}/s{k}.ndpi"
        low = flat(k, 1, 0, c * 16, r * 8)
        ndpi(path, [(20, restart_jpeg(tiled(k, 0, c * 32, r * 16, 32, 16), 2), c * 32, r * 16), (-1, C.encode_jpeg(image(0, 32, 16), 90), 32, 16), (5, C.encode_jpeg(low, 90), c * 16, r * 8)])
    elif form == "mrxs":
        path = f"{folder}/s{k}.mrxs"
        places = [(c % 4 * 12 + k % 3, c // 4 * 12) for c in range(8)]
        if k % 5 == 0:
            places[5] = (0, 0)  # a camera field that wasn't scanned
        mrxs(path, [flat(k, 0, c, 16, 16) for c in range(8)], 4, 4, 2, positions=places if k % 3 else None, packed=k % 3 == 2, label=image(0, 16, 24))
    else:
        raise ValueError(f"no samples of format {form}")
    return path


def cut_short(path: str) -> None:
    """Leaves the first bytes of a container; of an MRXS slide those of its index."""
    if path.endswith(".mrxs"):
        path = f"{path.rpartition('.')[0]}/Index.dat"
    with open(path, "r+b") as f:
        f.truncate(12)
