import struct

import numpy as np
import pytest

import containers as K
from slidemill.functions import codec as C
from slidemill.sources.formats import containers as S
from slidemill.sources.formats import mrxs as M
from slidemill.sources.formats import tiff as T
from slidemill.sources.formats.ini import first_parse, read_ini
from slidemill.sources.formats.model import Blob, SlideError
from slidemill.sources.formats.open import extension_of, open_slide
from slidemill.sources.formats.registry import FORMATS


def near(a, b, most=12):
    return a.shape == b.shape and np.abs(a.astype(int) - b).mean() < most


def tile(slide, level, slot):
    v, blob = slide.levels[level], Blob(slide.path)
    return C.decode_jpeg(v.prefix + blob.read(int(v.offset[slot]), int(v.length[slot])) + v.suffix)


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("tables", [False, True])
def test_tiff(tmp_path, big, tables):
    top, low, macro = K.picture(150, 100), K.picture(75, 50, 1), K.picture(40, 32, 2)
    K.tiff(f"{tmp_path}/a.tif", [top, low], big=big, tables=tables, strips=[("a Macro image", macro), ("thumbnail", macro)])
    s = open_slide(f"{tmp_path}/a.tif")
    assert (s.width, s.height, s.tile_w, s.app_mag, s.quality) == (150, 100, 64, 20.0, 75) and s.mpp == pytest.approx(10000 / 3780)
    assert [(v.width, v.height, v.cols, v.rows, v.downsample) for v in s.levels] == [(150, 100, 3, 2, 1.0), (75, 50, 2, 1, 2.0)]
    assert near(tile(s, 0, 1), K.padded(top, 64)[:64, 64:128])
    assert [m.kind for m in s.images] == ["macro", "thumbnail"] and len(s.images[0].strips) == 2


def test_tiff_faults(tmp_path):
    p = f"{tmp_path}/a.tiff"
    K.write(p, b"MM\0*" + bytes(20))
    with pytest.raises(SlideError, match="little-endian"):
        open_slide(p)
    K.write(p, struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<HI", 0, 8))
    with pytest.raises(SlideError, match="over 64"):
        open_slide(p)
    K.write(p, struct.pack("<2sHI", b"II", 42, 999))
    with pytest.raises(SlideError, match="outside"):
        open_slide(p)
    K.tiff(p, [], strips=[(None, K.picture(32, 32))])
    with pytest.raises(SlideError, match="not tiled"):
        open_slide(p)
    K.tiff(p, [K.picture(32, 32)], compression=1)
    with pytest.raises(SlideError, match="compression 1"):
        open_slide(p)


def test_resolution_and_labels():
    assert T.mpp_from(9162105 / 256, 3) == pytest.approx(0.2794, abs=1e-4) and T.mpp_from(25400, 2) == 1.0
    assert T.mpp_from(100, 1) is None and T.mpp_from(0, 3) is None and T.mpp_from(None, 3) is None
    assert T.labelled_number("Objective Power=20", "objective power", "appmag") == 20
    assert T.labelled_number("Aperio\n1x1|AppMag = 40|MPP = 0.25", "objective power", "appmag") == 40
    assert T.labelled_number("appmag = x", "appmag") is None and T.labelled_number("appmag = -2", "appmag") is None


def test_dmetrix(tmp_path):
    top, low, label, macro = K.picture(23, 21), K.picture(12, 11), K.picture(9, 13), K.picture(11, 8)
    K.dmetrix(f"{tmp_path}/a.dmetrix", top, low, label=label, macro=macro)
    s = open_slide(f"{tmp_path}/a.dmetrix")
    assert (s.width, s.height, s.tile_w, s.app_mag, s.quality) == (23, 21, 16, 20, 90) and s.mpp == pytest.approx(0.255)
    assert [(v.width, v.height, v.cols, v.rows) for v in s.levels] == [(23, 21, 2, 2), (12, 11, 1, 1)]
    assert near(tile(s, 0, 1), top[:16, 16:]) and near(tile(s, 0, 2), top[16:, :16])
    assert [m.kind for m in s.images] == ["label", "macro"]
    assert np.array_equal(C.decode_image(Blob(s.path).read(*s.images[0].strips[0])), label)


def test_dmetrix_faults(tmp_path):
    p = f"{tmp_path}/a.dmetrix"
    K.dmetrix(p, K.picture(23, 21), K.picture(12, 11), label=K.picture(9, 13), macro=K.picture(11, 8))
    good = bytearray(open(p, "rb").read())
    for at, value, match in ((0x40, struct.pack("<I", 0), "scan metadata"), (0xC2 + 14, struct.pack("<H", 9), "not rising"), (342 + 22 + 6, struct.pack("<I", 0), "duplicate"), (342, struct.pack("<H", 3), "invalid DMetrix tile"), (342 + 10, struct.pack("<Q", 10**9), "byte range")):
        bad = bytearray(good)
        bad[at : at + len(value)] = value
        K.write(p, bad)
        with pytest.raises(SlideError, match=match):
            open_slide(p)


def test_sdpc(tmp_path):
    top, low = K.picture(200, 120), K.picture(100, 60, 1)
    K.sdpc(f"{tmp_path}/a.sdpc", [top, low], (56, 48), [K.picture(30, 20), K.picture(40, 20), K.picture(16, 16)], K.picture(32, 24))
    s = open_slide(f"{tmp_path}/a.sdpc")
    assert (s.width, s.height, s.tile_w, s.tile_h, s.mpp, s.app_mag, s.quality, s.compression) == (200, 120, 56, 48, 0.25, 20, 75, "jpeg")
    assert [(v.width, v.height, v.cols, v.rows, v.downsample) for v in s.levels] == [(200, 120, 4, 3, 1), (100, 60, 2, 2, 2)]
    assert near(tile(s, 0, 5), top[48:96, 56:112])
    assert [(m.kind, m.width) for m in s.images] == [("label", 0), ("macro", 0), ("macro_other", 0), ("thumbnail", 32)]
    K.sdpc(f"{tmp_path}/b.dyqx", [top], (56, 48), [], K.picture(32, 24), compression=4)
    assert open_slide(f"{tmp_path}/b.dyqx").compression == "hevc"
    K.sdpc(f"{tmp_path}/c.sdpc", [top], (56, 48), [], K.picture(32, 24), compression=9)
    with pytest.raises(SlideError, match="compression"):
        open_slide(f"{tmp_path}/c.sdpc")


def test_downsample_rule():
    assert [S.downsample_of(np.float32(v)) for v in (1.0, 0.5, 0.25)] == [1, 2, 4]
    for v in (0.3, 2.0, 0.0):
        with pytest.raises(SlideError):
            S.downsample_of(np.float32(v))


def test_kfb(tmp_path):
    a, b, c = K.picture(64, 64), K.picture(64, 64, 1), K.picture(50, 40, 2)
    K.kfb(f"{tmp_path}/a.kfb", (100, 120), 64, [(0, 0, 0, a), (0, 60, 10, b), (1, 0, 0, c)], [K.picture(30, 20), None, K.picture(40, 30)])
    s = open_slide(f"{tmp_path}/a.kfb")
    assert (s.width, s.height, s.mpp, s.app_mag, len(s.levels)) == (120, 100, 0.25, 40, 8)
    assert [(v.width, v.height, v.cols, v.rows) for v in s.levels][:2] == [(120, 100, 2, 2), (60, 50, 1, 1)] and (s.levels[-1].width, s.levels[-1].height) == (1, 1)
    assert s.levels[0].place[:, :4].tolist() == [[0, 0, 64, 64], [60, 10, 64, 64]] and near(tile(s, 1, 0), c)
    assert [m.kind for m in s.images] == ["macro", "thumbnail"]
    K.kfb(f"{tmp_path}/b.kfb", (100, 120), 64, [(0, 0, 0, a), (0, 0, 0, b)], [None] * 3, ids=[10**9, 10**9 - 7])
    with pytest.raises(SlideError, match="level id"):
        open_slide(f"{tmp_path}/b.kfb")
    K.kfb(f"{tmp_path}/c.kfb", (100, 120), 64, [(0, -1, 0, a)], [None] * 3)
    with pytest.raises(SlideError, match="tile entry"):
        open_slide(f"{tmp_path}/c.kfb")


def test_csp(tmp_path):
    a, b, c = K.picture(256, 256), K.picture(100, 256, 1), K.picture(128, 80, 2)
    K.csp(f"{tmp_path}/a.csp", [[(256, 0, b), (0, 0, a), (0, 0, c)], [(0, 0, c)]], [(50, 40, c), (10, 12, b), (30, 30, a)])
    s = open_slide(f"{tmp_path}/a.csp")
    assert [(v.width, v.height, v.cols, v.rows) for v in s.levels] == [(356, 256, 2, 1), (128, 80, 1, 1)]
    assert near(tile(s, 0, 0), a) and near(tile(s, 0, 1), b)  # the first of equal places stays
    assert (s.mpp, s.app_mag) == (0.5, 20) and [m.kind for m in s.images] == ["label", "macro"]
    assert near(C.decode_jpeg(Blob(s.path).read(*s.images[0].strips[0])), b) and near(C.decode_jpeg(Blob(s.path).read(*s.images[1].strips[0])), c)


@pytest.mark.parametrize("wide", [True, False])
def test_bkio(tmp_path, wide):
    top, low = K.picture(150, 100), K.picture(75, 50, 1)
    K.bkio(f"{tmp_path}/a.mdsx", [top, low], 64, K.picture(20, 20), K.picture(30, 20), wide)
    s = open_slide(f"{tmp_path}/a.mdsx")
    assert (s.width, s.height, s.tile_w, s.mpp, s.app_mag, s.quality) == (150, 100, 64, 0.5, 20, 80)
    assert [(v.width, v.height, v.cols, v.rows) for v in s.levels] == [(150, 100, 3, 2), (75, 50, 2, 1)]
    assert near(tile(s, 0, 4), K.padded(top, 64)[64:, 64:128]) and [m.kind for m in s.images] == ["label", "macro"]
    K.write(f"{tmp_path}/meta", b"[Property]\nScale = bad\nScanObjective = 40\nCompressQuality = 500\n")
    K.write(f"{tmp_path}/info.ini", b"[info]\nscale=0.3\n")
    s = open_slide(f"{tmp_path}/a.mdsx")
    assert (s.mpp, s.app_mag, s.quality) == (0.3, 40, 100)  # the first that parses


def test_ndpi(tmp_path):
    top, low = K.picture(128, 64), K.picture(48, 32, 1)
    K.ndpi(f"{tmp_path}/a.ndpi", [(20, K.restart_jpeg(top, 2), 128, 64), (-1, C.encode_jpeg(K.picture(32, 16), 90), 32, 16), (-2, C.encode_jpeg(low, 90), 48, 32), (5, C.encode_jpeg(low, 90), 48, 32)])
    s = open_slide(f"{tmp_path}/a.ndpi")
    assert (s.width, s.height, s.tile_w, s.tile_h, s.mpp, s.app_mag) == (128, 64, 32, 16, 0.25, 20)
    assert (s.levels[0].cols, s.levels[0].rows) == (4, 4) and s.levels[1].place.tolist() == [[0, 0, 48, 32, 0, 0]]
    assert all(near(tile(s, 0, r * 4 + c), top[r * 16 : r * 16 + 16, c * 32 : c * 32 + 32]) for r in range(4) for c in range(4))
    assert [m.kind for m in s.images] == ["macro"] and near(tile(s, 1, 0), low)


def test_frame_headers():
    def header(w, h, sampling, interval, fill=b"", sof=True):
        out = b"\xff\xd8" + fill + b"\xff\xdb\x00\x04\x00\x00"
        if sof:
            out += fill + b"\xff\xc0\x00\x11" + struct.pack(">BHHB", 8, h, w, 3) + bytes([1, sampling, 0, 2, 0x11, 1, 3, 0x11, 1])
        return out + b"\xff\xdd\x00\x04" + struct.pack(">H", interval) + b"\xff\xda\x00\x0c" + bytes(10)

    f = T.frame_of(header(38400, 6912, 0x21, 240))
    assert (f["width"], f["height"], f["h"], f["v"], f["interval"]) == (38400, 6912, 2, 1, 240) and f["interval"] * 8 * f["h"] == 3840
    assert T.frame_of(header(16, 8, 0x11, 4, fill=b"\xff\xff"))["interval"] == 4
    with pytest.raises(SlideError, match="no JPEG frame"):
        T.frame_of(header(16, 8, 0x11, 4, sof=False))
    with pytest.raises(SlideError):
        T.frame_of(b"\xff\xd8\xff\xc0\x00\x08" + bytes(6) + b"\xff\xda\x00\x0c" + bytes(10))


def test_markers_over_chunks(tmp_path):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 255, 3000, dtype=np.uint8)  # no 0xff
    marks = sorted(rng.choice(np.arange(1, 2900, 3), 40, replace=False).tolist())
    for i, m in enumerate(marks):
        data[m], data[m + 1] = 0xFF, 0xD0 + i % 8
    data[2990], data[2991], data[5], data[6] = 0xFF, 0xD9, 0xFF, 0x00
    marks = [m for m in marks if m not in (4, 5, 6)]
    K.write(f"{tmp_path}/x", data.tobytes())
    for chunk in (1, 2, 7, 64, 1 << 20):
        found, end = T.restart_markers(Blob(f"{tmp_path}/x"), 0, 3000, 0, chunk=chunk)
        assert found.tolist() == marks and end == 2990
    with pytest.raises(SlideError, match="no end"):
        T.restart_markers(Blob(f"{tmp_path}/x"), 0, 2900, 0)


def test_mrxs(tmp_path):
    cams = [K.picture(64, 48, i) for i in range(8)]
    places = [(x * 60, y * 44) for y in range(2) for x in range(4)]
    K.mrxs(f"{tmp_path}/a.mrxs", cams, 4, 4, 2, positions=places, label=K.picture(20, 30))
    s = open_slide(f"{tmp_path}/a.mrxs")
    assert (s.width, s.height, s.mpp, s.app_mag, s.tile_w) == (244, 92, 0.26, 20, 256)
    assert s.levels[0].place.tolist() == [[x, y, 64, 48, 0, 0] for x, y in places] and s.levels[1].place.shape == (8, 6)
    assert s.levels[1].place[1].tolist() == [30, 0, 32, 24, 32, 0] and (s.levels[1].width, s.levels[1].height) == (122, 46)
    assert [m.kind for m in s.images] == ["label"] and len(s.files) == 1
    for packed in (False, True):
        K.mrxs(f"{tmp_path}/b.mrxs", cams, 4, 4, 2, positions=places if packed else None, packed=packed)
        assert open_slide(f"{tmp_path}/b.mrxs").levels[0].place[:, :2].tolist() == [list(p) for p in places]


def test_mrxs_geometry():
    assert (M.axis_extent(600, 302, 180.869565217392, 8), M.axis_extent(1632, 252, 180.869565217392, 8)) == (167806, 374521)
    p = M.nominal_positions((302, 252), (180.869565217392, 180.869565217392), 75, 80, 8)
    assert p[1].tolist() == [int(302 * 8 - 180.869565217392), 0] and p[75].tolist() == [0, int(252 * 8 - 180.869565217392)]
    ini = M.Ini("[hierarchical]\nnonhier_count=2\nnonhier_0_name=a\nnonhier_0_count=3\nnonhier_0_val_0=x\nnonhier_0_val_1=y\nnonhier_0_val_2=z\nnonhier_1_name=b\nnonhier_1_count=2\nnonhier_1_val_0=u\nnonhier_1_val_1=v\n")
    assert {(n, v): i for i, n, v, _ in M.layer_values(ini)} == {("a", "x"): 0, ("a", "y"): 1, ("a", "z"): 2, ("b", "u"): 3, ("b", "v"): 4}


def test_extensions():
    assert [extension_of(p) for p in ("/a/b.TIFF", "b.tif", "/a.b/c", "x", ".tif")] == ["tiff", "tif", "", "", ""]
    assert len(FORMATS) == 12 and len({label for _, _, label, _ in FORMATS}) == 11
    with pytest.raises(SlideError, match="unsupported input extension .svs"):
        open_slide("/x/a.SVS")


def test_ini_and_first_parse():
    assert read_ini("﻿[A]\n k = 1 \nk=2\n;c\n[b]\nk==3") == {"a.k": "2", "b.k": "=3"}
    assert first_parse(int, None, "x", "7", "8") == 7 and first_parse(float) is None
