import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import containers as K
from slidemill.functions import codec as C
from slidemill.functions.bytes import is_420, positions
from slidemill.operators.layout import LUMINANCE


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 50), st.integers(1, 50), st.integers(1, 100), st.integers(0, 9))
def test_jpeg_keeps_flat_and_smooth_pictures(w, h, quality, seed):
    flat = np.full((h, w, 3), 25 * seed, np.uint8)
    data = C.encode_jpeg(flat, max(quality, 50))
    assert is_420(data) and np.abs(C.decode_jpeg(data).astype(int) - flat).max() <= 3
    y, x = np.mgrid[:h, :w]
    smooth = np.stack([x * 2, y * 2, x + y], -1).astype(np.uint8)
    assert np.abs(C.decode_jpeg(C.encode_jpeg(smooth, 95)).astype(int) - smooth).mean() < 4


def test_noise_survives_every_coefficient():
    noise = np.random.default_rng(1).integers(0, 256, (32, 32), dtype=np.uint8)
    grey = np.repeat(noise[..., None], 3, axis=2)
    assert np.abs(C.decode_jpeg(C.encode_jpeg(grey, 100)).astype(int) - grey).max() <= 4


def test_restart_intervals():
    p = K.picture(96, 48)
    whole = C.decode_jpeg(C.encode_jpeg(p, 90))
    assert np.abs(C.decode_jpeg(K.restart_jpeg(p, 2)).astype(int) - whole).max() <= 2


def test_tables_split_and_join():
    data = C.encode_jpeg(K.picture(32, 24), 80)
    tables, rest = C.split_tables(data)
    assert len(rest) < len(data) and np.array_equal(C.decode_jpeg(C.join_tables(tables, rest)), C.decode_jpeg(data))
    assert C.join_tables(b"", rest) == rest and C.join_tables(tables, rest[2:-2]).endswith(b"\xff\xd9")
    with pytest.raises(ValueError):
        C.split_tables(data[:-2])


def test_other_images():
    p = K.picture(13, 9)
    assert np.array_equal(C.decode_image(K.bmp(p)), p) and np.array_equal(C.decode_image(K.png(p)), p)
    with pytest.raises(ValueError):
        C.decode_image(b"GIF89a")
    rgba = np.dstack([p, np.full((9, 13), 0, np.uint8)])
    assert (C.flatten_alpha(rgba) == 255).all()


def test_not_420():
    data = bytearray(C.encode_jpeg(K.picture(16, 16), 80))
    at = data.index(b"\xff\xc0")
    data[at + 11] = 0x21
    assert not is_420(bytes(data)) and not is_420(b"") and not is_420(b"\xff\xd8\xff\xc0\x00")


def test_quality_estimate():
    assert [C.estimate_quality(C.scaled_table(LUMINANCE, q).tolist()) for q in (10, 49, 50, 75, 90)] == [10, 49, 50, 75, 90]
    with pytest.raises(ValueError):
        C.scaled_table(LUMINANCE, 0)


def test_thumbnail_sizes():
    assert C.thumbnail(C.white(3000, 1000), 1024).shape == (341, 1024, 3) and C.thumbnail(C.white(30, 10), 1024).shape == (10, 30, 3)
    assert C.thumbnail(C.white(4000, 1), 100).shape == (1, 100, 3) and (C.thumbnail(C.white(300, 200), 50) == 255).all()


def test_stack_trim_paste():
    a, b = K.picture(10, 4), K.picture(12, 6, 1)
    s = C.stack([a, b])
    assert s.shape == (10, 10, 3) and np.array_equal(s[4:], b[:, :10])
    assert C.trim(s, 8, 0).shape == (10, 8, 3) and C.trim(s, 99, 5).shape == (5, 10, 3)
    t = C.white(5, 5)
    C.paste(t, a, 3, 3, 1, 1)
    assert np.array_equal(t[3:, 3:], a[1:3, 1:3]) and (t[:3] == 255).all()


@given(st.binary(max_size=60), st.binary(max_size=3))
def test_positions(data, needle):
    assert positions(data, needle) == ([i for i in range(len(data)) if data[i : i + len(needle)] == needle and i + len(needle) <= len(data)] if needle else [])


def test_hevc_tiles_share_one_decoder(monkeypatch):
    """With a stand-in for PyAV: one context for all tiles, flushed after each; a tile without a picture is an error."""
    import sys
    import types

    import numpy as np
    import pytest

    from slidemill.operators import compose

    made = []

    class Context:
        def __init__(self):
            self.held, self.flushed = [], 0

        def decode(self, packet):
            if packet is not None:
                self.held = [types.SimpleNamespace(to_ndarray=lambda format, v=packet[0]: np.full((4, 6, 3), v, np.uint8))] if packet else []
                return []
            return self.held

        def flush_buffers(self):
            self.held, self.flushed = [], self.flushed + 1

    def create(name, mode):
        assert (name, mode) == ("hevc", "r")
        made.append(Context())
        return made[-1]

    monkeypatch.setitem(sys.modules, "av", types.SimpleNamespace(Packet=bytes, CodecContext=types.SimpleNamespace(create=create)))
    compose.hevc_context.cache_clear()
    try:
        for v in (7, 9):
            out = compose.hevc_tile(bytes([v]), 8, 8)
            assert out.shape == (8, 8, 3) and (out[:4, :6] == v).all() and (out[4:] == 255).all()
        with pytest.raises(ValueError, match="without a picture"):
            compose.hevc_tile(b"", 8, 8)
        assert len(made) == 1 and made[0].flushed == 3
    finally:
        compose.hevc_context.cache_clear()
