import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import containers as K
from slidemill.functions import codec as C
from slidemill.plans.convert import check_quality, convert
from slidemill.sources import slide_source as S
from slidemill.sources.formats import tiff as T
from slidemill.sources.formats.model import Blob
from slidemill.sources.formats.open import open_slide
from slidemill.sources.svs_sink import directory, page_fields


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("slides"))
    K.tiff(f"{d}/one/a.tif", [K.picture(150, 100), K.picture(75, 50)], strips=[("label", K.picture(40, 32, 2)), ("thumbnail", K.picture(60, 40))])
    K.sdpc(f"{d}/two/b.sdpc", [K.picture(200, 120)], (56, 40), [K.picture(30, 20), K.picture(40, 20)], K.picture(32, 24))
    K.kfb(f"{d}/two/deep/c.kfb", (100, 120), 64, [(0, 0, 0, K.picture(64, 64)), (0, 60, 10, K.picture(40, 64, 1)), (1, 0, 0, K.picture(50, 40, 2))], [K.picture(30, 20), None, None])
    K.ndpi(f"{d}/d.NDPI", [(20, K.restart_jpeg(K.picture(128, 64), 2), 128, 64), (5, C.encode_jpeg(K.picture(48, 32, 1), 90), 48, 32)])
    K.mrxs(f"{d}/e.mrxs", [K.picture(64, 48, i) for i in range(8)], 4, 4, 2, positions=[(x * 60, y * 44) for y in range(2) for x in range(4)])
    K.write(f"{d}/bad.csp", b"nothing")
    K.write(f"{d}/skip.svs", b"nothing")
    return d


def names(d, paths):
    return sorted(os.path.relpath(p, d) for p in paths)


def test_listing(folder):
    found = names(folder, S.list_files(folder))
    assert found == ["bad.csp", "d.NDPI", "e.mrxs", "one/a.tif", "two/b.sdpc", "two/deep/c.kfb"]
    assert names(folder, S.list_files(f"{folder}/two/*.sdpc")) == ["two/b.sdpc"]
    assert S.list_files(f"file://{folder}/two")[0].startswith("file:")
    assert S.list_files(f"{folder}/d.NDPI") == [f"{folder}/d.NDPI"]
    with pytest.raises(FileNotFoundError):
        S.list_files(f"{folder}/none")


def test_relations(spark, folder):
    S.register(spark)
    read = lambda r, **o: S.read_slides(spark, folder, r, mode="permissive", **o)
    slides = {os.path.basename(r.path): r for r in read("slides").collect()}
    assert {k: (v.format, v.width, v.levels) for k, v in slides.items()} == {"a.tif": ("tiff", 150, 2), "b.sdpc": ("sdpc", 200, 1), "c.kfb": ("kfb", 120, 8), "d.NDPI": ("ndpi", 128, 2), "e.mrxs": ("mrxs", 244, 2)}
    per = {(os.path.basename(r.path), r.level): r["count"] for r in read("tiles").groupBy("path", "level").count().collect()}
    assert per[("a.tif", 0)] == 6 and per[("c.kfb", 0)] == 2 and per[("d.NDPI", 0)] == 16 and per[("e.mrxs", 1)] == 8
    assert read("tiles").where("level = 1").count() == 2 + 1 + 1 + 8
    assert read("errors").collect()[0].path.endswith("bad.csp")
    with pytest.raises(Exception, match="bad.csp"):
        S.read_slides(spark, folder, "slides").collect()
    assert {r.kind for r in read("images").where(F.col("path").endswith("a.tif")).collect()} == {"label", "thumbnail"}
    one = read("levels").where(F.col("path") == f"{folder}/one/a.tif")
    assert one.count() == 2


def pages_of(path):
    blob = Blob(path)
    return blob, T.directories(blob)


def level_image(path, level=0):
    s = open_slide(path)
    v, blob = s.levels[level], Blob(path)
    out = C.white(v.cols * s.tile_w, v.rows * s.tile_h)
    for i in range(v.cols * v.rows):
        C.paste(out, C.decode_jpeg(v.prefix + blob.read(int(v.offset[i]), int(v.length[i])) if not blob.read(int(v.offset[i]), 2) == b"\xff\xd8" else blob.read(int(v.offset[i]), int(v.length[i]))), i % v.cols * s.tile_w, i // v.cols * s.tile_h)
    return out


def test_convert(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    got = {os.path.basename(r.path): r for r in convert(spark, folder, out, quality=90).collect()}
    assert {k: v.state for k, v in got.items()} == {"a.tif": "Done", "b.sdpc": "Done", "c.kfb": "Done", "d.NDPI": "Done", "e.mrxs": "Done", "bad.csp": "Failed"}
    assert sorted(os.listdir(out)) == [f"{c}.svs" for c in "abcde"]
    for name, image in (("a", K.picture(150, 100)), ("b", K.picture(200, 120)), ("d", K.picture(128, 64))):
        os.rename(f"{out}/{name}.svs", f"{out}/{name}.tif")
        s = open_slide(f"{out}/{name}.tif")
        assert (s.width, s.height) == image.shape[1::-1] and s.tile_w % 16 == 0 and s.tile_h % 16 == 0
        whole = level_image(f"{out}/{name}.tif")
        assert np.abs(whole[: s.height, : s.width].astype(int) - image).mean() < 6
    b = open_slide(f"{out}/b.tif")
    assert (b.tile_w, b.tile_h) == (112, 80) and (level_image(f"{out}/b.tif")[:, 224:] > 240).all()
    os.rename(f"{out}/c.svs", f"{out}/c.tif")
    whole = level_image(f"{out}/c.tif")  # the later of overlapping tiles shows
    assert np.abs(whole[10:74, 60:100].astype(int) - K.picture(40, 64, 1)).mean() < 8 and (whole[80:, :] > 240).all()
    os.rename(f"{out}/e.svs", f"{out}/e.tif")
    whole = level_image(f"{out}/e.tif")
    assert np.abs(whole[:40, 60:120].astype(int) - K.picture(64, 48, 1)[:40, :60]).mean() < 8
    _, dirs = pages_of(f"{out}/a.tif")
    assert [d.scalar(T.WIDTH) for d in dirs] == [150, 60, 75, 40] and [bool(d.numbers(T.TILE_OFFSETS).size) for d in dirs] == [True, False, True, False]
    assert dirs[0].raw(T.DESCRIPTION).startswith(b"Aperio") and b"AppMag = 20|MPP = " in dirs[0].raw(T.DESCRIPTION)
    assert dirs[2].scalar(T.SUBFILE) == 1 and dirs[0].rational(T.X_RESOLUTION) == pytest.approx(3780, rel=1e-3)
    assert not glob.glob(f"{out}/*.tmp")


def test_skip_and_overwrite(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    one = f"{folder}/one/a.tif"
    assert convert(spark, one, out).collect()[0].state == "Done"
    before = os.stat(f"{out}/a.svs").st_mtime_ns
    assert convert(spark, one, out).collect()[0].state == "Skipped" and os.stat(f"{out}/a.svs").st_mtime_ns == before
    assert convert(spark, one, out, overwrite=True).collect()[0].state == "Done" and os.stat(f"{out}/a.svs").st_mtime_ns != before
    with pytest.raises(ValueError):
        check_quality(101)


def test_a_fault_leaves_nothing_of_its_slide(spark, tmp_path):
    d, out = f"{tmp_path}/in", f"{tmp_path}/out"
    K.sdpc(f"{d}/h.dyqx", [K.picture(64, 64)], (32, 32), [], K.picture(32, 24), compression=4)
    K.tiff(f"{d}/ok.tif", [K.picture(64, 64)])
    got = {os.path.basename(r.path): r for r in convert(spark, d, out).collect()}
    assert got["h.dyqx"].state == "Failed" and "HEVC" in got["h.dyqx"].message and got["ok.tif"].state == "Done"
    assert os.listdir(out) == ["ok.svs"]


def test_big_directory():
    page = {"width": 10, "height": 10, "tile_w": 16, "tile_h": 16, "reduced": False, "resolution": 2.5, "description": "text", "offsets": [1 << 33, 5], "counts": [7, 8], "tables": b"tables"}
    data = directory(page_fields(page, True), 16, True, True)
    path = "/tmp/slidemill-big.tif"
    K.write(path, b"II" + (43).to_bytes(2, "little") + (8).to_bytes(4, "little") + (16).to_bytes(8, "little") + data)
    d = T.directories(Blob(path))[0]
    assert d.numbers(T.TILE_OFFSETS).tolist() == [1 << 33, 5] and d.rational(T.X_RESOLUTION) == 2.5 and d.raw(T.TABLES) == b"tables"
    os.remove(path)


def test_equal_stems_and_a_damaged_slide(spark, tmp_path):
    """Numbered names that collide with another slide's own keep all outputs apart; a damaged slide costs only itself."""
    d, out = f"{tmp_path}/in", f"{tmp_path}/out"
    K.csp(f"{d}/s.csp", [[(0, 0, K.picture(32, 16))]], [])
    K.kfb(f"{d}/s.kfb", (40, 60), 32, [(0, 0, 0, K.picture(32, 32))], [None, None, None])
    K.tiff(f"{d}/s_2.tif", [K.picture(48, 32)])
    K.write(f"{d}/bad.kfb", b"KFB")
    got = {os.path.basename(r.path): r for r in convert(spark, d, out).collect()}
    assert {k: v.state for k, v in got.items()} == {"s.csp": "Done", "s.kfb": "Done", "s_2.tif": "Done", "bad.kfb": "Failed"}
    assert sorted(os.listdir(out)) == ["s.svs", "s_2.svs", "s_2_2.svs"] and len({r.output for r in got.values() if r.output}) == 3


def test_folders_are_kept_and_one_output_is_named(spark, folder, tmp_path):
    out = f"{tmp_path}/out"
    got = {os.path.basename(r.path): r.output for r in convert(spark, f"{folder}/two", out, mirror=True).collect()}
    assert got == {"b.sdpc": f"{out}/b.svs", "c.kfb": f"{out}/deep/c.svs"} and os.path.exists(f"{out}/deep/c.svs")
    assert [tuple(r)[1:3] for r in convert(spark, f"{folder}/one/a.tif", output=f"{out}/x/named.svs").collect()] == [(f"{out}/x/named.svs", "Done")]
    assert os.path.exists(f"{out}/x/named.svs")
    with pytest.raises(ValueError, match="one input"):
        convert(spark, f"{folder}/two", output=f"{out}/y.svs")


def test_sink_leaves_out_what_cannot_be_written(spark, tmp_path):
    """An output whose rows lack a slot fails by itself where failures are told, and ends the write where not."""
    from slidemill.sources.svs_sink import SCHEMA, write_svs

    S.register(spark)
    data = bytearray(C.encode_jpeg(K.picture(16, 16), 80))
    rows = []
    for name, slots in (("good", (0, 1)), ("bad", (1,)), ("fine", (0, 1))):
        o = f"{tmp_path}/{name}.svs"
        rows += [(o, 0, -1, 32, 16, 16, 16, False, 1.0, "d", None, None), *((o, 0, s, None, None, None, None, None, None, None, None, data) for s in slots)]
    df = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(Exception, match="lacks slot"):
        write_svs(df, 1)
    assert os.listdir(tmp_path) == []
    write_svs(df, 1, failures=f"{tmp_path}/told/f.json")
    assert sorted(os.listdir(tmp_path)) == ["fine.svs", "good.svs", "told"]
    assert "bad.svs" in open(f"{tmp_path}/told/f.json").read()


def test_one_parse_gives_every_relation(spark, folder):
    S.register(spark)
    whole = S.read_slides(spark, folder, "all")
    for r in ("slides", "levels", "tiles", "images", "files", "errors"):
        names = S.columns_of(r)
        alone = S.read_slides(spark, folder, r, mode="permissive").select(*names)
        assert sorted(map(str, whole.where(F.col("relation") == r).select(*names).collect())) == sorted(map(str, alone.collect()))
