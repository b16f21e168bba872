"""What keeps queries within their limits on larger tables."""

import numpy as np
import pyarrow as pa
import pytest

from slidemill.functions import codec
from slidemill.operators import compose
from slidemill.plans import container_queries, metadata_queries, pixel_queries, tile_queries
from slidemill.sources import samples, slide_source
from slidemill.sources.formats import model, tiff
from slidemill.sources.formats.model import SlideError
from slidemill.sources.formats.open import open_slide

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def default_threshold(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_quality_estimate_broadcasts_no_slides(spark, default_threshold):
    plan = plan_of(metadata_queries.quality_estimate(spark, SF))
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert joins and all("BuildRight" in line for line in joins)


def test_small_files_share_a_partition_and_large_ones_do_not():
    small = [(f"/s{i}.tif", 1000) for i in range(6000)]
    groups = slide_source.grouped(small)
    assert len(groups) <= 64 and [p for g in groups for p in g] == [p for p, _ in small]
    assert slide_source.grouped([(f"/s{i}.tif", 1 << 30) for i in range(200)]) == [[f"/s{i}.tif"] for i in range(200)]
    assert slide_source.grouped([]) == []
    reader = slide_source.SlideReader({"path": "/x", "paths": '["/a.tif", "/b.tif"]'}, "slides")
    assert [p.paths for p in reader.partitions()] == [["/a.tif"], ["/b.tif"]]


def test_slides_of_a_partition_keep_their_rows_and_faults(spark, tmp_path):
    for k in range(150):
        path = samples.numbered("tiff", k, f"{tmp_path}/tiff")
        if k == 70:
            samples.cut_short(path)
    slide_source.register(spark)
    rows = slide_source.read_slides(spark, str(tmp_path), "all")
    assert rows.rdd.getNumPartitions() <= 75
    counts = dict(rows.groupBy("relation").count().collect())
    assert (counts["slides"], counts["errors"], counts["images"]) == (149, 1, 298)
    some = rows.where("relation IN ('slides', 'errors')")
    assert some.count() == 150
    with pytest.raises(SlideError, match="s70.tif"):
        container_queries._parsed(spark, str(tmp_path), "slides")


def test_few_handles_stay_open(tmp_path):
    paths = [tmp_path / f"{i}" for i in range(200)]
    for i, p in enumerate(paths):
        p.write_bytes(bytes([0, i]))
    files = compose.Files()
    for _ in range(2):
        assert [files.read([{"file": str(p), "base": 0}], 1, 1)[0] for p in paths] == list(range(200))
        assert len(files.open) <= 64
    files.close()


@pytest.mark.parametrize("form", container_queries.FORMATS)
def test_containers_are_parsed_once(spark, form):
    plan = plan_of(container_queries.tiles_read(spark, SF, form))
    assert "BatchScan" not in plan and plan.count("MapInArrow") == 1


def test_small_pictures_are_coded_as_ever():
    image = np.random.default_rng(1).integers(0, 256, (20, 30, 3), np.uint8)
    data = codec.encode_jpeg(image, 90)
    assert data == codec.encode_ycbcr(codec.to_ycbcr(image), 90)
    first = codec.decode_jpeg(data)
    first[:] = 0  # a picture is its caller's own
    assert (codec.decode_jpeg(data) == codec.to_rgb(codec.decode_ycbcr(data))).all()


def test_tile_scan_deals_levels_to_all_tasks(spark):
    plan = plan_of(tile_queries.tile_scan_all(spark, SF))
    assert "REPARTITION_BY_NUM" in plan and "bround" not in plan


@pytest.mark.parametrize("query", [container_queries.container_images, container_queries.container_errors])
def test_all_formats_are_parsed_once(spark, query):
    assert "BatchScan" not in plan_of(query(spark, SF))


def test_files_and_one_level_come_by_one_parse(spark):
    assert "BatchScan" not in plan_of(container_queries.container_files(spark, SF))


def rows_read(reader, paths):
    batches = list(reader.read(slide_source.SlidePartition(paths)))
    return len(batches), sorted((tuple(map(str, r.values())) for b in batches for r in b.to_pylist()))


@pytest.mark.parametrize("relation", ["slides", "levels", "tiles", "images", "files", "all"])
def test_slides_share_batches(tmp_path, monkeypatch, relation):
    paths = [samples.numbered(f, k, f"{tmp_path}/{f}") for f in ("tiff", "kfb", "mrxs") for k in range(4)]
    options = {"path": str(tmp_path)}
    few, rows = rows_read(slide_source.SlideReader(options, relation), paths)
    assert few <= 5
    monkeypatch.setattr(slide_source, "BATCH_ROWS", 7)
    monkeypatch.setattr(slide_source, "RUN", 3)
    many, again = rows_read(slide_source.SlideReader(options, relation), paths)
    assert many > few and again == rows


def test_one_level_of_all_relations(tmp_path):
    paths = [samples.numbered("kfb", k, str(tmp_path)) for k in range(4)]
    read = lambda **o: [r for b in slide_source.SlideReader({"path": str(tmp_path), **o}, "all").read(slide_source.SlidePartition(paths)) for r in b.to_pylist()]
    one = read(level="1")
    assert [r for r in read() if r["relation"] not in ("levels", "tiles") or r["level"] == 1] == one
    assert sum(r["relation"] == "tiles" for r in one) == 4


def test_written_slides_are_parsed_once(spark):
    assert "BatchScan" not in plan_of(pixel_queries.svs_write_read(spark, SF))


def test_tables_of_a_quality_are_made_once(monkeypatch):
    rng = np.random.default_rng(2)
    codec.encode_jpeg(rng.integers(0, 256, (16, 32, 3), np.uint8), 83)
    monkeypatch.setattr(codec, "scaled_table", None)
    image = rng.integers(0, 256, (20, 30, 3), np.uint8)
    assert codec.decode_jpeg(codec.encode_jpeg(image, 83)).shape == image.shape


def test_intervals_are_cut_from_one_transform(monkeypatch):
    image = samples.picture(64, 32)
    whole = codec.decode_jpeg(codec.encode_jpeg(image, 90))
    monkeypatch.setattr(codec, "encode_ycbcr", None)
    data = samples.restart_jpeg(image, 2)
    assert data.count(b"\xff\xd0") == 1 and (codec.decode_jpeg(data) == whole).all()


@pytest.mark.parametrize("form", ["bkio", "csp", "dmetrix", "ndpi", "sdpc", "tiff"])
def test_levels_of_many_slides_are_one_batch(tmp_path, form):
    paths = [samples.numbered(form, k, str(tmp_path)) for k in range(20)]
    (batch,) = slide_source.SlideReader({"path": str(tmp_path)}, "levels").read(slide_source.SlidePartition(paths))
    assert batch.num_rows == sum(len(slide_source.open_slide(p).levels) for p in paths)


@pytest.mark.parametrize("relation", ["images", "slides"])
def test_all_formats_share_a_batch(tmp_path, relation):
    paths = [samples.numbered(f, 1, f"{tmp_path}/{f}") for f in container_queries.FORMATS]
    (batch,) = slide_source.SlideReader({"path": str(tmp_path)}, relation).read(slide_source.SlidePartition(paths))
    assert set(batch.column(0).to_pylist()) == set(paths)


def test_images_need_no_shuffle(spark):
    plan = plan_of(container_queries.container_images(spark, SF))
    assert "Exchange" not in plan and "Join" not in plan


def test_a_picture_names_the_file_of_each_strip(tmp_path):
    paths = [samples.numbered(f, 1, f"{tmp_path}/{f}") for f in ("mrxs", "tiff")]
    read = lambda r: [x for b in slide_source.SlideReader({"path": str(tmp_path)}, r).read(slide_source.SlidePartition(paths)) for x in b.to_pylist()]
    pictures = read("pictures")
    assert {s["file"].rpartition("/")[2] for m in pictures for s in m["strips"]} == {"Data0000.dat", "s1.tif"}
    assert [{**m, "strips": [{k: v for k, v in s.items() if k != "file"} for s in m["strips"]]} for m in pictures] == read("images")


def test_small_files_are_read_at_once_and_in_bounds(tmp_path):
    small, large = tmp_path / "small", tmp_path / "large"
    small.write_bytes(bytes(range(100)))
    large.write_bytes(bytes(model.WHOLE + 1))
    for path, size in ((small, 100), (large, model.WHOLE + 1)):
        blob = model.Blob(str(path))
        assert (blob.file is None) == (path == small) and blob.size == size and len(blob.read(size - 3, 3)) == 3
        with pytest.raises(SlideError):
            blob.read(size - 3, 4)
        blob.close()
    with pytest.raises(OSError):
        model.Blob(str(tmp_path / "none"))


def test_tasks_write_into_folders_of_their_own(spark):
    folder = container_queries.written(spark, spark.range(40).repartition(4), ("csp",), spread=True)
    files = slide_source.list_files(folder.removeprefix("file:"))
    assert len(files) == 40 and len({f.split("/")[-3] for f in files}) > 1


def test_errors_need_no_shuffle_and_have_every_file(spark, tmp_path):
    assert "Exchange" not in plan_of(container_queries.container_errors(spark, SF))
    paths = [samples.numbered("tiff", k, str(tmp_path)) for k in range(3)]
    samples.cut_short(paths[1])
    rows = [r for b in slide_source.SlideReader({"path": str(tmp_path)}, "states").read(slide_source.SlidePartition(paths)) for r in b.to_pylist()]
    assert [(r["path"], r["format"], bool(r["message"])) for r in rows] == [(paths[0], "tiff", False), (paths[1], None, True), (paths[2], "tiff", False)]


@pytest.mark.parametrize("form", ["bkio", "csp", "dmetrix", "ndpi", "sdpc", "tiff"])
def test_tiles_need_no_shuffle(spark, form):
    plan = plan_of(container_queries.tiles_read(spark, SF, form))
    assert "Exchange" not in plan and "Join" not in plan


def test_writing_tasks_follow_the_cores(spark, monkeypatch):
    assert [container_queries.writers(*x) for x in ((200, 6), (8, 8), (10_000, 100), (211, 6))] == [32, 8, 400, 32]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        folder = container_queries.written(spark, spark.range(400), ("csp",), spread=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    files = slide_source.list_files(folder.removeprefix("file:"))
    assert len(files) == 400 and 1 < len({f.split("/")[-3] for f in files}) <= 32


@pytest.mark.parametrize("form", ["bkio", "csp", "dmetrix", "sdpc"])
def test_equal_tiles_are_looked_at_once(tmp_path, monkeypatch, form):
    paths = [samples.numbered(form, k, str(tmp_path)) for k in range(0, 6000, 600)]  # same shape and greys
    container_queries._small_span.cache_clear()
    decode, seen = codec.decode_jpeg, []
    batches = [b.append_column("s_suppkey", pa.array(range(b.num_rows), pa.int64())) for b in slide_source.SlideReader({"path": str(tmp_path)}, "pyramid").read(slide_source.SlidePartition(paths))]
    monkeypatch.setattr(codec, "decode_jpeg", lambda d: seen.append(d) or decode(d))
    (out,) = container_queries._seen(batches)
    assert len(seen) == len(set(seen)) <= out.num_rows / 10
    assert out.column(out.schema.names.index("least")).to_pylist()[: out.num_rows // 10] == out.column(out.schema.names.index("most")).to_pylist()[-(out.num_rows // 10) :]
    image = samples.picture(40, 30)
    data, whole = codec.encode_jpeg(image, 90), decode(codec.encode_jpeg(image, 90))
    assert container_queries.span(data, 3, 4, 20, 10) == (whole[4:14, 3:23].min(), whole[4:14, 3:23].max())


@pytest.mark.parametrize("form", ["ndpi", "tiff"])
def test_a_directory_reads_its_numbers_once(tmp_path, monkeypatch, form):
    read, seen = tiff.Directory.payload, []
    monkeypatch.setattr(tiff.Directory, "payload", lambda d, tag: seen.append((id(d), tag)) or read(d, tag))
    open_slide(samples.numbered(form, 4, str(tmp_path)))
    numbers = [s for s in seen if s[1] not in (tiff.DESCRIPTION, tiff.TABLES, tiff.LENS)]
    assert len(numbers) == len(set(numbers))
