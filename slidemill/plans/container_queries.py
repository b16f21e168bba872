"""Queries that write a container of each format for each row of a table, and read them by the slide source.

Every tile and embedded image is of one grey that the row's key, the level and the slot give, so the
SQL knows what each decoded byte range has to show.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from slidemill.functions import codec
from slidemill.operators import compose
from slidemill.plans import relations as R
from slidemill.plans.convert import convert
from slidemill.session import local_path, materialise, scratch_path, ship_package
from slidemill.sources import samples, slide_source
from slidemill.sources.formats import tiff
from slidemill.sources.formats.model import Blob, SlideError

FORMATS = ("tiff", "dmetrix", "sdpc", "kfb", "csp", "bkio", "ndpi", "mrxs")
KEY = r"s(\d+)\.[a-zA-Z]+$"


def writers(partitions: int, cores: int) -> int:
    """Tasks that write containers: some for each core, since the start of one costs as much as a hundred containers."""
    return min(partitions, max(32, 4 * cores))


def written(spark, keys, formats=FORMATS, cut: bool = False, spread: bool = False) -> str:
    """The folder in which each key's containers stand; with ``cut`` those of every fourth key end early.

    With ``spread`` each task has a folder of its own, since tasks wait for each other to add files to one.
    """
    slide_source.register(spark)
    folder = scratch_path(spark, "containers")
    base = local_path(folder)
    if base is None:
        raise ValueError("containers are written to a mounted folder")

    def run(batches):
        own = f"{base}/{TaskContext.get().partitionId()}" if spread else base
        for batch in batches:
            for k in batch.column(0).to_pylist():
                for f in formats:
                    path = samples.numbered(f, k, f"{own}/{f}")
                    if cut and k % 4 == 0:
                        samples.cut_short(path)
            yield batch

    tasks = writers(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # a key is one task's alone
    keys.select(F.col(keys.columns[0]).cast("long").alias("k")).repartition(tasks, "k").mapInArrow(run, "k long").write.format("noop").mode("overwrite").save()
    return folder


def _key():
    return F.regexp_extract("path", KEY, 1).cast("long")


def _parsed(spark, folder: str, *relations: str, faults: bool = False, **options) -> dict:
    """Relations of the slides of a folder, by one parse of each; a slide that can't be read fails, unless ``faults`` are wanted."""
    wanted = [*relations, "errors"]
    all_rows = slide_source.read_slides(spark, folder, "all", **options).where(F.col("relation").isin(wanted))
    names = ["relation", *dict.fromkeys(c for r in wanted for c in slide_source.columns_of(r))]
    rows = materialise(all_rows.select(*names), "parsed")
    out = {r: rows.where(F.col("relation") == r).select(*slide_source.columns_of(r)) for r in wanted}
    if not faults and (bad := out["errors"].head()):
        raise SlideError(f"{bad.path}: {bad.message}")
    return out


def _by_slide(rows):
    """Rows dealt to tasks by slide and in its order, so that a task opens each file once."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "path").sortWithinPartitions("path")


def _scan(spark, folder: str, relation: str):
    """One relation of the slides of a folder, by one parse of each; its rows of a slide stay together."""
    return materialise(slide_source.read_slides(spark, folder, relation), relation)


PLACE = ("x", "y", "w", "h", "src_x", "src_y")
SEEN = {"s_suppkey": "long"} | {c: t for c, t in slide_source.types_of("pyramid").items() if c not in ("path", "prefix", "suffix", "files", "first") and not t.startswith("array")} | dict.fromkeys(("slot", *PLACE), "long") | {"least": "int", "most": "int"}
#: Rows that a batch of tiles has at about.
TILES = 10_000


def _tiles_of(batch) -> dict:
    """The tiles of runs, one row each, and one for a run of none; with the least and greatest value of what shows."""
    get = lambda c: batch.column(batch.schema.get_field_index(c))
    n = get("length").value_lengths().to_numpy()
    rows = np.maximum(n, 1)
    of, start = np.repeat(np.arange(len(n)), rows), np.cumsum(rows) - rows
    tile = np.repeat(n, rows) > 0
    slot = np.arange(len(of)) - np.repeat(start - get("first").to_numpy(), rows)
    placed = np.repeat(get("x").is_valid().to_numpy(zero_copy_only=False), rows) & tile
    out = {"slot": pa.array(slot, mask=~tile)}
    for c in PLACE:
        full = np.zeros(len(of), np.int64)
        full[placed] = get(c).flatten().to_numpy()
        out[c] = pa.array(full, mask=~placed)
    return out | {c: get(c).take(pa.array(of)) for c in SEEN if c in batch.schema.names and c not in out}


@lru_cache(codec.MEMO_SIZE)
def _small_span(data: bytes, x: int, y: int, w: int | None, h: int | None) -> tuple[int, int]:
    image = codec.decode_jpeg(data)
    if w is not None:
        image = image[y : y + h, x : x + w]
    return int(image.min()), int(image.max())


def span(data: bytes, x: int = 0, y: int = 0, w: int | None = None, h: int | None = None) -> tuple[int, int]:
    """(least, greatest) value of a part of a JPEG; of equal small ones it is taken once a worker, as they are decoded once."""
    return (_small_span if len(data) <= codec.MEMO_BYTES else _small_span.__wrapped__)(data, x, y, w, h)


def _shown(batch, opened):
    """(least, greatest) value of each tile's part that shows, in the order of ``_tiles_of``."""
    get = lambda c: batch.column(batch.schema.get_field_index(c))
    flat = lambda c: get(c).flatten().to_numpy(zero_copy_only=False).tolist()
    ends, names = np.cumsum(get("files").value_lengths().to_numpy()).tolist(), get("files").flatten().to_pylist()
    tiles, places = zip(*map(flat, ("file", "offset", "length")), strict=True), zip(*map(flat, ("src_x", "src_y", "w", "h")), strict=True)
    for n, first, prefix, suffix, placed in zip(get("length").value_lengths().to_pylist(), [0, *ends[:-1]], get("prefix").to_pylist(), get("suffix").to_pylist(), get("x").is_valid().to_pylist(), strict=True):
        if not n:
            yield None, None
        for f, at, size in islice(tiles, n):
            x, y, w, h = next(places) if placed else (0, 0, None, None)
            if size <= 0:
                yield None, None
                continue
            yield span(prefix + opened.read_of(names[first + f], at, size) + suffix, x, y, w, h)


def _seen(batches):
    """A row for each tile of the runs."""
    opened = compose.Files()
    try:
        for whole in batches:
            n = np.maximum(whole.column(whole.schema.get_field_index("length")).value_lengths().to_numpy(), 1)
            ends = np.flatnonzero(np.diff(np.cumsum(n) // TILES, append=-1)) + 1
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                batch = whole.slice(a, b - a)
                least, most = zip(*_shown(batch, opened), strict=True)
                out = _tiles_of(batch) | {"least": pa.array(least, pa.int32()), "most": pa.array(most, pa.int32())}
                yield pa.RecordBatch.from_arrays([out[c] for c in SEEN], names=list(SEEN))
    finally:
        opened.close()


def tiles_read(spark, sf_dir, form: str):
    """A row for each tile of each level, and for levels without tiles; with what level and slide declare."""
    folder = written(spark, R.table(spark, sf_dir, "supplier").select("s_suppkey"), (form,), spread=True)
    runs = _scan(spark, folder, "pyramid").withColumn("s_suppkey", _key()).drop("path")
    return runs.mapInArrow(_seen, ", ".join(f"{c} {t}" for c, t in SEEN.items()))


def _tiles_query(form: str):
    def query(spark, sf_dir):
        return tiles_read(spark, sf_dir, form)

    query.__name__ = f"container_{form}"
    query.__doc__ = f"Levels and tiles of {form} containers, down to their pixels."
    return query


def container_images(spark, sf_dir):
    """Embedded images of all formats: kind, declared size, and what they show."""
    folder = written(spark, R.table(spark, sf_dir, "supplier").select("s_suppkey"), spread=True)
    names = ["path", "ord", "kind", "width", "height"]

    def run(batches):
        opened = compose.Files()
        try:
            for batch in batches:
                out = []
                for m in batch.to_pylist():
                    image = compose.decode_strips([opened.read_of(s["file"], s["offset"], s["length"]) for s in m["strips"]], m["tables"] or b"", m["width"], m["height"])
                    out.append({"w": image.shape[1], "h": image.shape[0], "least": int(image.min()), "most": int(image.max())})
                seen = [pa.array([o[c] for o in out], t) for c, t in (("w", pa.int64()), ("h", pa.int64()), ("least", pa.int32()), ("most", pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *seen], names=[*names, "w", "h", "least", "most"])
        finally:
            opened.close()

    found = _scan(spark, folder, "pictures").mapInArrow(run, "path string, ord int, kind string, width long, height long, w long, h long, least int, most int")
    return found.select(F.regexp_extract("path", "([a-z]+)/[^/]+$", 1).alias("format"), _key().alias("s_suppkey"), "ord", "kind", "width", "height", "w", "h", "least", "most")


def container_errors(spark, sf_dir):
    """Which containers can't be read, where every fourth key's end early."""
    folder = written(spark, R.table(spark, sf_dir, "supplier").select("s_suppkey"), cut=True, spread=True)
    told = F.coalesce(F.length("message") > 0, F.lit(False))
    return _scan(spark, folder, "states").select(F.regexp_extract("path", "([a-z]+)/[^/]+$", 1).alias("folder"), _key().alias("s_suppkey"), "format", told.alias("failed"))


def container_files(spark, sf_dir):
    """Backing files: a slide's own, or the data files of its folder; and the tiles of one level, which the source leaves out all others of."""
    folder = written(spark, R.table(spark, sf_dir, "supplier").select("s_suppkey"), ("mrxs", "tiff"))
    read = _parsed(spark, folder, "files", "tiles", level=1)
    n = read["tiles"].where("level = 1").groupBy("path").agg(F.count("*").alias("tiles_1"))
    return read["files"].join(n, "path").select(_key().alias("s_suppkey"), F.regexp_extract("file", "([^/]+)$", 1).alias("file"), "base", (F.col("length") > 0).alias("sized"), "tiles_1")


PAGES = "output string, page int, width long, height long, tile_w long, tile_h long, tiles long, reduced long, text string, least int, most int"


def _pages(batches):
    """The directories of written files, and the range of a page's first tile or strip."""
    for pdf in batches:
        out = []
        for path in pdf["output"]:
            blob = Blob(path)
            try:
                for i, d in enumerate(tiff.directories(blob)):
                    tiled = d.ranges(tiff.TILE_OFFSETS, tiff.TILE_COUNTS) if tiff.TILE_OFFSETS in d.fields else []
                    at, n = (tiled or d.ranges(tiff.STRIP_OFFSETS, tiff.STRIP_COUNTS))[0]
                    data, tables = blob.read(at, n), d.raw(tiff.TABLES)
                    image = codec.decode_jpeg(codec.join_tables(tables, data) if tables else data)[:8, :8]
                    text = d.raw(tiff.DESCRIPTION).rstrip(b"\0").decode().partition("\n")[2] if tiled and i == 0 else None
                    out.append((path, i, d.scalar(tiff.WIDTH), d.scalar(tiff.HEIGHT), d.scalar(tiff.TILE_WIDTH) if tiled else None, d.scalar(tiff.TILE_HEIGHT) if tiled else None, len(tiled), d.scalar(tiff.SUBFILE) if tiled else None, text, int(image.min()), int(image.max())))
            finally:
                blob.close()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PAGES.split(", ")]).astype({"tile_w": "Int64", "tile_h": "Int64", "reduced": "Int64"})


def convert_states(spark, sf_dir):
    """What becomes of a folder of slides of every format and damaged ones: state and output below the folder."""
    folder = written(spark, R.table(spark, sf_dir, "nation").select("n_nationkey"), ("sdpc", "tiff", "csp", "kfb"), cut=True)
    out = scratch_path(spark, "converted")
    done = convert(spark, folder, out, 80, mirror=True)
    key = F.regexp_extract("path", KEY, 1).cast("long").alias("n_nationkey")
    return done.select(F.regexp_extract("path", "([a-z]+)/[^/]+$", 1).alias("folder"), key, "state", F.regexp_replace("output", f"^{local_path(out)}/|^{out}/", "").alias("output"))


def convert_pages(spark, sf_dir):
    """The pages of converted slides: pyramid, thumbnail, embedded images."""
    ship_package(spark)
    folder = written(spark, R.table(spark, sf_dir, "nation").select("n_nationkey"), ("sdpc",))
    out = scratch_path(spark, "converted")
    done = convert(spark, folder, out, 80).where("state = 'Done'").select("output")
    pages = done.mapInPandas(_pages, PAGES)
    return pages.select(F.regexp_extract("output", KEY, 1).cast("long").alias("n_nationkey"), *[c for c in pages.columns if c != "output"])


QUERIES = [*map(_tiles_query, FORMATS), container_images, container_errors, container_files, convert_states, convert_pages]

# SQL

_GREY = lambda level, slot: f"CAST((k * 7 + {level} * 31 + ({slot}) * 13) % 200 + 20 AS INTEGER)"
_N = "CAST(NULL AS BIGINT)"


def _two_levels(cols: str, rows: str, cols1: str, rows1: str) -> str:
    """Grid tiles of two levels."""
    return f"""t AS (SELECT k, 0 AS level, slot, {_N} AS x, {_N} AS y, {_N} AS w, {_N} AS h, {_N} AS src_x, {_N} AS src_y, {_GREY(0, "slot")} AS g FROM p, LATERAL (SELECT unnest(generate_series(0, ({cols}) * ({rows}) - 1)) AS slot)
 UNION ALL SELECT k, 1, slot, NULL, NULL, NULL, NULL, NULL, NULL, {_GREY(1, "slot")} FROM p, LATERAL (SELECT unnest(generate_series(0, ({cols1}) * ({rows1}) - 1)) AS slot))"""


def _sql(shape: str, levels: str, tiles: str, slide: str) -> str:
    """``shape`` gives what follows from the key, ``levels`` the levels (level, level_w, ...), ``slide`` the slide's own."""
    return f"""WITH s AS (SELECT s_suppkey AS k FROM supplier), p AS (SELECT *, {shape} FROM s),
lv AS ({levels}), {tiles},
sl AS (SELECT k, {slide} FROM p)
SELECT k AS s_suppkey, CAST(level AS INTEGER) AS level, level_w, level_h, CAST(downsample AS DOUBLE) AS downsample, cols, rows, pitch_w, pitch_h, slot, x, y, w, h, src_x, src_y, g AS least, g AS most,
 slide_w, slide_h, tile_w, tile_h, CAST(mpp AS DOUBLE) AS mpp, CAST(app_mag AS DOUBLE) AS app_mag, CAST(quality AS INTEGER) AS quality, compression, CAST(levels AS INTEGER) AS levels
FROM lv LEFT JOIN t USING (k, level) JOIN sl USING (k)"""


def _pyramid(*levels: str) -> str:
    """Each level as 'width, height, downsample, cols, rows, pitch_w, pitch_h'."""
    names = ("level_w", "level_h", "downsample", "cols", "rows", "pitch_w", "pitch_h")
    return " UNION ALL ".join(f"SELECT k, {i} AS level, " + ", ".join(f"{v.strip()} AS {n}" for n, v in zip(names, level.split(","), strict=True)) + " FROM p" for i, level in enumerate(levels))


def _slide(w, h, tile_w, tile_h, mpp, mag, quality, levels) -> str:
    return f"{w} AS slide_w, {h} AS slide_h, {tile_w} AS tile_w, {tile_h} AS tile_h, {mpp} AS mpp, {mag} AS app_mag, {quality} AS quality, 'jpeg' AS compression, {levels} AS levels"


_HALVES = "2 * (k % 2 + 1) AS c, 2 * (k % 3 + 1) AS r"
_IMAGES = [
    *(("tiff", *x) for x in ((0, "label", 32, 16, 32, 16), (1, "macro", 32, 32, 32, 32))),
    *(("dmetrix", *x) for x in ((0, "label", 0, 0, 9, 13), (1, "macro", 0, 0, 11, 8))),
    *(("sdpc", *x) for x in ((0, "label", 0, 0, 16, 16), (1, "macro", 0, 0, 32, 16), (2, "thumbnail", 24, 16, 24, 16))),
    *(("kfb", *x) for x in ((0, "macro", 0, 0, 32, 16), (1, "label", 0, 0, 16, 16), (2, "thumbnail", 24, 16, 24, 16))),
    *(("csp", *x) for x in ((0, "label", 0, 0, 16, 16), (1, "macro", 0, 0, 48, 32))),
    *(("bkio", *x) for x in ((0, "label", 0, 0, 16, 16), (1, "macro", 0, 0, 32, 16))),
    ("ndpi", 0, "macro", 32, 16, 32, 16),
    ("mrxs", 0, "label", 0, 0, 16, 24),
]
_SHIFT = "CASE WHEN k % 3 = 0 THEN 0 ELSE k % 3 END"
_LOST = "(k % 3 > 0 AND k % 5 = 0 AND c = 5)"

SQL = {
    "container_tiff": _sql(
        "k % 3 + 1 AS c, k % 2 + 1 AS r, (k % 3 + 2) // 2 AS c1, (k % 2 + 2) // 2 AS r1",
        _pyramid("c * 16, r * 16, 1, c, r, 0, 0", "c1 * 16, r1 * 16, CAST(c AS DOUBLE) / c1, c1, r1, 0, 0"),
        _two_levels("c", "r", "c1", "r1"),
        _slide("c * 16", "r * 16", 16, 16, "CAST(10000 AS DOUBLE) / 3780", 20, 75, 2),
    ),
    "container_dmetrix": _sql(
        "16 * (k % 3 + 2) - k % 5 AS w0, 16 * (k % 2 + 1) + k % 4 AS h0, (16 * (k % 3 + 2) - k % 5 + 1) // 2 AS w1, (16 * (k % 2 + 1) + k % 4 + 1) // 2 AS h1",
        _pyramid("w0, h0, 1, (w0 + 15) // 16, (h0 + 15) // 16, 0, 0", "w1, h1, 2, (w1 + 15) // 16, (h1 + 15) // 16, 0, 0"),
        _two_levels("(w0 + 15) // 16", "(h0 + 15) // 16", "(w1 + 15) // 16", "(h1 + 15) // 16"),
        _slide("w0", "h0", 16, 16, "(CAST(0.25 AS DOUBLE) + CAST(0.26 AS DOUBLE)) / 2", 20, 90, 2),
    ),
    "container_sdpc": _sql(
        _HALVES,
        _pyramid("c * 32, r * 16, 1, c, r, 0, 0", "c * 16, r * 8, 2, c // 2, r // 2, 0, 0"),
        _two_levels("c", "r", "c // 2", "r // 2"),
        _slide("c * 32", "r * 16", 32, 16, 0.25, 20, 75, 2),
    ),
    "container_kfb": _sql(
        "100 + k % 50 AS w0, 90 AS h0",
        "SELECT k, l AS level, greatest(w0 >> l, 1) AS level_w, greatest(h0 >> l, 1) AS level_h, 1 << l AS downsample, (greatest(w0 >> l, 1) + 63) // 64 AS cols, (greatest(h0 >> l, 1) + 63) // 64 AS rows, 0 AS pitch_w, 0 AS pitch_h FROM p, LATERAL (SELECT unnest(generate_series(0, CASE WHEN w0 > 128 THEN 8 ELSE 7 END)) AS l)",
        f"""t AS (SELECT k, 0 AS level, i AS slot, i * 20 AS x, i % 2 * 10 AS y, 16 + i % 2 * 16 AS w, CAST(16 AS BIGINT) AS h, CAST(0 AS BIGINT) AS src_x, CAST(0 AS BIGINT) AS src_y, {_GREY(0, "i")} AS g FROM p, LATERAL (SELECT unnest(generate_series(0, k % 4)) AS i)
 UNION ALL SELECT k, 1, 0, 5, 7, 16, 16, 0, 0, {_GREY(1, 0)} FROM p)""",
        _slide("w0", "h0", 64, 64, 0.25, 40, 75, "CASE WHEN w0 > 128 THEN 9 ELSE 8 END"),
    ),
    "container_csp": _sql(
        "greatest(256 * (k % 3) + 32, 116) AS w0",
        _pyramid("w0, 46, 1, (w0 + 255) // 256, 1, 0, 0", "32, 16, w0 / CAST(32 AS DOUBLE), 1, 1, 0, 0"),
        f"""t AS (SELECT k, 0 AS level, slot, {_N} AS x, {_N} AS y, {_N} AS w, {_N} AS h, {_N} AS src_x, {_N} AS src_y, CASE WHEN k % 3 = 2 AND slot = 1 THEN NULL ELSE {_GREY(0, "slot")} END AS g FROM p, LATERAL (SELECT unnest(generate_series(0, k % 3)) AS slot)
 UNION ALL SELECT k, 1, 0, NULL, NULL, NULL, NULL, NULL, NULL, {_GREY(1, 0)} FROM p)""",
        _slide("w0", 46, 256, 256, 0.5, 20, 75, 2),
    ),
    "container_bkio": _sql(
        _HALVES,
        _pyramid("c * 16, r * 16, 1, c, r, 0, 0", "c * 8, r * 8, 2, c // 2, r // 2, 0, 0"),
        _two_levels("c", "r", "c // 2", "r // 2"),
        _slide("c * 16", "r * 16", 16, 16, 0.5, 20, 80, 2),
    ),
    "container_ndpi": _sql(
        "k % 3 + 1 AS c, k % 2 + 1 AS r",
        _pyramid("c * 32, r * 16, 1, c, r, 32, 16", "c * 16, r * 8, 2, (c * 16 + 31) // 32, (r * 8 + 15) // 16, 0, 0"),
        f"""t AS (SELECT k, 0 AS level, slot, {_N} AS x, {_N} AS y, {_N} AS w, {_N} AS h, {_N} AS src_x, {_N} AS src_y, {_GREY(0, "slot")} AS g FROM p, LATERAL (SELECT unnest(generate_series(0, c * r - 1)) AS slot)
 UNION ALL SELECT k, 1, 0, 0, 0, c * 16, r * 8, 0, 0, {_GREY(1, 0)} FROM p)""",
        _slide("c * 32", "r * 16", 32, 16, 0.25, 20, 75, 2),
    ),
    "container_mrxs": _sql(
        "1 AS one",
        _pyramid("52, 28, 1, 1, 1, 0, 0", "26, 14, 2, 1, 1, 0, 0"),
        f"""cam AS (SELECT k, c, c % 4 * 12 + {_SHIFT} AS cx, c // 4 * 12 AS cy, {_GREY(0, "c")} AS g FROM p, generate_series(0, 7) AS q(c) WHERE NOT {_LOST}),
sub AS (SELECT *, c % 4 // 2 * 4 + c // 4 * 2 + c % 2 AS ord FROM cam),
t AS (SELECT k, 0 AS level, row_number() OVER (PARTITION BY k ORDER BY c) - 1 AS slot, cx AS x, cy AS y, CAST(16 AS BIGINT) AS w, CAST(16 AS BIGINT) AS h, CAST(0 AS BIGINT) AS src_x, CAST(0 AS BIGINT) AS src_y, g FROM cam
 UNION ALL SELECT k, 1, row_number() OVER (PARTITION BY k ORDER BY ord) - 1, (cx + 1) // 2, (cy + 1) // 2, 8, 8, c % 2 * 8, c // 4 * 8, g FROM sub)""",
        _slide(52, 28, 256, 256, "(CAST(0.25 AS DOUBLE) + CAST(0.27 AS DOUBLE)) / 2", 20, 75, 2),
    ),
    "container_images": "WITH i AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', {o}, '{kind}', {dw}, {dh}, {w}, {h})" for f, o, kind, dw, dh, w, h in _IMAGES) + f""") AS v(format, ord, kind, width, height, w, h)), s AS (SELECT s_suppkey AS k FROM supplier)
SELECT format, k AS s_suppkey, ord, kind, width, height, w, h, {_GREY(9, "ord")} AS least, {_GREY(9, "ord")} AS most FROM s, i""",
    "container_errors": "SELECT f AS folder, s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE f END AS format, s_suppkey % 4 = 0 AS failed FROM supplier, (VALUES " + ", ".join(f"('{f}')" for f in FORMATS) + ") AS v(f)",
    "container_files": """SELECT s_suppkey, 'Data0000.dat' AS file, 0 AS base, true AS sized, CASE WHEN s_suppkey % 3 > 0 AND s_suppkey % 5 = 0 THEN 7 ELSE 8 END AS tiles_1 FROM supplier
UNION ALL SELECT s_suppkey, 's' || s_suppkey || '.tif', 0, NULL, ((s_suppkey % 3 + 2) // 2) * ((s_suppkey % 2 + 2) // 2) FROM supplier""",
    "convert_states": "SELECT f AS folder, n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'Failed' ELSE 'Done' END AS state, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE f || '/s' || n_nationkey || '.svs' END AS output FROM nation, (VALUES ('sdpc'), ('tiff'), ('csp'), ('kfb')) AS v(f)",
    "convert_pages": rf"""WITH p AS (SELECT n_nationkey AS k, 2 * (n_nationkey % 2 + 1) AS c, 2 * (n_nationkey % 3 + 1) AS r FROM nation),
a AS (SELECT k, 0 AS page, c * 32 AS width, r * 16 AS height, 32 AS tile_w, 16 AS tile_h, c * r AS tiles, 0 AS reduced, printf('%dx%d [0,0 %dx%d] (32x16) JPEG/RGB Q=80|AppMag = 20|MPP = 0.250000', c * 32, r * 16, c * 32, r * 16) AS text, {_GREY(0, 0)} AS g FROM p
 UNION ALL SELECT k, 1, 24, 16, NULL, NULL, 0, NULL, NULL, {_GREY(9, 2)} FROM p
 UNION ALL SELECT k, 2, c * 16, r * 8, 32, 16, c * r // 4, 1, NULL, {_GREY(1, 0)} FROM p
 UNION ALL SELECT k, 3, 16, 16, NULL, NULL, 0, NULL, NULL, {_GREY(9, 0)} FROM p
 UNION ALL SELECT k, 4, 32, 16, NULL, NULL, 0, NULL, NULL, {_GREY(9, 1)} FROM p)
SELECT k AS n_nationkey, CAST(page AS INTEGER) AS page, width, height, tile_w, tile_h, tiles, reduced, text, g AS least, g AS most FROM a""",
}
