"""Queries of tile geometry, offsets and composition, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slidemill.functions import codec_columns as codec
from slidemill.operators import geometry as G
from slidemill.operators import lookup as L
from slidemill.plans import relations as R
from slidemill.session import ship_package

COLS, ROWS, PITCH = 16, 12, 256
WIDE = 1024  # the pitch of dense grids
FILE = 1 << 20

CELLS = f"""cells AS (SELECT slide_id, level, ordinal, length, cell_row, cell_col FROM tiles,
 LATERAL (SELECT unnest(generate_series(least(y // {PITCH}, {ROWS - 1}), least((y + greatest(h, 1) - 1) // {PITCH}, {ROWS - 1}))) AS cell_row),
 LATERAL (SELECT unnest(generate_series(least(x // {PITCH}, {COLS - 1}), least((x + greatest(w, 1) - 1) // {PITCH}, {COLS - 1}))) AS cell_col))"""


def _cells(spark, sf_dir):
    return G.assign_cells(R.tiles(spark, sf_dir), PITCH, COLS, ROWS).select("slide_id", "level", "ordinal", "length", "cell_row", "cell_col")


def cell_assign(spark, sf_dir):
    return _cells(spark, sf_dir).drop("length")


def cell_groups(spark, sf_dir):
    out = G.cell_groups(_cells(spark, sf_dir))
    return out.select("slide_id", "level", "cell_row", "cell_col", F.array_join(F.col("slots").cast("array<string>"), ",").alias("slots"))


def last_wins(spark, sf_dir):
    return G.last_wins(_cells(spark, sf_dir))


def first_wins_dense_grid(spark, sf_dir):
    return G.dense_grid(R.tiles(spark, sf_dir), WIDE)


def level_extent(spark, sf_dir):
    return G.extents(R.tiles(spark, sf_dir))


def level_islands(spark, sf_dir):
    """Records at a fixed stride make a level; the first level's extent gives the downsample of the others."""
    at = R.tiles(spark, sf_dir).select("slide_id", "w", (F.col("level") * 1000 + F.col("ordinal") * 58 + F.col("x") % 3).alias("position")).groupBy("slide_id", "position").agg(F.max("w").alias("w"))
    runs = G.islands(at, "slide_id", "position", 58).groupBy("slide_id", "run").agg(F.count("*").alias("n_records"), F.max("w").alias("width"))
    first = F.first("width").over(Window.partitionBy("slide_id").orderBy("run"))
    return runs.select("slide_id", F.col("run").cast("long").alias("run"), "n_records", "width", (first / F.col("width")).alias("downsample"))


def _level_lengths(spark, sf_dir):
    return R.tiles(spark, sf_dir).select("slide_id", "level", "ordinal", "length")


def tile_offsets(spark, sf_dir):
    """Offsets behind a table of 4-byte lengths at the level's start."""
    rows = _level_lengths(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("slide_id", "level"))
    return L.running_offsets(rows.withColumn("table", n * 4), ["slide_id", "level"], ["ordinal"], start=F.col("table")).select("slide_id", "level", "ordinal", "offset", "length")


def virtual_base(spark, sf_dir):
    """Backing files one after another in one address space."""
    rows = _level_lengths(spark, sf_dir).groupBy("slide_id", "level").agg(F.sum("length").alias("length"))
    return L.running_offsets(rows, ["slide_id"], ["level"]).select("slide_id", "level", F.col("offset").alias("base"), "length")


def _probes(spark, sf_dir):
    return R.tiles(spark, sf_dir).select("slide_id", "level", "ordinal", F.expr("(x * 7919 + y * 104729) % 400000").alias("at"))


def asof_source(spark, sf_dir):
    """The backing file of each address: the last that begins at or before it; null beyond the end."""
    bases = virtual_base(spark, sf_dir).select("slide_id", "base", F.col("level").alias("file"), F.col("length").alias("file_length"))
    found = L.asof(_probes(spark, sf_dir), bases, ["slide_id"], "at", "base")
    inside = F.col("at") < F.col("base") + F.col("file_length")
    return found.select("slide_id", "level", "ordinal", "at", *[F.when(inside, F.col(c)).alias(c) for c in ("file", "base")], (F.col("at") + 100 <= F.col("base") + F.col("file_length")).alias("whole"))


BASES = """sums AS (SELECT slide_id, level, sum(length) AS length FROM tiles GROUP BY ALL),
bases AS (SELECT slide_id, level, CAST(coalesce(sum(length) OVER (PARTITION BY slide_id ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base, CAST(length AS BIGINT) AS length FROM sums)"""


def _ranges(spark, sf_dir):
    return R.tiles(spark, sf_dir).select("slide_id", "level", "ordinal", (F.col("x") * F.col("y") % 1200000 - 1000).alias("offset"), F.when(F.col("x") % 11 == 0, 0).otherwise(F.col("length")).alias("length"))


def range_fits(spark, sf_dir):
    size = F.lit(FILE).cast("long")
    kept = L.kept_or_hole(F.col("offset"), F.col("length"), size)
    return _ranges(spark, sf_dir).select("slide_id", "level", "ordinal", ((F.col("offset") > 0) & (F.col("length") > 0)).alias("present"), L.fits(F.col("offset"), F.col("length"), size).alias("fits"), kept["offset"].alias("kept_offset"), kept["length"].alias("kept_length"))


def restart_intervals(spark, sf_dir):
    """Intervals of a strip between two-byte markers."""
    marks = R.tiles(spark, sf_dir).select("slide_id", (600 + F.col("x") * 8 + F.col("level")).alias("position")).distinct()
    out = L.between_markers(marks, "slide_id", "position", F.lit(600).cast("long"), F.lit(40000).cast("long"))
    return out.select("slide_id", F.col("unit").cast("long").alias("unit"), "from", (F.col("to") - F.col("from")).alias("length"))


def level_rank_area(spark, sf_dir):
    pages = R.levels(spark, sf_dir).select("slide_id", (6 - F.col("level")).cast("long").alias("page"), "width", "height")
    return G.rank_by_area(pages)


def kfb_pyramid(spark, sf_dir):
    return G.halving_pyramid(R.slides(spark, sf_dir).select("slide_id", "width", "height"), PITCH).select("slide_id", F.col("level").cast("long").alias("level"), "w", "h", "cols", "rows")


def kfb_level_from_id(spark, sf_dir):
    """Levels from tile ids: steps of 2^23 below the first one's id."""
    step = 8388608
    ids = R.tiles(spark, sf_dir).select("slide_id", "level", "ordinal", (F.lit(100 * step) - F.col("level") * step - F.when(F.col("x") % 50 == 0, 1).otherwise(0)).alias("tile_id"))
    base = F.first("tile_id").over(Window.partitionBy("slide_id").orderBy("level", "ordinal"))
    delta = base - F.col("tile_id")
    return ids.select("slide_id", "level", "ordinal", F.expr(f"tile_id div {step}").alias("id_step"), F.when((delta >= 0) & (delta % step == 0), F.floor(delta / step)).alias("found"))


def merge_pitch(spark, sf_dir):
    sizes = R.tiles(spark, sf_dir).select(F.col("w").alias("pw"), (F.col("h") + F.col("x") % 7).alias("ph")).distinct()
    m, n = G.merge_factor(F.col("pw")), G.merge_factor(F.col("ph"))
    return sizes.select("pw", "ph", m.alias("merge_cols"), n.alias("merge_rows"), (m * F.col("pw")).alias("out_w"), (n * F.col("ph")).alias("out_h"))


def retile_merge(spark, sf_dir):
    return G.retile(G.last_wins(_cells(spark, sf_dir)), 2, 3)


def mrxs_subtiles(spark, sf_dir):
    """Subtiles of stored images over cameras that level 0 has seen."""
    records = R.tiles(spark, sf_dir).where("level = 0").select("slide_id", "ordinal", F.expr("(y % 12) div 4 * 4 * 16 + (x % 16) div 4 * 4").alias("image_index"))
    subs = G.subtiles(records, 16, 12, 2, 4, 302.0, 252.0)
    active = R.tiles(spark, sf_dir).where("level = 1").select("slide_id", F.expr("y % 6 * 8 + x % 8").alias("camera")).distinct()
    return subs.join(active, ["slide_id", "camera"], "left_semi").select("slide_id", "ordinal", "xx", "yy", "camera", "src_x", "src_y")


def nominal_grid(spark, sf_dir):
    s = R.slides(spark, sf_dir).select("slide_id", (F.col("width") / 256).cast("long").alias("across"), F.col("kinds"))
    cams = s.withColumn("index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") * 2 - 1)))
    out = G.nominal_positions(cams, F.col("across"), F.lit(302.0), (1 + F.col("kinds")).cast("double"), F.lit(180.869565217392))
    return out.select("slide_id", "index", "pos_x", "pos_y")


def axis_extent(spark, sf_dir):
    s = R.slides(spark, sf_dir).select("slide_id", (F.col("width") / 256).cast("long").alias("n"), (F.col("kinds") + 1).alias("divisions"))
    each = s.withColumn("index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    part = G.axis_extent(F.col("index"), F.col("n"), F.lit(302).cast("long"), F.lit(180.869565217392), F.col("divisions"))
    return each.groupBy("slide_id", "n", "divisions").agg(F.sum(part).alias("extent"))


def downsample_check(spark, sf_dir):
    scale = (F.lit(1.0) / (F.col("ordinal") % 9 + 1) + F.when(F.col("x") % 10 == 0, 0.01).otherwise(0.0)).cast("float")
    out = R.tiles(spark, sf_dir).select("slide_id", "level", "ordinal", "w", G.downsample_of(scale).alias("downsample"))
    return out.select("slide_id", "level", "ordinal", "downsample", F.greatest(F.expr("w div downsample"), F.lit(1)).alias("width"))


def thumb_fit(spark, sf_dir):
    s = R.slides(spark, sf_dir).select("slide_id", (F.col("width") - F.col("slide_id") % 1777).alias("w"), (F.col("height") - F.col("slide_id") % 911).alias("h"))
    scale = G.fit_scale(F.col("w"), F.col("h"), 1024)
    return s.select("slide_id", G.scaled(F.col("w"), scale).alias("thumb_w"), G.scaled(F.col("h"), scale).alias("thumb_h"))


def fallback_level(spark, sf_dir):
    """The level a missing thumbnail is rendered from: the first reduced one of at most 2048 pixels, else the last."""
    lv = R.levels(spark, sf_dir)
    small = F.min(F.when((F.col("level") > 0) & (F.greatest("width", "height") <= 2048), F.col("level")))
    return lv.groupBy("slide_id").agg(F.coalesce(small, F.max("level")).alias("level"))


def _scan(lv):
    """Cells of each level in row-major order with their level-0 place, rounded half to even."""
    tasks = int(lv.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a level has far more cells than its row is wide
    scale = F.expr("shiftleft(1L, level)").cast("double")
    place = lambda c: F.rint((F.col(c) * 256).cast("double") * F.col("scale") * 0.7).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    by_row = lv.repartition(tasks).withColumn("scale", scale).withColumn("row", each("rows"))
    by_row = by_row.select("slide_id", "level", "cols", "scale", (F.col("row") * F.col("cols")).alias("first"), place("row").alias("at_y"))
    return by_row.withColumn("col", each("cols")).select("slide_id", "level", (F.col("first") + F.col("col")).alias("slot"), place("col").alias("at_x"), "at_y")


def tile_scan(spark, sf_dir):
    """The cells of every level of a slide for each supplier."""
    return _scan(R.levels_of(R.supplier_slides(spark, sf_dir)))


def tile_scan_all(spark, sf_dir):
    """The cells of every level of a slide for each order."""
    return _scan(R.levels(spark, sf_dir))


def passthrough_action(spark, sf_dir):
    """What happens to a grid tile: kept, transcoded, encoded anew as a hole, or composed."""
    t = R.tiles(spark, sf_dir)
    size = G.extents(t).select("slide_id", "level", G.ceil_div(F.col("width"), PITCH).alias("cols"), G.ceil_div(F.col("height"), PITCH).alias("rows"))
    col, row = F.expr(f"x div {PITCH}"), F.expr(f"y div {PITCH}")
    inner = (row + 1 < F.col("rows")) & (col + 1 < F.col("cols"))
    plain = (F.col("w") % 16 == 0) & (F.col("slide_id") % 3 != 0) & inner
    action = F.when(~plain, "compose").when(F.col("length") % 17 == 0, "encode").when(F.col("length") % 5 == 0, "transcode").otherwise("copy")
    return t.join(size, ["slide_id", "level"]).select("slide_id", "level", "ordinal", action.alias("action"))


def white_tile_memo(spark, sf_dir):
    """White tiles are encoded once for each geometry, of which there are few, and joined back to all tiles."""
    ship_package(spark)
    tiles = R.tiles(spark, sf_dir).select("slide_id", "level", "ordinal", F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), (F.col("length") % 4 == 0).alias("white"))
    once = tiles.where("white").select("w", "h", "white").distinct().select("*", codec.picture_range(codec.grey_jpeg(F.lit(255), "w", "h")).alias("i"))
    return tiles.join(once, ["w", "h", "white"], "left").select("slide_id", "level", "ordinal", F.col("i.width").alias("encoded_w"), F.col("i.height").alias("encoded_h"), F.col("i.least").alias("least"))


def slide_clip(spark, sf_dir):
    """Rectangles that a tile copies into each cell it overlaps: target place, source place, size."""
    t = G.assign_cells(R.tiles(spark, sf_dir), PITCH, COLS, ROWS)
    x0, y0 = F.col("cell_col") * PITCH, F.col("cell_row") * PITCH
    left, top = F.greatest(x0, F.col("x")), F.greatest(y0, F.col("y"))
    right, bottom = F.least(F.col("x") + F.col("w"), x0 + PITCH), F.least(F.col("y") + F.col("h"), y0 + PITCH)
    out = t.select("slide_id", "level", "ordinal", "cell_row", "cell_col", (left - x0).alias("left"), (top - y0).alias("top"), (left - F.col("x")).alias("src_x"), (top - F.col("y")).alias("src_y"), (right - left).alias("width"), (bottom - top).alias("height"))
    return out.where("width > 0 AND height > 0")


QUERIES = [cell_assign, cell_groups, last_wins, first_wins_dense_grid, level_extent, level_islands, tile_offsets, virtual_base, asof_source, range_fits, restart_intervals, level_rank_area, kfb_pyramid, kfb_level_from_id, merge_pitch, retile_merge, mrxs_subtiles, nominal_grid, axis_extent, downsample_check, thumb_fit, fallback_level, tile_scan, tile_scan_all, passthrough_action, white_tile_memo, slide_clip]

_EXTENTS = "ext AS (SELECT slide_id, level, max(x + w) AS width, max(y + h) AS height, count(*) AS n_tiles FROM tiles GROUP BY ALL)"

SQL = {
    "cell_assign": R.sql("tiles", f", {CELLS} SELECT slide_id, level, ordinal, cell_row, cell_col FROM cells"),
    "cell_groups": R.sql("tiles", f", {CELLS} SELECT slide_id, level, cell_row, cell_col, string_agg(CAST(ordinal AS VARCHAR), ',' ORDER BY ordinal) AS slots FROM cells GROUP BY ALL"),
    "last_wins": R.sql("tiles", f", {CELLS} SELECT slide_id, level, cell_row, cell_col, max(ordinal) AS ordinal, arg_max(length, ordinal) AS length FROM cells GROUP BY ALL"),
    "first_wins_dense_grid": R.sql(
        "tiles",
        f""", {_EXTENTS}, f AS (SELECT slide_id, level, y // {WIDE} AS cell_row, x // {WIDE} AS cell_col, arg_min(length, ordinal) AS length FROM tiles GROUP BY ALL),
g AS (SELECT slide_id, level, width, r AS cell_row, c AS cell_col FROM ext, LATERAL (SELECT unnest(generate_series(0, (height + {WIDE - 1}) // {WIDE} - 1)) AS r), LATERAL (SELECT unnest(generate_series(0, (width + {WIDE - 1}) // {WIDE} - 1)) AS c))
SELECT slide_id, level, cell_row * ((width + {WIDE - 1}) // {WIDE}) + cell_col AS slot, coalesce(length, 0) AS length FROM g LEFT JOIN f USING (slide_id, level, cell_row, cell_col)""",
    ),
    "level_extent": R.sql("tiles", f", {_EXTENTS} SELECT * FROM ext"),
    "level_islands": R.sql(
        "tiles",
        """, p AS (SELECT slide_id, level * 1000 + ordinal * 58 + x % 3 AS position, max(w) AS w FROM tiles GROUP BY ALL),
b AS (SELECT *, CASE WHEN position - lag(position) OVER (PARTITION BY slide_id ORDER BY position) = 58 THEN 0 ELSE 1 END AS brk FROM p),
r AS (SELECT *, sum(brk) OVER (PARTITION BY slide_id ORDER BY position ROWS UNBOUNDED PRECEDING) - 1 AS run FROM b),
s AS (SELECT slide_id, CAST(run AS BIGINT) AS run, count(*) AS n_records, max(w) AS width FROM r GROUP BY ALL)
SELECT *, first_value(width) OVER (PARTITION BY slide_id ORDER BY run) / width AS downsample FROM s""",
    ),
    "tile_offsets": R.sql(
        "tiles",
        " SELECT slide_id, level, ordinal, CAST(count(*) OVER (PARTITION BY slide_id, level) * 4 + coalesce(sum(length) OVER (PARTITION BY slide_id, level ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", length FROM tiles",
    ),
    "virtual_base": R.sql("tiles", f", {BASES} SELECT slide_id, level, base, length FROM bases"),
    "asof_source": R.sql(
        "tiles",
        f""", {BASES}, p AS (SELECT slide_id, level, ordinal, (x * 7919 + y * 104729) % 400000 AS at FROM tiles)
SELECT p.slide_id, p.level, p.ordinal, p.at, CASE WHEN p.at < b.base + b.length THEN b.level END AS file, CASE WHEN p.at < b.base + b.length THEN b.base END AS base, p.at + 100 <= b.base + b.length AS whole FROM p ASOF JOIN bases b ON p.slide_id = b.slide_id AND p.at >= b.base""",
    ),
    "range_fits": R.sql(
        "tiles",
        f""", r AS (SELECT slide_id, level, ordinal, (x * y) % 1200000 - 1000 AS o, CASE WHEN x % 11 = 0 THEN 0 ELSE length END AS l FROM tiles),
f AS (SELECT *, o > 0 AND l > 0 AND o < {FILE} AND l <= {FILE} - o AS fits FROM r)
SELECT slide_id, level, ordinal, o > 0 AND l > 0 AS present, fits, CASE WHEN fits THEN o ELSE 0 END AS kept_offset, CASE WHEN fits THEN l ELSE 0 END AS kept_length FROM f""",
    ),
    "restart_intervals": R.sql(
        "tiles",
        """, m AS (SELECT DISTINCT slide_id, 600 + x * 8 + level AS position FROM tiles),
u AS (SELECT slide_id, row_number() OVER w - 1 AS unit, coalesce(lag(position) OVER w + 2, 600) AS f, position AS t FROM m WINDOW w AS (PARTITION BY slide_id ORDER BY position)
 UNION ALL SELECT slide_id, count(*), max(position) + 2, 40000 FROM m GROUP BY slide_id)
SELECT slide_id, unit, f AS "from", t - f AS length FROM u""",
    ),
    "level_rank_area": R.sql("levels", ", p AS (SELECT slide_id, CAST(6 - level AS BIGINT) AS page, width, height FROM levels) SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY width * height DESC, page) - 1 AS level FROM p"),
    "kfb_pyramid": R.sql(
        "slides",
        """, l AS (SELECT slide_id, level, greatest(width // (1 << level), 1) AS w, greatest(height // (1 << level), 1) AS h
 FROM slides, LATERAL (SELECT unnest(generate_series(0, CAST(ceil(log2(greatest(width, height))) AS BIGINT))) AS level))
SELECT *, (w + 255) // 256 AS cols, (h + 255) // 256 AS rows FROM l""",
    ),
    "kfb_level_from_id": R.sql(
        "tiles",
        """, i AS (SELECT slide_id, level, ordinal, 100 * 8388608 - level * 8388608 - CASE WHEN x % 50 = 0 THEN 1 ELSE 0 END AS tile_id FROM tiles),
d AS (SELECT *, first_value(tile_id) OVER (PARTITION BY slide_id ORDER BY level, ordinal) - tile_id AS delta FROM i)
SELECT slide_id, level, ordinal, CAST(tile_id // 8388608 AS BIGINT) AS id_step, CAST(CASE WHEN delta >= 0 AND delta % 8388608 = 0 THEN delta // 8388608 END AS BIGINT) AS found FROM d""",
    ),
    "merge_pitch": R.sql(
        "tiles",
        ", s AS (SELECT DISTINCT w AS pw, h + x % 7 AS ph FROM tiles) SELECT pw, ph, 16 // gcd(pw, 16) AS merge_cols, 16 // gcd(ph, 16) AS merge_rows, 16 // gcd(pw, 16) * pw AS out_w, 16 // gcd(ph, 16) * ph AS out_h FROM s",
    ),
    "retile_merge": R.sql(
        "tiles",
        f", {CELLS}, g AS (SELECT slide_id, level, cell_row, cell_col, arg_max(length, ordinal) AS length FROM cells GROUP BY ALL) SELECT slide_id, level, cell_row // 2 AS out_row, cell_col // 3 AS out_col, count(*) AS parts, CAST(sum(length) AS BIGINT) AS bytes FROM g GROUP BY ALL",
    ),
    "mrxs_subtiles": R.sql(
        "tiles",
        """, rec AS (SELECT slide_id, ordinal, (y % 12) // 4 * 4 AS y0, (x % 16) // 4 * 4 AS x0 FROM tiles WHERE level = 0),
s AS (SELECT slide_id, ordinal, x0 + xi * 2 AS xx, y0 + yi * 2 AS yy, xi, yi FROM rec, generate_series(0, 1) a(xi), generate_series(0, 1) b(yi)),
c AS (SELECT *, (yy // 2) * 8 + xx // 2 AS camera FROM s WHERE xx < 16 AND yy < 12),
a AS (SELECT DISTINCT slide_id, (y % 6) * 8 + x % 8 AS camera FROM tiles WHERE level = 1)
SELECT slide_id, ordinal, xx, yy, camera, CAST(round(xi * 151.0) AS BIGINT) AS src_x, CAST(round(yi * 126.0) AS BIGINT) AS src_y FROM c WHERE EXISTS (SELECT 1 FROM a WHERE a.slide_id = c.slide_id AND a.camera = c.camera)""",
    ),
    "nominal_grid": R.sql(
        "slides",
        """, i AS (SELECT slide_id, width // 256 AS across, CAST(302.0 AS DOUBLE) * CAST(1 + kinds AS DOUBLE) - CAST(180.869565217392 AS DOUBLE) AS advance, idx FROM slides, LATERAL (SELECT unnest(generate_series(0, width // 256 * 2 - 1)) AS idx))
SELECT slide_id, idx AS "index", CAST(trunc((idx % across) * advance) AS BIGINT) AS pos_x, CAST(trunc((idx // across) * advance) AS BIGINT) AS pos_y FROM i""",
    ),
    "axis_extent": R.sql(
        "slides",
        """, i AS (SELECT slide_id, width // 256 AS n, kinds + 1 AS divisions, idx FROM slides, LATERAL (SELECT unnest(generate_series(0, width // 256 - 1)) AS idx))
SELECT slide_id, n, divisions, CAST(sum(CASE WHEN idx % divisions = divisions - 1 AND idx <> n - 1 THEN CAST(trunc(302 - CAST(180.869565217392 AS DOUBLE)) AS BIGINT) ELSE 302 END) AS BIGINT) AS extent FROM i GROUP BY ALL""",
    ),
    "downsample_check": R.sql(
        "tiles",
        """, s AS (SELECT slide_id, level, ordinal, w, CAST(CAST(1.0 AS DOUBLE) / (ordinal % 9 + 1) + CASE WHEN x % 10 = 0 THEN CAST(0.01 AS DOUBLE) ELSE 0 END AS FLOAT) AS scale FROM tiles),
v AS (SELECT *, CAST(round(CAST(CAST(1.0 AS FLOAT) / scale AS DOUBLE)) AS INTEGER) AS v FROM s),
d AS (SELECT slide_id, level, ordinal, w, CASE WHEN scale > 0 AND v > 0 AND abs(CAST(scale * CAST(v AS FLOAT) AS FLOAT) - CAST(1.0 AS FLOAT)) <= CAST(1e-5 AS FLOAT) THEN v END AS downsample FROM v)
SELECT slide_id, level, ordinal, downsample, greatest(w // downsample, 1) AS width FROM d""",
    ),
    "thumb_fit": R.sql(
        "slides",
        """, s AS (SELECT slide_id, width - slide_id % 1777 AS w, height - slide_id % 911 AS h FROM slides),
f AS (SELECT *, least(CAST(1024 AS FLOAT) / CAST(w AS FLOAT), CAST(1024 AS FLOAT) / CAST(h AS FLOAT), CAST(1 AS FLOAT)) AS scale FROM s)
SELECT slide_id, greatest(CAST(trunc(CAST(w AS FLOAT) * scale) AS INTEGER), 1) AS thumb_w, greatest(CAST(trunc(CAST(h AS FLOAT) * scale) AS INTEGER), 1) AS thumb_h FROM f""",
    ),
    "fallback_level": R.sql("levels", " SELECT slide_id, coalesce(min(level) FILTER (level > 0 AND greatest(width, height) <= 2048), max(level)) AS level FROM levels GROUP BY slide_id"),
    "tile_scan": R.sql(
        "supplier_levels",
        """ SELECT slide_id, level, r * cols + c AS slot, CAST(round_even(CAST(c * 256 AS DOUBLE) * pow(2.0, level) * CAST(0.7 AS DOUBLE), 0) AS BIGINT) AS at_x, CAST(round_even(CAST(r * 256 AS DOUBLE) * pow(2.0, level) * CAST(0.7 AS DOUBLE), 0) AS BIGINT) AS at_y
FROM supplier_levels, LATERAL (SELECT unnest(generate_series(0, rows - 1)) AS r), LATERAL (SELECT unnest(generate_series(0, cols - 1)) AS c)""",
    ),
    "passthrough_action": R.sql(
        "tiles",
        f""", {_EXTENTS} SELECT slide_id, level, ordinal, CASE WHEN NOT (t.w % 16 = 0 AND slide_id % 3 <> 0 AND y // {PITCH} + 1 < (height + {PITCH - 1}) // {PITCH} AND x // {PITCH} + 1 < (width + {PITCH - 1}) // {PITCH}) THEN 'compose'
 WHEN length % 17 = 0 THEN 'encode' WHEN length % 5 = 0 THEN 'transcode' ELSE 'copy' END AS action FROM tiles t JOIN ext USING (slide_id, level)""",
    ),
    "white_tile_memo": R.sql("tiles", " SELECT slide_id, level, ordinal, CASE WHEN length % 4 = 0 THEN CAST(w AS INTEGER) END AS encoded_w, CASE WHEN length % 4 = 0 THEN CAST(h AS INTEGER) END AS encoded_h, CASE WHEN length % 4 = 0 THEN 255 END AS least FROM tiles"),
    "slide_clip": R.sql(
        "tiles",
        f""", c AS (SELECT t.*, cell_row, cell_col FROM tiles t,
 LATERAL (SELECT unnest(generate_series(least(y // {PITCH}, {ROWS - 1}), least((y + greatest(h, 1) - 1) // {PITCH}, {ROWS - 1}))) AS cell_row),
 LATERAL (SELECT unnest(generate_series(least(x // {PITCH}, {COLS - 1}), least((x + greatest(w, 1) - 1) // {PITCH}, {COLS - 1}))) AS cell_col)),
e AS (SELECT *, cell_col * {PITCH} AS x0, cell_row * {PITCH} AS y0 FROM c),
k AS (SELECT *, greatest(x0, x) AS l, greatest(y0, y) AS t, least(x + w, x0 + {PITCH}) AS r, least(y + h, y0 + {PITCH}) AS b FROM e)
SELECT slide_id, level, ordinal, cell_row, cell_col, l - x0 AS "left", t - y0 AS top, l - x AS src_x, t - y AS src_y, r - l AS width, b - t AS height FROM k WHERE r > l AND b > t""",
    ),
}
