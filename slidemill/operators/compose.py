"""Composition of output tiles from the tiles that show in them, and their encoding."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemill.functions import codec
from slidemill.functions.bytes import is_420
from slidemill.operators.geometry import ceil_div, merge_factor
from slidemill.sources.formats.model import Blob


class Files:
    """Reads ranges of a slide's address space; the handles last used stay open."""

    MOST = 64

    def __init__(self):
        self.open: dict[str, Blob] = {}

    def read(self, files, offset: int, length: int) -> bytes:
        if not length:
            return b""
        file = max((f for f in files if f["base"] <= offset), key=lambda f: f["base"])  # the last that begins at or before
        return self.read_of(file["file"], offset - file["base"], length)

    def read_of(self, name: str, at: int, length: int) -> bytes:
        """A range of one file."""
        blob = self.open.pop(name, None) or Blob(name)
        self.open[name] = blob  # last in order
        if len(self.open) > self.MOST:
            self.open.pop(next(iter(self.open))).close()
        return blob.read(at, length, "tile")

    def close(self) -> None:
        for blob in self.open.values():
            blob.close()


def decode_tile(data: bytes, compression: str, width: int, height: int) -> np.ndarray:
    if compression == "jpeg":
        return codec.decode_jpeg(data)
    return hevc_tile(data, width, height)


@cache
def hevc_context():
    """The worker's one HEVC decoder; needs PyAV, which is optional."""
    try:
        import av
    except ImportError as e:
        raise ValueError("HEVC tiles need the PyAV package on the executors") from e
    return av.Packet, av.CodecContext.create("hevc", "r")


def hevc_tile(data: bytes, width: int, height: int) -> np.ndarray:
    """One HEVC packet as pixels, padded white."""
    packet, context = hevc_context()
    frames = [*context.decode(packet(data)), *context.decode(None)]
    context.flush_buffers()  # ready for the next tile
    if not frames:
        raise ValueError("an HEVC tile without a picture")
    out = codec.white(width, height)
    codec.paste(out, frames[0].to_ndarray(format="rgb24"), 0, 0)
    return out


def tiles_of(cell) -> list:
    return [] if cell["tiles"] is None else list(cell["tiles"])


def compose(cell, read) -> np.ndarray:
    """A white canvas with the cell's tiles in their order, so that later ones cover earlier ones."""
    out = codec.white(cell["out_w"], cell["out_h"])
    x0, y0 = cell["col"] * cell["out_w"], cell["row"] * cell["out_h"]
    for t in sorted(tiles_of(cell), key=lambda t: t["slot"]):
        if not (t["offset"] > 0 and t["length"] > 0):
            continue
        image = decode_tile(cell["prefix"] + read(t["offset"], t["length"]) + cell["suffix"], cell["compression"], cell["tile_w"], cell["tile_h"])
        if t["x"] is None:
            codec.paste(out, image, t["at_x"], t["at_y"])
            continue
        left, top = max(x0, t["x"]), max(y0, t["y"])
        sx, sy = left - t["x"] + t["src_x"], top - t["y"] + t["src_y"]
        codec.paste(out, image, left - x0, top - y0, sx, sy, t["width"] - (left - t["x"]), t["height"] - (top - t["y"]))
    return out


def encode_cell(cell, read) -> bytes:
    """A whole inner tile at the source's quality is kept, made 4:2:0 if it isn't; all else is composed."""
    tiles = tiles_of(cell)
    if cell["keep"] and len(tiles) == 1 and tiles[0]["offset"] > 0 and tiles[0]["length"] > 0:
        data = read(tiles[0]["offset"], tiles[0]["length"])
        return data if is_420(data) else codec.transcode_420(data, cell["quality"])
    return codec.encode_tile(compose(cell, read), cell["quality"])


def _encode(batches):
    files = Files()
    try:
        for batch in batches:
            rows = batch.to_pylist()
            data, errors = [], []
            for cell in rows:
                try:
                    data.append(encode_cell(cell, lambda o, n, c=cell: files.read(c["files"], o, n)))
                    errors.append(None)
                except (ValueError, OSError) as e:  # one slide's fault is not another's
                    data.append(None)
                    errors.append(f"{cell['path']}: {e}")
            keep = [batch.column(c) for c in ("path", "level", "slot")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(data, pa.binary()), pa.array(errors, pa.string())], names=["path", "level", "slot", "data", "error"])
    finally:
        files.close()


def output_grid(slides: DataFrame, levels: DataFrame) -> DataFrame:
    """Each level's output tile size (a multiple of 16) and grid."""
    own = levels.join(slides.select("path", "tile_w", "tile_h", "compression", F.col("quality").alias("source_quality"), "mpp", "app_mag"), "path")
    pitch = {c: F.when(F.col(f"pitch_{c}") > 0, F.col(f"pitch_{c}")).otherwise(F.col(f"tile_{c}")) for c in "wh"}
    out = own.withColumns({"pitch_w": pitch["w"], "pitch_h": pitch["h"], "merge_cols": merge_factor(pitch["w"]), "merge_rows": merge_factor(pitch["h"])})
    return out.withColumns({"out_w": F.col("pitch_w") * F.col("merge_cols"), "out_h": F.col("pitch_h") * F.col("merge_rows"), "out_cols": ceil_div(F.col("cols"), F.col("merge_cols")), "out_rows": ceil_div(F.col("rows"), F.col("merge_rows"))})


def cells_of(grid: DataFrame, tiles: DataFrame) -> DataFrame:
    """Every output cell with the tiles that show in it: grid tiles by their slot, positioned ones by overlap."""
    t = tiles.join(grid.select("path", "level", "cols", "rows", "pitch_w", "pitch_h", "merge_cols", "merge_rows", "out_w", "out_h", "out_cols", "out_rows"), ["path", "level"])
    row, col = F.expr("slot div cols"), F.col("slot") % F.col("cols")
    flat = t.where("x IS NULL").withColumns({"row": F.floor(row / F.col("merge_rows")).cast("long"), "col": F.floor(col / F.col("merge_cols")).cast("long"), "at_x": col % F.col("merge_cols") * F.col("pitch_w"), "at_y": row % F.col("merge_rows") * F.col("pitch_h")})
    reach = lambda at, size, out, n: F.sequence(F.least(F.expr(f"{at} div {out}"), F.col(n) - 1), F.least(F.expr(f"({at} + greatest({size}, 1) - 1) div {out}"), F.col(n) - 1))
    placed = t.where("x IS NOT NULL").withColumn("row", F.explode(reach("y", "height", "out_h", "out_rows"))).withColumn("col", F.explode(reach("x", "width", "out_w", "out_cols"))).withColumns({"at_x": F.lit(None).cast("long"), "at_y": F.lit(None).cast("long")})
    names = ["slot", "offset", "length", "x", "y", "width", "height", "src_x", "src_y", "at_x", "at_y"]
    per_cell = flat.unionByName(placed).groupBy("path", "level", "row", "col").agg(F.collect_list(F.struct(*names)).alias("tiles"))
    every = grid.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("out_rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("out_cols") - 1)))
    return every.join(per_cell, ["path", "level", "row", "col"], "left").withColumn("slot", F.col("row") * F.col("out_cols") + F.col("col"))


def encode_cells(cells: DataFrame, files: DataFrame, quality: int | None) -> DataFrame:
    """(path, level, slot, data, error) of all output tiles."""
    want = F.lit(quality).cast("int") if quality else F.col("source_quality").cast("int")
    inner = (F.col("row") + 1 < F.col("rows")) & (F.col("col") + 1 < F.col("cols"))
    plain = (F.length("prefix") == 0) & (F.length("suffix") == 0) & ~F.col("positioned") & (F.col("merge_cols") == 1) & (F.col("merge_rows") == 1) & (F.col("compression") == "jpeg")
    backing = files.groupBy("path").agg(F.collect_list(F.struct("file", "base")).alias("files"))
    ready = cells.withColumns({"quality": want, "keep": plain & inner & (want == F.col("source_quality"))}).join(backing, "path")
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["path", "level", "slot", "row", "col", "out_w", "out_h", "tile_w", "tile_h", "prefix", "suffix", "compression", "quality", "keep", "tiles", "files"]
    return ready.select(*columns).repartition(n, "path", "level", "slot").mapInArrow(_encode, "path string, level int, slot long, data binary, error string")


def decode_strips(strips: list[bytes], tables: bytes, width: int, height: int) -> np.ndarray:
    """An embedded image of one blob, or of strips with shared tables under each other, cut to its declared size."""
    pieces = [codec.decode_image(codec.join_tables(tables, s) if tables else s) for s in strips if s]
    return codec.trim(codec.stack(pieces) if len(pieces) != 1 else pieces[0], width, height)


def encode_images(images: DataFrame, files: DataFrame, thumbnail_size: int = 1024) -> DataFrame:
    """Embedded images as one-strip JPEGs: (path, ord, kind, width, height, data, error)."""
    backing = files.groupBy("path").agg(F.collect_list(F.struct("file", "base")).alias("files"))

    def run(frames):
        opened = Files()
        try:
            for pdf in frames:
                out = []
                for m in pdf.to_dict("records"):
                    try:
                        parts = [opened.read(m["files"], s["offset"], s["length"]) for s in m["strips"]]
                        image = decode_strips(parts, bytes(m["tables"] or b""), m["width"], m["height"])
                        image = codec.thumbnail(image, thumbnail_size) if m["kind"] == "thumbnail" else image
                        out.append((m["path"], m["ord"], m["kind"], image.shape[1], image.shape[0], codec.encode_jpeg(image, int(m["quality"])), None))
                    except (ValueError, OSError) as e:
                        out.append((m["path"], m["ord"], m["kind"], 0, 0, None, f"{m['path']}: {m['kind']}: {e}"))
                yield pd.DataFrame(out, columns=["path", "ord", "kind", "width", "height", "data", "error"])
        finally:
            opened.close()

    return images.join(backing, "path").mapInPandas(run, "path string, ord int, kind string, width long, height long, data binary, error string")


def render_thumbnails(cells: DataFrame, files: DataFrame, size: int = 1024) -> DataFrame:
    """A thumbnail of the slides among ``cells``, which are those of one small level each.

    The level is at most some 2048 pixels wide, so its cells may meet in one task.
    """
    backing = files.groupBy("path").agg(F.collect_list(F.struct("file", "base")).alias("files"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        opened, rows = Files(), pdf.to_dict("records")
        try:
            whole = codec.white(int(rows[0]["width"]), int(rows[0]["height"]))
            for cell in rows:
                codec.paste(whole, compose(cell, lambda o, n, c=cell: opened.read(c["files"], o, n)), cell["col"] * cell["out_w"], cell["row"] * cell["out_h"])
            image = codec.thumbnail(whole, size)
            return pd.DataFrame([(rows[0]["path"], image.shape[1], image.shape[0], codec.encode_jpeg(image, int(rows[0]["source_quality"])), None)], columns=["path", "width", "height", "data", "error"])
        except (ValueError, OSError) as e:
            return pd.DataFrame([(rows[0]["path"], 0, 0, None, str(e))], columns=["path", "width", "height", "data", "error"])
        finally:
            opened.close()

    return cells.join(backing, "path").groupBy("path").applyInPandas(run, "path string, width long, height long, data binary, error string")
