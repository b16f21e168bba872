"""The ``slide`` data source: containers as relations.

``spark.read.format("slide").option("relation", ...).load(path)`` reads a file, a folder (all supported
files below it) or a glob. Neighbouring small files share a partition, large ones have their own; only
indexes are read, never pixels. Filters on path, level and relation are applied in the source. Options: ``relation`` (slides, levels, tiles, images, files,
errors, or ``all`` for the rows of each by one parse of a file, or one of the joined relations: ``pyramid``, a row for
each run of a level's tiles, from slot ``first`` on, with what level and slide declare, and one for a level without tiles;
``pictures``, images with the file of each strip; ``states``, a row for each file, readable or not), ``mode`` (``failfast``, or ``permissive``:
files that can't be read are left to ``errors``), ``level`` (of levels and tiles that one alone, in ``all`` too),
and ``paths``, a JSON list of files in the path's stead.
"""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from slidemill.sources.formats.model import Slide, SlideError
from slidemill.sources.formats.open import extension_of, open_slide
from slidemill.sources.formats.registry import READERS

SCHEMAS = {
    "slides": "path string, format string, width long, height long, tile_w long, tile_h long, mpp double, app_mag double, quality int, compression string, levels int",
    "levels": "path string, level int, width long, height long, downsample double, cols long, rows long, pitch_w long, pitch_h long, prefix binary, suffix binary, positioned boolean",
    "tiles": "path string, level int, slot long, offset long, length long, x long, y long, width long, height long, src_x long, src_y long",
    "images": "path string, ord int, kind string, width long, height long, strips array<struct<offset: long, length: long>>, tables binary",
    "files": "path string, file string, base long, length long",
    "errors": "path string, message string",
}
#: Relation ``all``: the rows of every relation, by its name, over the columns of all; equal names are of one type.
COLUMNS = dict(c.split(" ", 1) for v in SCHEMAS.values() for c in re.split(r", (?=\w+ \w+)(?![^<]*>)", v))
PLAIN = tuple(SCHEMAS)
SCHEMAS["all"] = "relation string, " + ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<struct<offset: long, length: long>>": pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))}


#: Relations joined from what one parse of a slide gives, so that no shuffle has to; ``offset`` counts from the start
#: of the tile's file, which ``file`` gives the place of in ``files``. Numbers of tiles are lists, far less work than rows.
SCHEMAS |= {
    "pyramid": "path string, slide_w long, slide_h long, tile_w long, tile_h long, mpp double, app_mag double, quality int, compression string, levels int, level int, level_w long, level_h long, downsample double, cols long, rows long, pitch_w long, pitch_h long, prefix binary, suffix binary, files array<string>, first long, " + ", ".join(f"{c} array<long>" for c in ("file", "offset", "length", "x", "y", "w", "h", "src_x", "src_y")),
    "pictures": "path string, ord int, kind string, width long, height long, strips array<struct<file: string, offset: long, length: long>>, tables binary",
    "states": "path string, format string, message string",
}
ARROW |= {"array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
ARROW["array<struct<file: string, offset: long, length: long>>"] = pa.list_(pa.struct([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))


@cache
def types_of(relation: str) -> dict[str, str]:
    """Columns of a relation, and their types."""
    return dict(c.split(" ", 1) for c in re.split(r", (?=\w+ \w+)(?![^<]*>)", SCHEMAS[relation]))


def columns_of(relation: str) -> list[str]:
    return list(types_of(relation))


#: A partition's files: so many bytes and files at most, but no more than makes this many partitions of them all.
GROUP_BYTES, GROUP_FILES, LEAST_GROUPS = 256 << 20, 2048, 32
#: Rows of many slides make one batch from so many on; the tiles of a level go in runs of so many at most.
BATCH_ROWS, RUN = 10_000, 100_000


def list_files(path: str) -> list[str]:
    """Supported files: of a folder all below it, of a glob those that match, else the file itself; sorted."""
    return [p for p, _ in sized_files(path)]


def sized_files(path: str) -> list[tuple[str, int]]:
    """``list_files`` with their bytes."""
    from pyarrow import fs

    uri = "://" in path or path.startswith("file:")
    system, inner = fs.FileSystem.from_uri(path.partition("*")[0].rpartition("/")[0] + "/" if "*" in path and uri else path) if uri else (fs.LocalFileSystem(), path)
    head = path[: len(path) - len(inner)] if uri and path.endswith(inner) else ("file://" if path.startswith("file:") else "")
    if "*" in path:
        pattern = path.removeprefix(head) if head else (path if not uri else inner + path.partition("*")[0].rpartition("/")[2] + "*" + path.partition("*")[2])
        found = system.get_file_info(fs.FileSelector(pattern.partition("*")[0].rpartition("/")[0] or "/", recursive=True, allow_not_found=True))
        return sorted((head + f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.path, pattern) and extension_of(f.path) in READERS)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
        return sorted((head + f.path, f.size) for f in found if f.type == fs.FileType.File and extension_of(f.path) in READERS)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [(path, info.size)]


def grouped(files: list[tuple[str, int]]) -> list[list[str]]:
    """Runs of files that share a partition, since a task costs more than a small container's index."""
    most = max(1, min(GROUP_FILES, -(-len(files) // LEAST_GROUPS)))
    out, held = [], 0
    for path, size in files:
        if not out or len(out[-1]) == most or held + size > GROUP_BYTES:
            out.append([])
            held = 0
        out[-1].append(path)
        held += size
    return out


def level_rows(slide: Slide, only: int | None = None):
    for i, v in enumerate(slide.levels):
        if only is None or i == only:
            yield slide.path, i, v.width, v.height, v.downsample, v.cols, v.rows, *v.pitch, v.prefix, v.suffix, v.place is not None


def tile_runs(slide: Slide, only: int | None = None):
    """Runs of a slide's tiles (path, level's number, level, first and end of the slots); tiles are many, and go column by column."""
    for i, v in enumerate(slide.levels):
        if only is None or i == only:
            yield from ((slide.path, i, v, a, min(a + RUN, len(v.offset))) for a in range(0, len(v.offset), RUN))


def rows_of(slide: Slide, relation: str, level: int | None = None):
    """The rows of a slide in a relation, and of tiles the runs."""
    if relation == "slides":
        yield slide.path, READERS[extension_of(slide.path)], slide.width, slide.height, slide.tile_w, slide.tile_h, slide.mpp, slide.app_mag, slide.quality, slide.compression, len(slide.levels)
    elif relation == "levels":
        yield from level_rows(slide, level)
    elif relation == "tiles":
        yield from tile_runs(slide, level)
    elif relation == "images":
        for i, m in enumerate(slide.images):
            yield slide.path, i, m.kind, m.width, m.height, [{"offset": int(o), "length": int(n)} for o, n in m.strips], m.tables
    elif relation == "files":
        yield from ((slide.path, *f) for f in files_of(slide))
    elif relation == "pyramid":
        for i, v in enumerate(slide.levels):
            if level is None or i == level:
                yield from ((slide, i, v, a, min(a + BATCH_ROWS, len(v.offset))) for a in range(0, len(v.offset) or 1, BATCH_ROWS))
    elif relation == "pictures":
        names = [f for f, *_ in files_of(slide)]
        for i, m in enumerate(slide.images):
            of, at = placed_in(slide, np.array([o for o, _ in m.strips], np.int64))
            yield slide.path, i, m.kind, m.width, m.height, [{"file": names[k], "offset": o, "length": int(n)} for k, o, (_, n) in zip(of.tolist(), at.tolist(), m.strips, strict=True)], m.tables
    elif relation == "states":
        yield slide.path, READERS[extension_of(slide.path)], None


def files_of(slide: Slide) -> list[tuple]:
    return slide.files or [(slide.path, 0, None)]


def placed_in(slide: Slide, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of a slide's files each offset lies in (the last that begins at or before), and where there."""
    base = np.array([b for _, b, _ in files_of(slide)], np.int64)
    if len(base) == 1:
        return np.zeros(len(offset), np.int64), offset - base[0]
    by = np.argsort(base, kind="stable")
    of = by[np.maximum(np.searchsorted(base[by], offset, "right") - 1, 0)]
    return of, offset - base[of]


def lists(parts: list, held: np.ndarray | None = None) -> pa.ListArray:
    """A list of each part; null where not ``held``."""
    end = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    at = pa.array(end, pa.int32(), mask=None if held is None else ~np.append(held, True))
    return pa.ListArray.from_arrays(at, pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def pyramid_batch(runs: list) -> pa.RecordBatch:
    """Runs (slide, level's number, level, first and end of the slots), joined; the numbers of a run's tiles are lists."""
    declared, file, offset, length, place, none = [], [], [], [], [], np.zeros((0, 6), np.int64)
    for s, i, v, a, b in runs:
        declared.append((s.path, s.width, s.height, s.tile_w, s.tile_h, s.mpp, s.app_mag, s.quality, s.compression, len(s.levels), i, v.width, v.height, v.downsample, v.cols, v.rows, *v.pitch, v.prefix, v.suffix, [f for f, *_ in files_of(s)], a))
        of, at = placed_in(s, v.offset[a:b])
        file.append(of)
        offset.append(at)
        length.append(v.length[a:b])
        place.append(none if v.place is None else v.place[a:b])
    types = types_of("pyramid")
    placed = np.array([v.place is not None for _, _, v, _, _ in runs])
    columns = [pa.array(c, ARROW[t]) for c, t in zip(zip(*declared, strict=True), types.values(), strict=False)]
    columns += [*map(lists, (file, offset, length)), *(lists([x[:, k] for x in place], placed) for k in range(6))]
    return pa.RecordBatch.from_arrays(columns, names=list(types))


def tile_batch(runs: list) -> pa.RecordBatch:
    """The tiles of runs, of one slide or many."""
    size = np.array([b - a for *_, a, b in runs])
    of = np.repeat(np.arange(len(runs)), size)
    placed = np.array([v.place is not None for _, _, v, _, _ in runs])[of]
    place = np.concatenate([v.place[a:b] if v.place is not None else np.zeros((b - a, 6), np.int64) for _, _, v, a, b in runs])
    slot = np.arange(len(of)) - np.repeat(np.cumsum(size) - size - [a for *_, a, _ in runs], size)
    columns = [slot, *(np.concatenate([getattr(v, c)[a:b] for _, _, v, a, b in runs]) for c in ("offset", "length"))]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.string()).take(pa.array(of)), pa.array(np.array([r[1] for r in runs], np.int32)[of]), *map(pa.array, columns), *(pa.array(np.ascontiguousarray(place[:, k]), mask=~placed) for k in range(6))], names=columns_of("tiles"))


def batch_of(relation: str, rows: list) -> pa.RecordBatch:
    """Rows, or runs of tiles, as a batch."""
    if relation == "tiles":
        return tile_batch(rows)
    if relation == "pyramid":
        return pyramid_batch(rows)
    types = types_of(relation)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for t, c in zip(types.values(), zip(*rows, strict=True), strict=True)], names=list(types))


def wide(relation: str, batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of a relation as one of relation ``all``."""
    names, n = batch.schema.names, batch.num_rows
    own = [batch.column(names.index(c)) if c in names else pa.nulls(n, ARROW[t]) for c, t in COLUMNS.items()]
    return pa.RecordBatch.from_arrays([pa.array([relation] * n, pa.string()), *own], names=["relation", *COLUMNS])


class SlidePartition(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class SlideReader(DataSourceReader):
    def __init__(self, options: dict, relation: str):
        self.path, self.relation = options.get("path"), relation
        self.paths = json.loads(options["paths"]) if "paths" in options else None
        self.permissive = options.get("mode", "failfast").lower() == "permissive" or relation in ("errors", "states", "all")
        if not self.path and self.paths is None:
            raise ValueError("a path is needed")
        self.level = int(options["level"]) if "level" in options else None
        self.only: str | None = None
        self.relations: tuple[str, ...] = PLAIN

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("level",) and self.relation in ("levels", "tiles", "pyramid") and self.level in (None, f.value):
                self.level = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("path",) and self.only in (None, f.value):
                self.only = f.value
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("relation",) and self.relation == "all":
                wanted = f.value if isinstance(f, In) else (f.value,)
                self.relations = tuple(r for r in self.relations if r in wanted)
            else:
                yield f

    def partitions(self):
        files = sized_files(self.path) if self.paths is None else [(p, 0) for p in self.paths]
        return [SlidePartition(g) for g in grouped([f for f in files if self.only in (None, f[0])])]

    def read(self, partition: SlidePartition) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        many = 0
        for path in partition.paths:
            for relation, row in self.read_file(path):
                held.setdefault(relation, []).append(row)
                many += max(row[-1] - row[-2], 1) if relation in ("tiles", "pyramid") else 1
                if many >= BATCH_ROWS:
                    yield from self.batches(held)
                    held, many = {}, 0
        yield from self.batches(held)

    def batches(self, held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for relation, rows in held.items():
            batch = batch_of(relation, rows)
            yield wide(relation, batch) if self.relation == "all" else batch

    def read_file(self, path: str) -> Iterator:
        """(relation, row or run of tiles) of what is wanted of a file."""
        wanted = self.relations if self.relation == "all" else (self.relation,)
        try:
            slide = open_slide(path)
        except (SlideError, ValueError, OSError) as e:
            if not self.permissive:
                raise SlideError(f"{path}: {e}") from e
            if "errors" in wanted:
                yield "errors", (path, str(e))
            if "states" in wanted:
                yield "states", (path, None, str(e))
            return
        for relation in wanted:
            for row in rows_of(slide, relation, self.level):
                yield relation, row


class SlideSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "slide"

    def relation(self) -> str:
        found = self.options.get("relation", "slides").lower()
        if found not in SCHEMAS:
            raise ValueError(f"relation must be one of {', '.join(SCHEMAS)}")
        return found

    def schema(self) -> str:
        return SCHEMAS[self.relation()]

    def reader(self, schema: StructType) -> DataSourceReader:
        return SlideReader(dict(self.options), self.relation())


def register(spark) -> None:
    """Makes the ``slide`` source and the ``svs`` sink known to a session."""
    from slidemill.session import ship_package
    from slidemill.sources.svs_sink import SvsSink

    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SlideSource)
    spark.dataSource.register(SvsSink)


def read_slides(spark, path: str, relation: str = "slides", **options):
    return spark.read.format("slide").options(relation=relation, **options).load(path)
