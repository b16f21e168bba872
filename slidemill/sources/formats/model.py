"""What a container reader gives: metadata and byte ranges, never pixels."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import cache

import numpy as np

HOLE = (0, 0)
#: A mounted file of at most so many bytes is read at once, since each read of a range costs more than its bytes.
WHOLE = 1 << 16


class SlideError(ValueError):
    """A container that can't be read."""


@cache
def mounted():
    """The one file system of plain paths."""
    from pyarrow import fs

    return fs.LocalFileSystem()


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path)
    return mounted(), path


def small_file(path: str) -> bytes | None:
    """All bytes of a small file, None of a larger one."""
    with open(path, "rb", buffering=0) as f:
        size = os.fstat(f.fileno()).st_size
        return f.read(size) if size <= WHOLE else None


class Blob:
    """Random access to a file at a path or URI, in bounds."""

    def __init__(self, path: str):
        self.path = path
        self.system, self.inner = file_system(path)
        self.held = small_file(self.inner) if self.system is mounted() else None
        self.file = None if self.held is not None else self.system.open_input_file(self.inner)
        self.size = self.file.size() if self.file else len(self.held)

    def read(self, offset: int, length: int, what: str = "data") -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise SlideError(f"{self.path} ends within its {what}")
        return self.file.read_at(length, offset) if self.file else self.held[offset : offset + length]

    def record(self, offset: int, dtype: np.dtype, what: str = "record"):
        return np.frombuffer(self.read(offset, dtype.itemsize, what), dtype)[0]

    def records(self, offset: int, count: int, dtype: np.dtype, what: str = "records") -> np.ndarray:
        return np.frombuffer(self.read(offset, count * dtype.itemsize, what), dtype)

    def need(self, offset: int, length: int, what: str) -> tuple[int, int]:
        """The range, which has to be present and lie in the file."""
        if not (offset > 0 and length > 0 and offset < self.size and length <= self.size - offset):
            raise SlideError(f"{self.path}: a byte range of its {what} lies outside")
        return int(offset), int(length)

    def close(self) -> None:
        if self.file:
            self.file.close()


def record(*fields: tuple) -> np.dtype:
    """A packed little-endian record: (name, kind) each; a name of None is skipped bytes."""
    return np.dtype([(n or f"skip{i}", f"V{k}" if n is None else "<" + k) for i, (n, k) in enumerate(fields)])


@dataclass
class Level:
    width: int
    height: int
    downsample: float
    cols: int
    rows: int
    #: Columns of equal length: offset, length, and for positioned tiles x, y, width, height, src_x, src_y.
    offset: np.ndarray
    length: np.ndarray
    place: np.ndarray | None = None
    #: Own pitch of the level's tiles, or 0; bytes that stand before and after each tile's own.
    pitch: tuple[int, int] = (0, 0)
    prefix: bytes = b""
    suffix: bytes = b""


@dataclass
class Image:
    """An embedded image: one range, or strips with tables; a width of 0 isn't declared."""

    kind: str
    strips: list[tuple[int, int]]
    width: int = 0
    height: int = 0
    tables: bytes = b""


@dataclass
class Slide:
    path: str
    width: int
    height: int
    mpp: float
    app_mag: float
    quality: int
    tile_w: int
    tile_h: int
    levels: list[Level]
    images: list[Image] = field(default_factory=list)
    compression: str = "jpeg"
    #: Backing files (path, base, length) where tiles don't lie in the file itself.
    files: list[tuple[str, int, int]] = field(default_factory=list)


def grid(width: int, height: int, downsample: float, cols: int, rows: int, ranges, **more) -> Level:
    ranges = np.asarray(ranges, np.int64).reshape(-1, 2)
    return Level(int(width), int(height), float(downsample), int(cols), int(rows), ranges[:, 0].copy(), ranges[:, 1].copy(), **more)


def check_ranges(blob: Blob, offset: np.ndarray, length: np.ndarray, what: str) -> None:
    if not ((offset > 0) & (length > 0) & (offset < blob.size) & (length <= blob.size - offset)).all():
        raise SlideError(f"{blob.path}: a byte range of its {what} lies outside")


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)
