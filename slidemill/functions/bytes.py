"""Bytes: searching, little-endian fields, TIFF fields, JPEG segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType

#: TIFF field type -> bytes of an item (TIFF 6.0, and the 64-bit types of BigTIFF).
ITEM_SIZES = {1: 1, 2: 1, 6: 1, 7: 1, 3: 2, 8: 2, 4: 4, 9: 4, 11: 4, 5: 8, 10: 8, 12: 8, 16: 8, 17: 8, 18: 8}
#: JPEG markers of frame headers.
FRAME_MARKERS = (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)


def positions(data: bytes, needle: bytes) -> list[int]:
    """Every position of the needle, overlapping ones included; none of an empty needle."""
    out, at = [], data.find(needle) if needle else -1
    while at >= 0:
        out.append(at)
        at = data.find(needle, at + 1)
    return out


def find_all(data: Column, needle: bytes) -> Column:
    """Positions (bytes, from 0) of the needle."""

    @F.pandas_udf(ArrayType(LongType()))
    def found(column: pd.Series) -> pd.Series:
        return column.map(lambda b: positions(bytes(b or b""), needle))

    return found(data)


def find_first(data: Column, needle: bytes) -> Column:
    """The first position, or null."""

    @F.pandas_udf(LongType())
    def found(column: pd.Series) -> pd.Series:
        at = column.map(lambda b: bytes(b or b"").find(needle) if needle else -1)
        return at.where(at >= 0).astype("Int64")

    return found(data)


def _fields(dtype: np.dtype, at: int, column: str):
    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index(column)
            rows = batch.column(place).to_pylist()
            ok = [b is not None and len(b) >= at + dtype.itemsize for b in rows]
            found = np.frombuffer(b"".join(b[at : at + dtype.itemsize] if k else bytes(dtype.itemsize) for b, k in zip(rows, ok, strict=True)), dtype)
            mask = ~np.array(ok, bool)
            other = [batch.column(i) for i in range(batch.num_columns) if i != place]
            names = [n for n in batch.schema.names if n != column]
            yield pa.RecordBatch.from_arrays([*other, *(pa.array(np.ascontiguousarray(found[n]).astype(_wide(found[n].dtype)), mask=mask) for n in dtype.names)], names=[*names, *dtype.names])

    return run


def _wide(kind: np.dtype):
    return np.float64 if kind.kind == "f" else np.int64


def little_endian(rows: DataFrame, column: str, dtype: np.dtype, at: int = 0) -> DataFrame:
    """The fields of a packed little-endian record at a byte of ``column``, instead of it; null where it is cut short."""
    keep = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != column]
    own = [f"`{n}` {'double' if dtype[n].kind == 'f' else 'long'}" for n in dtype.names]
    return rows.mapInArrow(_fields(dtype, at, column), ", ".join(keep + own))


def item_size(kind: Column) -> Column:
    """Bytes of an item of a TIFF field type; null for unknown types."""
    out = F.lit(None).cast("int")
    for size in sorted(set(ITEM_SIZES.values())):
        out = F.when(kind.isin([k for k, s in ITEM_SIZES.items() if s == size]), size).otherwise(out)
    return out


def inline(kind: Column, count: Column, big: bool = False) -> Column:
    """Whether a field's payload stands in its entry."""
    return item_size(kind).cast("long") * count <= (8 if big else 4)


def xml_text(data: Column) -> Column:
    """Text of an XML section: as it is where it begins with ``<``, else from Base64 without white
    space and NULs; UTF-16 where the second byte is 0; without NULs around."""
    compact = F.regexp_replace(F.decode(data, "ISO-8859-1"), "[\\x00\\x09\\x0A\\x0C\\x0D\\x20]+", "")
    raw = F.when(F.substring(data, 1, 1) == F.lit(b"<"), data).otherwise(F.unbase64(compact))
    wide = (F.length(raw) >= 2) & (F.substring(raw, 2, 1) == F.lit(b"\x00"))
    return F.regexp_replace(F.when(wide, F.decode(raw, "UTF-16LE")).otherwise(F.decode(raw, "UTF-8")), "^\\x00+|\\x00+$", "")


def begins_image(data: Column) -> Column:
    """Whether the bytes begin with a JPEG's start marker."""
    return F.substring(data, 1, 2) == F.lit(b"\xff\xd8")


def splice(*parts: Column) -> Column:
    """Header, body and trailer as one."""
    return F.concat(*parts)


def merge_tables(t: Column, s: Column) -> Column:
    """JPEG tables less their end marker, then the strip less its start marker, ended once; the strip alone without tables."""
    end, start = F.lit(b"\xff\xd9"), F.lit(b"\xff\xd8")
    last = lambda b: F.substring(b, F.greatest(F.length(b) - 1, F.lit(1)), F.lit(2))
    head = F.when(last(t) == end, F.substring(t, F.lit(1), F.length(t) - 2)).otherwise(t)
    body = F.when(F.substring(s, 1, 2) == start, F.substring(s, F.lit(3), F.length(s))).otherwise(s)
    return F.when(F.length(t) == 0, s).otherwise(F.concat(head, body, F.when(last(s) == end, F.lit(b"")).otherwise(end)))


def segments(data: bytes):
    """(marker, start and end of its payload) of a JPEG's segments up to the scan; fill bytes are skipped."""
    at = 2
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no marker stands at byte {at} of the JPEG")
        while at + 1 < len(data) and data[at + 1] == 0xFF:
            at += 1
        if at + 1 >= len(data):
            raise ValueError("the JPEG ends within a segment")
        marker, at = data[at + 1], at + 2
        if marker in (0x01, 0xD8) or 0xD0 <= marker <= 0xD7:
            continue
        if marker == 0xD9:
            return
        size = int.from_bytes(data[at : at + 2], "big")
        if at + 2 > len(data) or size < 2:
            raise ValueError("the JPEG ends within a segment")
        yield marker, at + 2, at + size
        if marker == 0xDA:
            return
        at += size


def is_420(data: bytes) -> bool:
    """Whether a JPEG has three components, the first sampled twice as finely on both axes."""
    if data[:2] != b"\xff\xd8":
        return False
    try:
        for marker, start, end in segments(data):
            if marker in FRAME_MARKERS:
                return end - start >= 15 and end <= len(data) and data[start + 5] == 3 and (data[start + 7], data[start + 10], data[start + 13]) == (0x22, 0x11, 0x11)
    except (ValueError, IndexError):
        return False
    return False


@F.pandas_udf(BooleanType())
def jpeg_is_420(column: pd.Series) -> pd.Series:
    return column.map(lambda b: is_420(bytes(b or b"")))
