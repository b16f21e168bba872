"""The ``svs`` sink: pyramidal JPEG TIFFs, one file an output.

Rows (see ``SCHEMA``) come in partitions that each hold whole outputs, ordered by output, page and
slot. Slot -1 describes its page; further slots are its tiles or its one strip. Payloads are written
as they come, all directories after them, so nothing but offsets is held. A file grows under another
name; the commit moves it, an abort deletes it. Outputs of 4 GiB and more are BigTIFF, if option
``bigtiff`` is ``auto``; with ``never`` they fail. Option ``failures`` names a file: an output that can't
be written is then left out and told there (a JSON object of output and message a line), and all others
are written; without it the first fault ends the write.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from slidemill.session import local_path

SCHEMA = "output string, page int, slot long, width long, height long, tile_w long, tile_h long, reduced boolean, resolution double, description string, tables binary, data binary"
START, CLASSIC_LIMIT = 16, 1 << 32
SHORT, LONG, RATIONAL, ASCII, UNDEFINED, LONG8 = 3, 4, 5, 2, 7, 16
#: Black and white references of YCbCr as whole numbers over one.
REFERENCE = (0, 255, 128, 255, 128, 255)


def rational(value: float) -> bytes:
    """A value in thousandths, none below 0."""
    return struct.pack("<II", int(max(value, 0.0) * 1000 + 0.5), 1000)


def page_fields(page: dict, big: bool) -> list[tuple[int, int, int, bytes]]:
    """(tag, kind, count, payload) of a page's directory, in order of the tags."""
    number = (LONG8, "Q") if big else (LONG, "I")
    short = lambda *v: (SHORT, len(v), struct.pack(f"<{len(v)}H", *v))
    long = lambda *v: (LONG, len(v), struct.pack(f"<{len(v)}I", *v))
    where = lambda v: (number[0], len(v), struct.pack(f"<{len(v)}{number[1]}", *v))
    ratio = (RATIONAL, 1, rational(page["resolution"]))
    fields = {256: long(page["width"]), 257: long(page["height"]), 258: short(8, 8, 8), 259: short(7), 262: short(6), 274: short(1), 277: short(3), 282: ratio, 283: ratio, 284: short(1), 296: short(3), 339: short(1, 1, 1), 530: short(2, 2), 532: (RATIONAL, 6, b"".join(struct.pack("<II", v, 1) for v in REFERENCE))}
    if page["description"] is not None:
        text = page["description"].encode() + b"\0"
        fields[270] = (ASCII, len(text), text)
    if page["tile_w"]:
        fields |= {254: long(int(page["reduced"])), 322: long(page["tile_w"]), 323: long(page["tile_h"]), 324: where(page["offsets"]), 325: where(page["counts"])}
        if page["tables"]:
            fields[347] = (UNDEFINED, len(page["tables"]), page["tables"])
    else:
        fields |= {273: where(page["offsets"]), 278: long(page["height"]), 279: where(page["counts"])}
    return [(tag, *fields[tag]) for tag in sorted(fields)]


def directory(fields: list[tuple[int, int, int, bytes]], at: int, big: bool, last: bool) -> bytes:
    """A directory that stands at ``at``, with its longer payloads behind it, and the link to the next."""
    entry, room = ("<HHQ", 8) if big else ("<HHI", 4)
    size = (8 if big else 2) + len(fields) * (struct.calcsize(entry) + room) + room
    body, extra = struct.pack("<Q" if big else "<H", len(fields)), b""
    for tag, kind, count, payload in fields:
        body += struct.pack(entry, tag, kind, count)
        if len(payload) <= room:
            body += payload.ljust(room, b"\0")
        else:
            extra += b"\0" * (len(extra) % 2)
            body += (at + size + len(extra)).to_bytes(room, "little")
            extra += payload
    extra += b"\0" * (-(size + len(extra)) % 8)
    return body + (0 if last else at + size + len(extra)).to_bytes(room, "little") + extra


class Output:
    """One growing file."""

    def __init__(self, path: str):
        self.path = path
        self.temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        self.file = open(self.temporary, "wb")
        self.file.write(bytes(START))
        self.pages: list[dict] = []

    def add(self, row) -> None:
        if row["slot"] < 0:
            self.pages.append(row.asDict() | {"offsets": [], "counts": []})
            return
        if not self.pages or self.pages[-1]["page"] != row["page"]:
            raise ValueError(f"{self.path}: page {row['page']} has no description")
        page = self.pages[-1]
        if row["slot"] != len(page["offsets"]):
            raise ValueError(f"{self.path}: page {row['page']} lacks slot {len(page['offsets'])}")
        page["offsets"].append(self.file.tell())
        page["counts"].append(len(row["data"]))
        self.file.write(row["data"])

    def finish(self, bigtiff: str) -> None:
        self.file.write(bytes(-self.file.tell() % 8))
        start = self.file.tell()
        room = sum(16 * len(p["offsets"]) + len(p["tables"] or b"") + len(p["description"] or "") * 4 + 1024 for p in self.pages)
        big = start + room >= CLASSIC_LIMIT
        if big and bigtiff == "never":
            raise ValueError(f"{self.path}: TIFF exceeds 4 GiB")
        for i, page in enumerate(self.pages):
            self.file.write(directory(page_fields(page, big), self.file.tell(), big, i == len(self.pages) - 1))
        self.file.seek(0)
        self.file.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, start) if big else struct.pack("<2sHI", b"II", 42, start))
        self.file.close()

    def drop(self) -> None:
        self.file.close()
        if os.path.exists(self.temporary):
            os.remove(self.temporary)


@dataclass
class Written(WriterCommitMessage):
    moves: list
    failures: list


class SvsWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.bigtiff, self.failures = options.get("bigtiff", "auto"), options.get("failures")

    def write(self, iterator) -> Written:
        done: list[tuple[str, str]] = []
        failed: dict[str, str] = {}
        now: Output | None = None

        def end() -> None:
            if now is not None and now.path not in failed:
                now.finish(self.bigtiff)
                done.append((now.temporary, now.path))

        def tried(step, name: str, output: Output | None) -> None:
            try:
                step()
            except (ValueError, OSError, TypeError, struct.error) as e:
                if self.failures is None:
                    raise
                failed[name] = str(e)
                if output is not None:
                    output.drop()

        try:
            for row in iterator:
                path = local_path(row["output"])
                if path is None:
                    raise ValueError(f"outputs have to be on a mounted file system: {row['output']}")
                if now is None or now.path != path:
                    if now is not None:
                        tried(end, now.path, now)
                    now = Output(path)
                if path not in failed:
                    tried(lambda r=row: now.add(r), path, now)
            if now is not None:
                tried(end, now.path, now)
        except BaseException:
            if now is not None:
                now.drop()
            for temporary, _ in done:
                os.remove(temporary)
            raise
        return Written(done, list(failed.items()))

    def commit(self, messages) -> None:
        lines = []
        for m in messages:
            for temporary, path in m.moves if m else []:
                os.replace(temporary, path)
            lines += [json.dumps({"output": path, "message": text}) + "\n" for path, text in (m.failures if m else [])]
        if self.failures is not None:
            os.makedirs(os.path.dirname(self.failures), exist_ok=True)
            with open(self.failures, "w", encoding="utf-8") as f:
                f.writelines(lines)

    def abort(self, messages) -> None:
        for m in messages:
            for temporary, _ in m.moves if m else []:
                if os.path.exists(temporary):
                    os.remove(temporary)


class SvsSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "svs"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return SvsWriter(dict(self.options))


def write_svs(rows, partitions: int | None = None, bigtiff: str = "auto", failures: str | None = None) -> None:
    """Writes the rows of outputs, each by one task."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, "output").sortWithinPartitions("output", "page", "slot").write.format("svs").options(bigtiff=bigtiff, **({"failures": failures} if failures else {})).mode("append").save()
