"""INI files and files beside a container."""

from __future__ import annotations

from slidemill.sources.formats.model import Blob


def read_ini(text: str) -> dict[str, str]:
    """section.key, lower-cased, to value; the last of equal keys."""
    section, out = "", {}
    for line in map(str.strip, text.removeprefix("﻿").splitlines()):
        if line.startswith("[") and line.endswith("]"):
            section = line[1:-1].lower()
        elif "=" in line:
            key, _, value = line.partition("=")
            out[f"{section}.{key.strip().lower()}"] = value.strip()
    return out


def first_parse(kind, *values):
    """The first value that parses, or None."""
    for v in values:
        try:
            return kind(v)
        except (TypeError, ValueError):
            continue
    return None


def sibling(path: str, *names: str) -> str:
    return "/".join([path.rpartition("/")[0], *names])


def sibling_text(blob: Blob, name: str) -> str | None:
    """Text of the file of that name in the container's folder, None if there is none."""
    try:
        other = Blob(sibling(blob.path, name))
    except (FileNotFoundError, OSError):
        return None
    try:
        return other.read(0, other.size).decode("utf-8", "replace")
    finally:
        other.close()
