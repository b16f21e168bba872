"""Opens a container by its extension."""

from __future__ import annotations

from slidemill.sources.formats import containers, mrxs, tiff
from slidemill.sources.formats.model import Blob, Slide, SlideError
from slidemill.sources.formats.registry import READERS

OPEN = {"csp": containers.read_csp, "dmetrix": containers.read_dmetrix, "kfb": containers.read_kfb, "bkio": containers.read_bkio, "sdpc": containers.read_sdpc, "mrxs": mrxs.read_mrxs, "ndpi": tiff.read_ndpi, "tiff": tiff.read_tiff}


def extension_of(path: str) -> str:
    name = path.rstrip("/").rpartition("/")[2]
    stem, dot, ext = name.rpartition(".")
    return ext.lower() if dot and stem else ""


def open_slide(path: str) -> Slide:
    ext = extension_of(path)
    if ext not in READERS:
        raise SlideError(f"unsupported input extension .{ext}")
    blob = Blob(path)
    try:
        return OPEN[READERS[ext]](blob)
    finally:
        blob.close()
