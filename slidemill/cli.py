"""Command line: ``python -m slidemill.cli PATH [--output-dir DIR | -o FILE] [--quality N] [--overwrite] [--info]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from slidemill.functions.text import pyramid_summary
from slidemill.plans.convert import check_quality, convert
from slidemill.session import build_session
from slidemill.sources import slide_source
from slidemill.sources.formats.open import extension_of
from slidemill.sources.formats.registry import FORMATS


def info(spark: SparkSession, path: str) -> list[str]:
    """What each slide at a path holds, in four lines."""
    slide_source.register(spark)
    read = lambda r: slide_source.read_slides(spark, path, r)
    kinds = read("images").where("kind <> 'thumbnail'").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "kind"))), lambda k: k["kind"]), ", ").alias("kinds"))
    pyramid = pyramid_summary(read("levels").withColumnRenamed("path", "slide_id")).withColumnRenamed("slide_id", "path")
    rows = read("slides").join(pyramid, "path").join(kinds, "path", "left").orderBy("path").collect()  # a row a slide
    out = []
    for r in rows:
        out.append(f"Image : {r.width}x{r.height}, tile={r.tile_w}x{r.tile_h}, levels={r.levels}, compression={r.compression}")
        out.append(f"Meta  : mpp={r.mpp:.6f}, app_mag={r.app_mag:g}, jpeg_quality={r.quality}")
        out.append(f"Pyr   : {r.pyramid}")
        out.append(f"Assoc : {r.kinds or 'none'}")
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="slidemill", description="Converts whole-slide images to pyramidal TIFFs.")
    p.add_argument("path", help="a slide, a folder or a glob")
    p.add_argument("--output-dir", help="where outputs go; beside each input if it isn't given")
    p.add_argument("-o", "--output", help="the output file, for a single input")
    p.add_argument("--keep-folders", action="store_true", help="below the output folder, keep the folders of the inputs")
    p.add_argument("--quality", type=int, help="1 to 100; the source's if it isn't given")
    p.add_argument("--overwrite", action="store_true", help="replace outputs that are there")
    p.add_argument("--skip-associated", action="store_true", help="leave label and macro images out")
    p.add_argument("--bigtiff", choices=("auto", "never"), default="auto")
    p.add_argument("--format", choices=("auto", *sorted({r for *_, r in FORMATS})), default="auto", help="refuse inputs of another format")
    p.add_argument("--info", action="store_true", help="only tell what the slides hold")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if all went well; else 1, with what failed on the error stream."""
    args = parser().parse_args(argv)
    try:
        check_quality(args.quality)
        if args.output and args.output_dir:
            raise ValueError("either an output file or an output folder")
        if args.format != "auto":
            readers = {e: r for _, e, _, r in FORMATS}
            if other := [p for p in slide_source.list_files(args.path) if readers[extension_of(p)] != args.format]:
                raise ValueError(f"not of format {args.format}: {', '.join(other)}")
        spark = spark or SparkSession.getActiveSession() or build_session("local[*]")
        if args.info:
            print("\n".join(info(spark, args.path)))
            return 0
        rows = convert(spark, args.path, args.output_dir, args.quality, args.overwrite, not args.skip_associated, args.bigtiff, args.output, args.keep_folders).orderBy("path").collect()
    except (ValueError, OSError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    for r in rows:
        print(f"{r.state}: {r.path} -> {r.output or '-'}" + (f" ({r.message})" if r.message else ""), file=sys.stderr if r.state == "Failed" else sys.stdout)
    return int(not rows or any(r.state == "Failed" for r in rows))


if __name__ == "__main__":
    sys.exit(main())
