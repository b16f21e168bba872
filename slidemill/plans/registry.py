"""The queries of the tile engine and the SQL that each is held against."""

from __future__ import annotations

from slidemill.plans import container_queries, metadata_queries, pixel_queries, tile_queries

PACKS = (tile_queries, metadata_queries, pixel_queries, container_queries)


def flagship(spark, sf_dir):
    """A pyramid summary of each slide."""
    return queries()["level_extent"](spark, sf_dir)


def queries():
    return {f.__name__: f for pack in PACKS for f in pack.QUERIES}


def oracle_sql():
    return {name: sql for pack in PACKS for name, sql in pack.SQL.items()}
