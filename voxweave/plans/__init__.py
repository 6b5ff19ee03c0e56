"""Registered queries: a Spark plan over the given tables and its SQL twin."""

from importlib import import_module

MODULES = ("image", "voxel", "surface", "raster", "neighbours", "warping", "rigid", "nonrigid",
           "maths", "files", "timeline")


def load():
    """Import every plan module and return (queries, sql)."""
    from .registry import QUERIES, SQL
    for m in MODULES:
        import_module(f"{__name__}.{m}")
    return QUERIES, SQL
