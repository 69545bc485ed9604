"""Lazy image pipelines over collections of images."""

from .raster import Output, Raster, RunStats

__all__ = ["Output", "Raster", "RunStats"]
