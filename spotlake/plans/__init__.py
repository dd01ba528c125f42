"""Queries of the package; importing it registers them in catalogue."""

from . import catalogue, groups, measures, molecules, movies, regions, views  # noqa: F401
