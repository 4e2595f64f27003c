"""Registered queries, and commands over folders."""

from . import catalog, file_queries  # noqa: F401  the second adds to the first's registry
