"""Registered queries: each applies operators of the library to a driver table that stands in for its input."""

from texloom.plans import codebooks, codes, gallery, ordering, passes, pictures, scalars, statistics  # noqa: F401
