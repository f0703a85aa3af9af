"""Registered queries of the operators: name -> callable, name -> SQL."""

from . import decontaminate, exact, hosts, lines, merkle, personal, phrases, pieces, sharding, simhash, substrings, toxicity, warc  # noqa: F401
from .common import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
