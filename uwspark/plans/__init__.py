"""Registered queries, one module per domain."""

from importlib import import_module

MODULES = ["bank", "rules", "sources", "cleaning", "signals", "history", "ingest", "learning", "models", "folder", "portfolio", "wide", "policy", "stored"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
