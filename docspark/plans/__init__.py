"""Registered queries: one module per inventory section, each pairing a Spark
plan with the SQL text that must give the same rows."""

from . import registry
from .registry import ORACLES, QUERIES


def load_all():
    import importlib

    for name in registry.SECTIONS:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
