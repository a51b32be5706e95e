"""Query registry filled by the section modules."""

from __future__ import annotations

from ..ordering import spread_if_few

QUERIES: dict = {}
ORACLES: dict = {}

SECTIONS = [
    "sources", "sqlops", "cells", "pages", "text", "match", "assemble", "rollup", "layout",
]


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its SQL counterpart."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


#: Text tables, whose rows are costly: a single small file is spread over the slots.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark, sf_dir: str, name: str):
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_if_few(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df
