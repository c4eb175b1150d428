"""The registered queries: name -> function of (spark, sf_dir), and name -> SQL for DuckDB."""

from __future__ import annotations

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f
    return add
