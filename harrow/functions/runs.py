"""Longest runs as summaries that can be merged: of a stretch of flags its length, the run at its begin, the run at its end, and the longest."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = (0, 0, 0, 0)


def merged(a: tuple, b: tuple) -> tuple:
    """The summary of stretch a followed by stretch b. Merging is associative, with EMPTY as its neutral element."""
    return a[0] + b[0], a[1] if a[1] < a[0] else a[0] + b[1], b[2] if b[2] < b[0] else a[2] + b[0], max(a[3], b[3], a[2] + b[1])


def summary(flags: Iterable[bool]) -> tuple:
    out = EMPTY
    for flag in flags:
        out = merged(out, (1, 1, 1, 1) if flag else (1, 0, 0, 0))
    return out


def summary_of(flags: np.ndarray) -> tuple:
    """summary() of an array of booleans."""
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False]))
    lengths = edges[1::2] - edges[::2]
    if not len(lengths):
        return len(flags), 0, 0, 0
    return len(flags), int(lengths[0]) if flags[0] else 0, int(lengths[-1]) if flags[-1] else 0, int(lengths.max())


def merged_columns(a: Column, b: Column) -> Column:
    """merged() of two structs (n, first, last, best)."""
    return F.struct(
        (a["n"] + b["n"]).alias("n"), F.when(a["first"] < a["n"], a["first"]).otherwise(a["n"] + b["first"]).alias("first"),
        F.when(b["last"] < b["n"], b["last"]).otherwise(a["last"] + b["n"]).alias("last"), F.greatest(a["best"], b["best"], a["last"] + b["first"]).alias("best"),
    )


def _struct(n, first, last, best) -> Column:
    return F.struct(*[x.cast("long").alias(name) for name, x in (("n", n), ("first", first), ("last", last), ("best", best))])


def empty() -> Column:
    return _struct(*[F.lit(0)] * 4)


def summary_column(values: Column, flag) -> Column:
    """The summary of an array in order; flag(element) says whether it belongs to a run, null is no."""
    def step(s: Column, x: Column) -> Column:
        one = F.when(flag(x), 1).otherwise(0)
        return _struct(s["n"] + 1, s["first"] + F.when(s["first"] == s["n"], one).otherwise(0), (s["last"] + 1) * one, F.greatest(s["best"], (s["last"] + 1) * one))
    return F.aggregate(values, empty(), step)


def merged_array(summaries: Column) -> Column:
    """All summaries of an array, merged in order."""
    return F.aggregate(summaries, empty(), merged_columns)
