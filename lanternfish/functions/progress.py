"""Progress of a build: percent, remaining time and states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: States of a build and where each may go.
MOVES = {"idle": ("queued",), "queued": ("running", "failed"), "running": ("completed", "failed"), "completed": ("queued",), "failed": ("queued",)}


def may_move(before: str, after: str) -> bool:
    return before == after or after in MOVES[before]


def legal(before: Column, after: Column) -> Column:
    """may_move() of columns."""
    return (before == after) | F.concat_ws(">", before, after).isin(*(f"{a}>{b}" for a, found in MOVES.items() for b in found))


def percent_done(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100.0 * F.greatest(done, F.lit(0)) / total, 1)).otherwise(100.0)


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds that the rest takes at the rate so far: 0 when all is done, null before anything is."""
    rest = F.bround((total - done) / (done / F.greatest(elapsed, F.lit(0.001))), 0)
    return F.when((total > 0) & (done >= total), 0.0).when((total > 0) & (done > 0), F.greatest(rest, F.lit(0.0))).cast("long")
