"""Counts taken while rows are written, and gates on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def written_with_counts(df: DataFrame, counts: dict[str, Column], write: Callable[[DataFrame], None], keep: Column | None = None, gate: Callable[[dict], str | None] | None = None) -> dict:
    """``write`` the rows that ``keep`` holds for, and return ``counts`` over all rows, from the one pass that writes.

    ``gate`` gets the counts afterwards and names what is wrong with them, which
    is then an error; what was written stays, for a look.
    """
    seen = Observation()
    rows = df.observe(seen, *[c.alias(k) for k, c in counts.items()])
    write(rows if keep is None else rows.where(keep))
    got = dict(seen.get)
    if gate and (fault := gate(got)):
        raise ValueError(fault)
    return got


def answer_counts(parsed: str, resolved: str) -> dict[str, Column]:
    """records, parse_drop, offset_drop, kept of parsed and resolved answers."""
    p, r = F.col(parsed), F.col(resolved)
    return {"records": F.count(F.lit(1)), "parse_drop": F.count_if(p.isNull()), "offset_drop": F.count_if(p.isNotNull() & r.isNull()), "kept": F.count_if(r.isNotNull())}


def filter_counts(kept: Column, labels: Column, left: Column) -> dict[str, Column]:
    """records, dropped, spans and removed of a filter that takes labels away: ``kept`` rows, ``labels`` before and ``left`` after."""
    n = lambda c: F.coalesce(F.sum(F.greatest(F.size(c), F.lit(0))), F.lit(0))
    return {"records": F.count(F.lit(1)), "dropped": F.count_if(~kept), "spans": n(labels), "removed": n(labels) - n(left)}


def relabel_counts(status: Column) -> dict[str, Column]:
    return {"spans": F.count(status), **{k: F.count_if(status == k) for k in ("clean", "relabelled", "unparseable")}}


def unparseable_gate(most: float = 0.01) -> Callable[[dict], str | None]:
    """A fault where more than a share ``most`` of the spans can't be read."""
    return lambda c: f"{c['unparseable']} of {c['spans']} spans can't be read" if c["spans"] and c["unparseable"] / c["spans"] > most else None
