"""Rows whose instants make sense: created before updated, children after their parents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import instants
from weftline.functions.draw import Draw
from weftline.functions.instants import DAY
from weftline.functions.names import joined, tokens
from weftline.sources.model import Table

# What instants a name tells of. The first role that matches counts.
ROLES = (
    ("future", ("deletedat", "expiresat", "expiredat")),
    ("activity", ("updatedat", "modifiedat", "lastseen", "lastlogin")),
    ("created", ("firstseen", "createdat", "insertedat", "registeredat")),
)


@dataclass(frozen=True)
class Window:
    """Milliseconds; instants of creation lie in [since, until], of the future up to a year later."""

    since: int
    until: int

    @property
    def future(self) -> int:
        return self.until + 365 * DAY


def window(since: str | None = None, until: str | None = None) -> Window:
    """Two years up to 2025 unless given; an end before its start is an error."""
    end = instants.millis(until or "2025-01-01")
    start = instants.millis(since) if since else end - 730 * DAY
    if start > end:
        raise ValueError(f"since {since} is after until {until}")
    return Window(start, end)


def role(name: str, kind: str) -> str | None:
    if kind not in ("date", "timestamp"):
        return None
    whole = joined(name)
    found = next((r for r, parts in ROLES if any(p in whole for p in parts)), None)
    return found or ("created" if "created" in tokens(name) else None)


def anchor(table: Table) -> str | None:
    """The first column that tells when a row was created."""
    return next((c.name for c in table.columns if role(c.name, c.kind) == "created"), None)


def coherent(rows: DataFrame, table: Table, draw: Draw, w: Window, floor: Column | None, frozen: set[str]) -> DataFrame:
    """rows (dates and timestamps as milliseconds) with instants drawn anew in their order.

    Without an anchor nothing changes. created lies between the later of the window's
    start and ``floor`` (the latest creation among parents) and the window's end; activity
    between created and the end; the future between created and a year past the end; an
    upper end below the lower one is the lower one. Frozen columns stay, and a frozen
    created is still what the others follow; nulls of the others stay. Only the first
    column that tells of creation is drawn anew; others of that role stay as they are.
    """
    first = anchor(table)
    if first is None:
        return rows

    def between(lo: Column, hi: Column, name: str) -> Column:
        d = draw.of(f"{draw.name}.{name}.when")
        return lo + d.below(F.greatest(hi - lo, F.lit(0).cast("long")) + 1)

    since, until = (F.lit(x).cast("long") for x in (w.since, w.until))
    if first not in frozen:
        low = since if floor is None else F.greatest(since, F.coalesce(floor, since))
        top = until if floor is None else F.greatest(until, F.coalesce(floor, until))
        rows = rows.withColumn(first, between(low, top, first))
    moved = {}
    for c in table.columns:
        r = role(c.name, c.kind)
        if r in (None, "created") or c.name in frozen:
            continue
        made = between(F.col(first), until if r == "activity" else F.lit(w.future).cast("long"), c.name)
        moved[c.name] = F.when(F.col(c.name).isNotNull(), made) if c.nullable else made
    return rows.withColumns(moved) if moved else rows
