"""Random draws as pure functions of (seed, name, row, attempt, slot).

The same draw comes out on any partitioning, after any retry, and (with md5) in any
SQL engine. Nothing here depends on time or on the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

ONE = float(1 << 52)
#: Parts texts that are handed over as one.
MARK = "\x1f"


@dataclass(frozen=True)
class Draw:
    """Draws for one column of one table; ``row`` numbers the rows."""

    seed: int
    name: str
    row: Column
    attempt: Column | int = 0
    rng: str = "md5"
    base: int = 0

    def bits(self, slot: int = 0) -> Column:
        """A whole number below 2**52."""
        attempt = self.attempt if isinstance(self.attempt, Column) else F.lit(self.attempt)
        if self.rng == "xxhash64":
            return F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), F.lit(self.name), self.row.cast("long"), attempt.cast("long"), F.lit(self.base + slot)), 12)
        text = F.concat_ws("|", F.lit(str(self.seed)), F.lit(self.name), self.row.cast("string"), attempt.cast("string"), F.lit(str(self.base + slot)))
        return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")

    def u(self, slot: int = 0) -> Column:
        """In [0, 1)."""
        return self.bits(slot) / F.lit(ONE)

    def below(self, n: Column | int, slot: int = 0) -> Column:
        """A whole number from 0 to n - 1."""
        n = n if isinstance(n, Column) else F.lit(n)
        return F.floor(self.u(slot) * n.cast("double")).cast("long")

    def between(self, lo: int, hi: int, slot: int = 0) -> Column:
        return F.lit(lo).cast("long") + self.below(hi - lo + 1, slot)

    def pick(self, values: list, slot: int = 0) -> Column:
        return F.element_at(listed(values), (self.below(len(values), slot) + 1).cast("int"))

    def weighted(self, values: list, weights: list[int], slot: int = 0) -> Column:
        """By whole-number weights: a chain of comparisons with running totals."""
        at = self.below(sum(weights), slot)
        out, total = None, 0
        for v, w in zip(values, weights, strict=True):
            total += w
            v = v if isinstance(v, Column) else F.lit(v)
            out = F.when(at < total, v) if out is None else out.when(at < total, v)
        return out

    def at(self, base: int) -> Draw:
        """The same draws from another first slot, for parts that must not share."""
        return replace(self, base=self.base + base)

    def of(self, name: str) -> Draw:
        return replace(self, name=name, base=0)


def listed(values: list) -> Column:
    """An array of constants. Texts are one constant that is split when the plan is optimized: one call, not one a text."""
    if values and all(isinstance(v, str) and MARK not in v for v in values):
        return F.split(F.lit(MARK.join(values)), MARK)
    return F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values))


def sql_bits(seed: int, name: str, row: str, attempt: str = "0", slot: int = 0) -> str:
    """bits() as DuckDB SQL."""
    return f"('0x' || substr(md5('{seed}|{name}|' || ({row}) || '|' || ({attempt}) || '|{slot}'), 1, 13))::BIGINT"


def sql_below(seed: int, name: str, row: str, n: str | int, slot: int = 0, attempt: str = "0") -> str:
    return f"floor(({sql_bits(seed, name, row, attempt, slot)} / {ONE!r}::DOUBLE) * ({n})::DOUBLE)::BIGINT"
