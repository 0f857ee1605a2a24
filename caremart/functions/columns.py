"""Null-aware column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Derived(NamedTuple):
    """Rows, and the named columns that derive from them.

    Joins and written stages carry the rows, which may be far narrower than the columns; ``frame`` is the table.
    ``uses`` may name the row columns that a column derives from.
    """

    rows: DataFrame
    columns: Mapping[str, Column]
    uses: Mapping[str, Sequence[str]] = {}

    @classmethod
    def of(cls, table: DataFrame | Derived) -> Derived:
        return table if isinstance(table, cls) else cls(table, {c: F.col(c) for c in table.columns})

    def frame(self) -> DataFrame:
        return self.rows.select(*[e.alias(c) for c, e in self.columns.items()])

    def unused(self, columns: Iterable[str]) -> list[str]:
        """The row columns that the named columns do not derive from; none, if ``uses`` lacks one of them."""
        named = [c for c in columns if c in self.columns]
        if any(c not in self.uses for c in named):
            return []
        return [r for r in self.rows.columns if not any(r in self.uses[c] for c in named)]

    def where(self, keep: Callable[[DataFrame], DataFrame]) -> Derived:
        """The rows that a filter of the derived columns keeps."""
        both = self.rows.select(F.struct(*self.rows.columns).alias("_row"), *[e.alias(c) for c, e in self.columns.items()])
        return self._replace(rows=keep(both).select("_row.*"))


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL when den is 0 or NULL (ANSI mode would raise on x/0)."""
    return F.try_divide(col_(num).cast("double"), col_(den).cast("double"))


def clamp(c: str | Column, lo: float, hi: float) -> Column:
    """Clip into [lo, hi] keeping NULL as NULL (``least``/``greatest`` skip NULLs)."""
    c = col_(c)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(F.lit(float(lo)),
                                                                               F.least(F.lit(float(hi)), c)))


def sum_skip_nulls(cols: Iterable[str | Column]) -> Column:
    """Row sum that skips NULL parts (pandas ``sum(axis=1)``)."""
    parts = [F.coalesce(col_(c).cast("double"), F.lit(0.0)) for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def rounded(c: str | Column, decimals: int | None) -> Column:
    """Half-even rounding (pandas ``round``) when ``decimals`` is given."""
    return F.bround(col_(c), decimals) if decimals is not None else col_(c)


def month_start(c: str | Column) -> Column:
    return F.trunc(col_(c), "month")
