"""Registration windows: half-open ranges of time with an injected clock."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, functions as F

#: Fixed value: the first day of the current term.
TERM_START = datetime(2024, 7, 9)


@dataclass(frozen=True)
class RegistrationWindow:
    """``[start, end)``; a missing bound is open, and only two keep undated rows."""

    start: datetime | None = None
    end: datetime | None = None

    def holds(self, registered: Column) -> Column:
        """A filter that reaches the scan: literals on the right-hand side only."""
        if self.start is None and self.end is None:
            return F.lit(True)
        parts = []
        if self.start is not None:
            parts.append(registered >= F.lit(self.start).cast("timestamp_ntz"))
        if self.end is not None:
            parts.append(registered < F.lit(self.end).cast("timestamp_ntz"))
        out = parts[0]
        for part in parts[1:]:
            out = out & part
        return F.coalesce(out, F.lit(False))


def period_window(period: str | None, now: datetime, term_start: datetime = TERM_START) -> RegistrationWindow:
    """The window of "historical", "current-term" (the default) or "current-year"."""
    if period == "historical":
        return RegistrationWindow()
    if period in (None, "current-term"):
        return RegistrationWindow(term_start)
    if period == "current-year":
        return RegistrationWindow(datetime(now.year, 1, 1), datetime(now.year + 1, 1, 1))
    raise ValueError(f"unknown period: {period!r}")


def month_window(year: int, month: int) -> RegistrationWindow:
    """One calendar month."""
    return RegistrationWindow(datetime(year, month, 1), datetime(year + month // 12, month % 12 + 1, 1))


def day_range(registered: Column, first: str | None, last: str | None) -> Column:
    """Inclusive days; undated rows go when a bound is set, a reversed range is empty."""
    if first is None and last is None:
        return F.lit(True)
    day = registered.cast("date")
    out = F.lit(True)
    if first is not None:
        out = out & (day >= F.lit(first).cast("date"))
    if last is not None:
        out = out & (day <= F.lit(last).cast("date"))
    return F.coalesce(out, F.lit(False))
