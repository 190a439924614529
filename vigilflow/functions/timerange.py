"""Named and custom time windows, resolved once on the driver."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

from vigilflow import fixed_values as V


@dataclass(frozen=True)
class TimeRange:
    start: datetime
    end: datetime
    label: str

    def contains(self, ts: str) -> Column:
        """Both ends belong to the window; becomes a pushed-down range filter."""
        return F.col(ts).between(_literal(self.start), _literal(self.end))


def _literal(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def _utc(value: datetime | str) -> datetime:
    if isinstance(value, str):
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
    return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value


def resolve(name: str | None, as_of: datetime | str, start=None, end=None) -> TimeRange:
    """``1h 24h 7d 30d`` (also with a ``last_`` prefix) or ``custom``.

    ``as_of`` takes the place of the wall clock.  Unknown names mean 24 hours.
    """
    now = _utc(as_of)
    name = (name or "24h").lower().strip().removeprefix("last_")
    if name != "custom":
        hours, label = V.TIME_RANGES.get(name, V.TIME_RANGES["24h"])
        return TimeRange(now - timedelta(hours=hours), now, label)
    if not start or not end:
        raise ValueError("a custom range needs a start and an end")
    start, end = _utc(start), _utc(end)
    if start >= end:
        raise ValueError("the start must lie before the end")
    if (end - start).days > V.MAX_RANGE_DAYS:
        raise ValueError(f"a custom range may span {V.MAX_RANGE_DAYS} days at most")
    return TimeRange(start, end, f"Custom ({start:%Y-%m-%d} to {end:%Y-%m-%d})")


def literal(value: datetime | str) -> Column:
    return _literal(_utc(value))
