"""Periods anchored at the latest date in the data, with the window of equal length before them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of the named periods; unknown names count as 30d.
PERIOD_DAYS = {"7d": 7, "30d": 30, "90d": 90, "180d": 180, "6m": 182, "1y": 365}


@dataclass(frozen=True)
class Period:
    start: date
    end: date
    prev_start: date
    prev_end: date
    label: str

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1

    def cur(self, c: str) -> Column:
        return F.col(c).between(F.lit(self.start), F.lit(self.end))

    def prev(self, c: str) -> Column:
        return F.col(c).between(F.lit(self.prev_start), F.lit(self.prev_end))

    def either(self, c: str) -> Column:
        """Covers both windows, so a scan can prune what neither needs."""
        return F.col(c).between(F.lit(min(self.start, self.prev_start)), F.lit(self.end))


def bounds(sales: DataFrame, rentals: DataFrame) -> tuple[date, date]:
    """First and last date over both facts in one pass each; today when there are none."""
    both = sales.select(F.col("instance_date").alias("d")).unionAll(rentals.select(F.col("registration_date").alias("d")))
    low, high = both.agg(F.min("d"), F.max("d")).first()
    return low or date.today(), high or date.today()


def resolve(low: date, high: date, period: str = "30d", start: str | None = None, end: str | None = None) -> Period:
    before = lambda a, b, label: Period(a, b, a - timedelta(days=(b - a).days + 1), a - timedelta(days=1), label)
    if start and end:
        return before(date.fromisoformat(start), date.fromisoformat(end), f"{start}..{end}")
    if period == "ytd":
        return before(date(high.year, 1, 1), high, "YTD")
    if period == "all":
        return Period(low, high, low, low - timedelta(days=1), "All Data")
    days = PERIOD_DAYS.get(period, 30)
    return before(high - timedelta(days=days - 1), high, period)
