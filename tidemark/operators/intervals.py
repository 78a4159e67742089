"""An index of validity intervals: cut at time buckets, so that (key, bucket) is an equality key.

An instant lies in one bucket, an interval in all buckets that it touches. Joined on (key, bucket), the rows of a hot
key spread over as many groups as it has buckets, and an instant meets only intervals of its own bucket. Buckets are
clamped to a fixed number, so an open interval is cut into that many at most, and instants before the first or after
the last bucket share those; the interval's own bounds are still tested, so the result is that of the plain join.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

BUCKET = "_bucket"


class Buckets(NamedTuple):
    """`count` buckets of `days` days from `first` (a day number since 1970) on."""

    days: int = 365
    first: int = 7305  # 1990-01-01
    count: int = 60

    def of(self, at: Column) -> Column:
        number = F.floor((F.unix_date(at.cast("date")) - F.lit(self.first)) / F.lit(self.days))
        return F.greatest(F.lit(0), F.least(F.lit(self.count - 1), number)).cast("int")


#: for membership spells and other intervals of years
YEARS = Buckets()
#: for facts that change within days or weeks, under events of a hot key
MONTHS = Buckets(30, 7305, 730)


def cut(intervals: DataFrame, start: str, end: str, buckets: Buckets = YEARS) -> DataFrame:
    """The intervals with a row per bucket they touch (column `_bucket`); a NULL end is open, a NULL start matches
    nothing, and neither does an interval that ends before it starts."""
    real = intervals.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) <= F.col(end))))
    last = F.when(F.col(end).isNull(), F.lit(buckets.count - 1)).otherwise(buckets.of(F.col(end)))
    return real.withColumn(BUCKET, F.explode(F.sequence(buckets.of(F.col(start)), last)))


__all__ = ["BUCKET", "Buckets", "MONTHS", "YEARS", "cut"]
