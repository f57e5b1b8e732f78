"""Report parameters shared by every plan."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Period:
    """Report window ``[start, end]`` (both inclusive) and the date the report is made for.

    ``as_of`` stands where a database would read the wall clock, so a report can be repeated.
    """

    start: dt.date
    end: dt.date
    as_of: dt.date

    @property
    def start_col(self) -> Column:
        return F.lit(self.start)

    @property
    def end_col(self) -> Column:
        return F.lit(self.end)

    @property
    def as_of_col(self) -> Column:
        return F.lit(self.as_of)
