"""Preparation of match keys before a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(key: Column) -> Column:
    """Trimmed, upper case, without leading zeros; a key of zeros is '0', an empty key is null."""
    trimmed = F.upper(F.trim(key))
    stripped = F.regexp_replace(trimmed, "^0+(?=.)", "")
    return F.when(stripped != "", stripped)


def key_normalise(trans: DataFrame, columns: Sequence[str]) -> DataFrame:
    return trans.withColumns({c: normalised(F.col(c)) for c in columns})
