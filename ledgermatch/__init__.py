"""Two-sided ledger matching and its reports as Spark DataFrame jobs."""

from ledgermatch.params import Period
from ledgermatch.sources.ledger import Ledger

__all__ = ["Ledger", "Period"]
