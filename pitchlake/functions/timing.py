"""Time predicates and conversions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_OFFSET = r"(Z|[+-]\d\d:?\d\d)$"


def has_offset(text: Column) -> Column:
    """True when a timestamp text carries a zone; must be tested before the cast loses it."""
    return text.rlike(_OFFSET)


def to_utc(text: Column) -> Column:
    """Zoned timestamp text to an instant; unzoned text becomes null instead of taking the session zone."""
    return F.when(has_offset(text), F.to_timestamp(text))


def is_valid_at(valid_from: Column, valid_until: Column, instant: Column) -> Column:
    """Half-open validity ``[from, until)``; a null bound is open."""
    return (valid_from.isNull() | (instant >= valid_from)) & (valid_until.isNull() | (instant < valid_until))


def prediction_cutoff(kickoff: Column, lead_seconds: Column | int) -> Column:
    """Kickoff minus the lead time."""
    seconds = F.lit(lead_seconds) if isinstance(lead_seconds, int) else lead_seconds
    return kickoff - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def require_zoned(cutoff: datetime) -> datetime:
    """Reject a cutoff argument without a zone."""
    if cutoff.tzinfo is None:
        raise ValueError(f"no zone in {cutoff.isoformat()}, so it is no instant")
    return cutoff
