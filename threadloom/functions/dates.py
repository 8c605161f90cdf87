"""Times as columns: epochs, elapsed time, bounds given by a user, formats."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directives of a C-style format and their pattern letters.
DIRECTIVES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE"}


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def to_epoch(at: Column) -> Column:
    return F.unix_timestamp(at.cast("timestamp")).cast("string")


def elapsed(begin: Column, end: Column) -> Column:
    """Seconds between two times, to the microsecond."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(begin.cast("timestamp"))) / F.lit(1e6)


def within(at: Column, since: dt.datetime | None = None, until: dt.datetime | None = None) -> Column:
    """Times from ``since`` to the end of the second ``until``; a bound that is not given is open."""
    if since and until and since > until:
        raise ValueError("the first date must not be after the last")
    held = F.lit(True)
    if since:
        held = held & (at >= F.lit(since))
    if until:
        held = held & (at < F.lit(until + dt.timedelta(seconds=1)))
    return held


def formatted(at: Column, pattern: str) -> Column:
    """A time by a C-style format; unknown directives stay as they are."""
    out, plain, i = "", "", 0
    quote = lambda t: "'" + t.replace("'", "''") + "'" if t else ""
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in DIRECTIVES:
            out, plain, i = out + quote(plain) + DIRECTIVES[two], "", i + 2
        elif two == "%%":
            plain, i = plain + "%", i + 2
        else:
            plain, i = plain + pattern[i], i + 1
    return F.date_format(at, out + quote(plain))
