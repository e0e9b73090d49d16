"""Date literals and time spans of the query language, as epoch milliseconds."""

from __future__ import annotations

import re
from datetime import UTC, datetime

SPANS = {"week": 604_800_000, "day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "min": 60_000, "second": 1000, "sec": 1000, "millisecond": 1, "msec": 1}
_DATE = re.compile(r"(\d{4})([-/])(\d{1,2})\2(\d{1,2})(?:\s+(\d{1,2}):(\d{2}):(\d{2}))?$")
#: Trailing periods of activity columns, in minutes.
PERIODS = {"m": 1, "h": 60, "d": 1440, "w": 10_080, "M": 43_200, "y": 525_600}


def date_ms(text: str) -> int | None:
    """Milliseconds of yyyy-MM-dd or yyyy/MM/dd with an optional HH:mm:ss in UTC; None if it is no real date."""
    m = _DATE.match(text.strip())
    if not m:
        return None
    y, _, mo, d, *hms = m.groups()
    try:
        return int(datetime(int(y), int(mo), int(d), *(int(x or 0) for x in hms), tzinfo=UTC).timestamp() * 1000)
    except ValueError:
        return None


def span_ms(unit: str) -> int | None:
    u = unit.lower()
    return SPANS.get(u) or SPANS.get(u.removesuffix("s"))


def period_minutes(text: str) -> int:
    return int(text[:-1]) * PERIODS[text[-1]]


def ddhhmmss_ms(text: str) -> int:
    """A dddhhmmss distance, as dynamic time ranges have it."""
    t = text.zfill(9)
    return int(t[:3]) * 86_400_000 + int(t[3:5]) * 3_600_000 + int(t[5:7]) * 60_000 + int(t[7:9]) * 1000
