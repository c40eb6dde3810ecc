"""Dates as people write them."""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import datetime, timedelta, timezone
from email.utils import format_datetime

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def parse_date(phrase: str, now: datetime | None = None) -> datetime:
    """``yesterday``, ``today``, ``now``, ``7 days ago``, ``last week``, ISO dates; ValueError for anything else."""
    now = now or datetime.now(timezone.utc)
    text = phrase.strip().lower()
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if text in ("now", "today", "yesterday", "tomorrow"):
        return {"now": now, "today": midnight, "yesterday": midnight - timedelta(days=1), "tomorrow": midnight + timedelta(days=1)}[text]
    if m := re.fullmatch(r"(\d+|an?|last|one)\s+(second|minute|hour|day|week|month|year)s?(?:\s+ago)?", text):
        if m[1] not in ("last",) and not text.endswith("ago"):
            raise ValueError(f"no date: {phrase!r}")
        n = int(m[1]) if m[1].isdigit() else 1
        if m[2] in _UNITS:
            return now - timedelta(seconds=n * _UNITS[m[2]])
        months = now.year * 12 + now.month - 1 - n * (12 if m[2] == "year" else 1)
        year, month = divmod(months, 12)
        return now.replace(year=year, month=month + 1, day=min(now.day, monthrange(year, month + 1)[1]))
    try:
        found = datetime.fromisoformat(phrase.strip())
    except ValueError:
        raise ValueError(f"no date: {phrase!r}") from None
    return found if found.tzinfo else found.replace(tzinfo=timezone.utc)


def rfc2822(date: datetime) -> str:
    return format_datetime(date)
