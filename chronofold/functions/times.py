"""Times as users write them."""

from __future__ import annotations

import datetime as dt
import re

#: Seconds of the units of relative times. Fixed values.
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "year": 31536000}


def parse_time(text: str, now: dt.datetime | None = None) -> int:
    """Epoch milliseconds of a number of them, ``today``, ``yesterday``, ``2.weeks.ago``, chains of such, or ISO 8601.

    ``today`` and ``yesterday`` are midnights; times without zone are in UTC. Anything else raises ValueError.
    """
    now = now or dt.datetime.now(dt.timezone.utc)
    t = text.strip()
    if re.fullmatch(r"-?\d+", t):
        return int(t)
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if t.lower() in ("today", "yesterday"):
        return int((midnight - dt.timedelta(days=t.lower() == "yesterday")).timestamp() * 1000)
    if t.lower().endswith("ago"):
        parts = [p for p in re.split(r"[.\s]+", t.lower())[:-1] if p]
        if not parts or len(parts) % 2:
            raise ValueError(f"not a time: {text!r}")
        back = 0
        for n, unit in zip(parts[::2], parts[1::2]):
            if not n.isdigit() or unit.rstrip("s") not in UNITS:
                raise ValueError(f"not a time: {text!r}")
            back += int(n) * UNITS[unit.rstrip("s")]
        return int(now.timestamp() * 1000) - back * 1000
    try:
        at = dt.datetime.fromisoformat(t.replace("Z", "+00:00"))
    except ValueError:
        raise ValueError(f"not a time: {text!r}") from None
    return int((at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)).timestamp() * 1000)
