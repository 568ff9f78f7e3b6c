"""Settings of the driver: nested values from dotted keys, overrides, opening hours."""

from __future__ import annotations

import json
from copy import deepcopy
from datetime import datetime, timedelta


def merged(base: dict, *others: dict) -> dict:
    """Nested dictionaries merged; later values win."""
    out = deepcopy(base)
    for other in others:
        for key, value in other.items():
            out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else deepcopy(value)
    return out


def nested(values: dict[str, object]) -> dict:
    """``{"a.b": 1}`` as ``{"a": {"b": 1}}``."""
    out: dict = {}
    for key, value in values.items():
        *path, last = key.split(".")
        at = out
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value
    return out


def overridden(base: dict, dotlist: list[str]) -> dict:
    """``base`` with ``a.b=value`` settings; values are read as JSON where they can be."""

    def value(text: str) -> object:
        try:
            return json.loads(text)
        except ValueError:
            return text

    return merged(base, nested({k: value(v) for k, _, v in (x.partition("=") for x in dotlist)}))


def opening(now: datetime, start: int | None, end: int | None) -> datetime | None:
    """None if ``now`` lies within the hours (which may pass midnight), else when they next begin."""
    if start is None or end is None:
        return None
    within = start <= now.hour < end if start <= end else now.hour >= start or now.hour < end
    if within:
        return None
    begin = now.replace(hour=start, minute=0, second=0, microsecond=0)
    return begin if begin > now else begin + timedelta(days=1)
