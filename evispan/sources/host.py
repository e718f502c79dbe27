"""Memory of the host a model would be loaded on: asked before it is, as a run that starves fails late."""

from __future__ import annotations

import math

GIB = 1 << 30


def available_bytes(path: str = "/proc/meminfo") -> int | None:
    """What Linux takes to be available; null if the file is absent or says it in another way."""
    try:
        with open(path, encoding="ascii") as f:
            told = [x.split() for x in f if x.startswith("MemAvailable:")]
    except (OSError, UnicodeError):
        return None
    if len(told) != 1 or len(told[0]) != 3 or not told[0][1].isdigit() or told[0][2] != "kB":
        return None
    return int(told[0][1]) * 1024


def memory_check(least_gib: float | None, path: str = "/proc/meminfo") -> dict:
    """What is asked for and there; ``sufficient`` is null if nothing is asked for, false if what is there isn't known."""
    have = available_bytes(path)
    return {"min_available_gib": least_gib, "available_bytes": have, "sufficient": None if least_gib is None else have is not None and have >= least_gib * GIB}


def require_memory(least_gib: float | None, path: str = "/proc/meminfo") -> dict:
    got = memory_check(least_gib, path)
    if got["sufficient"] is False:
        raise MemoryError(f"{least_gib:g} GiB are required; {'unknown' if got['available_bytes'] is None else format(got['available_bytes'] / GIB, '.2f')} available")
    return got


def positive_gib(value: str) -> float:
    """A threshold from text: finite and above zero, else ValueError."""
    x = float(value)
    if not (math.isfinite(x) and x > 0):
        raise ValueError("a threshold is finite and above zero")
    return x
