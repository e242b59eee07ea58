"""Arguments and settings, checked before a plan is made."""

from __future__ import annotations

from collections.abc import Mapping


def required_text(arguments: Mapping, name: str) -> str:
    found = arguments.get(name)
    if not isinstance(found, str) or not found.strip():
        raise ValueError(f"{name} must be a text that isn't blank")
    return found.strip()


def required_list(arguments: Mapping, name: str) -> list[str]:
    found = arguments.get(name)
    if not isinstance(found, list) or not found:
        raise ValueError(f"{name} must be a list with entries")
    return [str(x) for x in found]


def whole_numbers(arguments: Mapping, *names: str) -> dict[str, int]:
    """Those of the names that are given, as whole numbers."""
    return {n: int(arguments[n]) for n in names if arguments.get(n) is not None}


def quantile_range(low: float, high: float) -> tuple[float, float]:
    if not 0 <= low < high <= 1:
        raise ValueError(f"quantiles must be ordered and between 0 and 1: {low}, {high}")
    return low, high


def shard_of(index: int, shards: int) -> int:
    if shards < 1 or not 0 <= index < shards:
        raise ValueError(f"shard {index} isn't one of {shards}")
    return index


def year_range(first: int, last: int) -> range:
    if last < first:
        raise ValueError(f"year {last} is before {first}")
    return range(first, last + 1)
