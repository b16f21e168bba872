"""Names for helper columns beside whatever columns a table has."""

from __future__ import annotations


def free_name(taken: list[str], name: str) -> str:
    """``name``, or with a number where a column is called so already, without regard to case."""
    lower = {c.lower() for c in taken}
    if name.lower() not in lower:
        return name
    return next(f"{name}_{k}" for k in range(1, len(lower) + 2) if f"{name}_{k}".lower() not in lower)
