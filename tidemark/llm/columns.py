"""Names for columns that operators add for a while."""

from __future__ import annotations

from collections.abc import Iterable


def spare(taken: Iterable[str], name: str) -> str:
    """``name``, with as many underscores before it as make it none of ``taken``, whatever their case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name
