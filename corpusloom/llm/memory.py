"""Memories of words that outlive a task: one at a time in each Python worker."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_held: dict[str, Any] = {}


def held(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` made when this worker first asked for ``name``; asking for another name lets it go."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]
