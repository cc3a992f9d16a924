"""State that a Python worker keeps from task to task."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any
from uuid import uuid4

_HELD: dict[str, Any] = {}
KEPT_MOST = 4


def new_key() -> str:
    """Key of a state, made on the driver and sent along with the task."""
    return uuid4().hex


def per_worker(key: str, build: Callable[[], Any]) -> Any:
    """The state under ``key``, built on first use in this process. Only memoised pure functions belong here: a task that
    runs again on another worker gets the same results."""
    if key not in _HELD:
        while len(_HELD) >= KEPT_MOST:
            _HELD.pop(next(iter(_HELD)))
        _HELD[key] = build()
    return _HELD[key]
