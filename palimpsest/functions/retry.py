"""Calls of services that may fail for a while."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")


def retried(call: Callable[[], T], transient: Callable[[Exception], bool], attempts: int = 3, first_wait: float = 0.25, sleep: Callable[[float], None] = time.sleep) -> T:
    """What a call gives, tried 1 to 3 times; only failures that are transient are tried again, after waits that double."""
    if not 1 <= attempts <= 3:
        raise ValueError("a call is tried 1 to 3 times")
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception as e:
            if attempt == attempts or not transient(e):
                raise
            sleep(first_wait * 2 ** (attempt - 1))
    raise AssertionError
