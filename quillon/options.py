"""Options that change results or how statements run."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Options:
    """``skip_alone``: a skip without a take is allowed; ``short_text``: unsized text columns hold 255 characters; ``retries``: how often ``retrying`` tries again."""

    skip_alone: bool = True
    short_text: bool = False
    retries: int = 0


_current = Options()


def current() -> Options:
    return _current


@contextmanager
def options(**changes: Any):
    """The options within a ``with`` block."""
    global _current
    before = _current
    _current = replace(before, **changes)
    try:
        yield _current
    finally:
        _current = before


def retrying(action: Callable[[], Any], transient: Callable[[Exception], bool], wait_seconds: float = 0.1) -> Any:
    """``action``'s result; errors that ``transient`` accepts are tried again, with doubled waits, as often as the options say."""
    left = current().retries
    while True:
        try:
            return action()
        except Exception as e:
            if not left or not transient(e):
                raise
            left -= 1
            time.sleep(wait_seconds)
            wait_seconds *= 2
