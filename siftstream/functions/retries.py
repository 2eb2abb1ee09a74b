"""Calls of services that fail now and then."""

from __future__ import annotations

import time
from collections.abc import Callable


class Refused(Exception):
    """An answer with a status other than success."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(f"{status} {message}"[:220])
        self.status = status


def with_retries(call: Callable, delays: tuple[float, ...] = (2, 4, 8), sleep: Callable = time.sleep):
    """What ``call`` returns; a status of 429 or of 500 and more is tried again after each delay, others fail at once."""
    for delay in (*delays, None):
        try:
            return call()
        except Refused as e:
            if delay is None or not (e.status == 429 or e.status >= 500):
                raise
            sleep(delay)
