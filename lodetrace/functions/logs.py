"""Logging of calls: what is called, with what, and how long it takes."""

from __future__ import annotations

import functools
import logging
import time

logger = logging.getLogger("lodetrace")


def set_level(level: int | str) -> None:
    logger.setLevel(level)


def logged(f=None, *, level: int = logging.INFO):
    """Log the calls of a function at a level; a call that fails is logged as an error and fails."""
    if f is None:
        return functools.partial(logged, level=level)

    @functools.wraps(f)
    def inner(*args, **kwargs):
        began = time.perf_counter()
        logger.log(level, "%s begins", f.__qualname__)
        try:
            return f(*args, **kwargs)
        except Exception:
            logger.error("%s failed after %.3f s", f.__qualname__, time.perf_counter() - began)
            raise
        finally:
            logger.log(level, "%s took %.3f s", f.__qualname__, time.perf_counter() - began)

    return inner


def progress(items, what: str, every: int = 1000, total: int | None = None, level: int = logging.INFO):
    """The items, with a line in the log after each ``every`` of them and at the end."""
    began, n = time.perf_counter(), 0
    if total is None and hasattr(items, "__len__"):
        total = len(items)
    for n, item in enumerate(items, 1):
        yield item
        if n % every == 0:
            logger.log(level, "%s: %d%s after %.1f s", what, n, f" of {total}" if total is not None else "", time.perf_counter() - began)
    logger.log(level, "%s: all %d after %.1f s", what, n, time.perf_counter() - began)
