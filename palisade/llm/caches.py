"""What a worker process keeps between tasks: the state of one operator at a time.

Workers are used again by the tasks of other operators and live on when idle, so what one operator
has cached would add up with that of the next. The state of the last operator is kept (tasks of one
job share it); the first call for another one drops it.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable

_HELD: dict[Hashable, object] = {}
_OPERATOR: list[str] = []
_SHARED: list[dict] = []


def shared_cache(cache: dict) -> dict:
    """Name a module's cache that is to be emptied when another operator starts."""
    _SHARED.append(cache)
    return cache


def only(operator: str) -> None:
    """Drop what other operators have kept in this process."""
    if _OPERATOR != [operator]:
        _OPERATOR[:] = [operator]
        _HELD.clear()
        for cache in _SHARED:
            cache.clear()


def held[T](operator: str, key: Hashable, build: Callable[[], T]) -> T:
    """The state of ``operator`` under ``key``, built once in each process."""
    only(operator)
    if key not in _HELD:
        _HELD[key] = build()
    return _HELD[key]
