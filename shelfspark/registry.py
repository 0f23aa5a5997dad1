"""Stages and methods that users add by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points

_STAGES: dict[str, Callable] = {}
_loaded = False


def register(name: str, stage: Callable) -> None:
    _STAGES[name] = stage


def is_registered(name: str) -> bool:
    return name in _STAGES


def names() -> list[str]:
    return sorted(_STAGES)


def resolve(name: str) -> Callable:
    """The stage of a name; one that isn't there raises only when it is called."""

    def missing(*_args, **_more):
        raise LookupError(f"no stage is registered as {name!r}")

    return _STAGES.get(name, missing)


def load_plugins(group: str = "shelfspark.stages") -> int:
    """Loads what installed packages offer, once; each entry point is called with ``register``."""
    global _loaded
    if _loaded:
        return 0
    _loaded = True
    found = list(entry_points(group=group))
    for e in found:
        e.load()(register)
    return len(found)


def reset() -> None:
    global _loaded
    _STAGES.clear()
    _loaded = False
