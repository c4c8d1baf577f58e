"""Objects that a Python worker keeps between the tasks of one stage, and gives up when it works for another stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import TaskContext

_kept: dict = {}
_stage: int | None = None


def tidy() -> None:
    """Drop what an earlier stage kept."""
    global _stage
    task = TaskContext.get()
    now = task.stageId() if task else None
    if now != _stage:
        _kept.clear()
        _stage = now


def per_stage(key: tuple, make: Callable):
    """The worker's object for ``key``, made once a stage."""
    tidy()
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]
