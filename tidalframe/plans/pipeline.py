"""Pipelines: named steps from frame to frame, applied in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Pipeline:
    """Steps are (name, f) with f(frame) -> frame; the result is one lazy plan."""

    def __init__(self, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]]):
        names = [n for n, _ in steps]
        if len(set(names)) != len(names):
            raise ValueError(f"step names repeat: {names}")
        self.steps = list(steps)

    def __len__(self) -> int:
        return len(self.steps)

    def __getitem__(self, at):
        return Pipeline(self.steps[at]) if isinstance(at, slice) else self.steps[at][1] if isinstance(at, int) else dict(self.steps)[at]

    def run(self, frame: DataFrame) -> DataFrame:
        for _, f in self.steps:
            frame = f(frame)
        return frame
