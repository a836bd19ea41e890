"""Pluggable detectors: a name and a function DataFrame → findings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from palisade.operators.sets import append

DETECTORS: dict[str, Callable[..., DataFrame]] = {}


def register_detector(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def keep(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        DETECTORS[name] = fn
        return fn

    return keep


def run_detectors(files: DataFrame, names: Sequence[str]) -> DataFrame:
    """Union of the findings of several detectors."""
    return append(*[DETECTORS[n](files) for n in names])
