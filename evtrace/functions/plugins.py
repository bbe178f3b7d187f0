"""Detectors and scores that users add by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

DETECTORS: dict[str, tuple[Callable, str]] = {}
SCORES: dict[str, Callable[..., Column]] = {}


def register_detector(name: str, detect: Callable, schema: str) -> None:
    """detect takes one pandas frame of rows and returns one of any number of rows in schema."""
    DETECTORS[name] = (detect, schema)


def detect(rows: DataFrame, name: str) -> DataFrame:
    """A registered detector over batches of rows; KeyError for an unknown name."""
    f, schema = DETECTORS[name]
    return rows.mapInPandas(lambda batches: (f(b) for b in batches), schema)


def register_score(name: str, score: Callable[..., Column]) -> None:
    """score takes columns and returns one, so that it stays in the plan."""
    SCORES[name] = score


def score(name: str, *columns: Column) -> Column:
    return SCORES[name](*columns)
