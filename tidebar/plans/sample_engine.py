"""A plug-in that offers the chain of the wide base by the built-in operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidebar.operators import wide

LARGER = {"h1": "1 hour", "h4": "4 hours", "d1": "1 day"}
_source: list[Callable[[str], DataFrame]] = []


def configure(bars_of: Callable[[str], DataFrame]) -> None:
    """Where bars of a larger width come from."""
    _source[:] = [bars_of]


def add_anchor_features(df: DataFrame) -> DataFrame:
    return wide.anchor(df)


def add_larger_bars(df: DataFrame) -> DataFrame:
    return wide.with_larger(df, {n: (_source[0](w), w) for n, w in LARGER.items()})


def add_core_features(df: DataFrame) -> DataFrame:
    return wide.core(df, list(LARGER))


def add_setup_features(df: DataFrame) -> DataFrame:
    return wide.setup(df)


def add_sequence_features(df: DataFrame) -> DataFrame:
    return wide.sequences(df)
