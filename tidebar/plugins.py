"""Engines that come from outside: a module is loaded, checked for the functions asked for, and its chain is run.

A step takes a DataFrame and returns one. The module's file is sent to the executors too, so that functions in it may hold
Python for them. What is missing or can't be called is named before anything runs.
"""

from __future__ import annotations

import importlib
import importlib.util
import sys
from collections.abc import Sequence
from pathlib import Path
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

#: The chain that a module must offer to take the place of the wide base's own.
WIDE_STEPS = ("add_anchor_features", "add_larger_bars", "add_core_features", "add_setup_features", "add_sequence_features")


class ContractError(AttributeError):
    pass


def load(spark: SparkSession, source: str, required: Sequence[str]) -> ModuleType:
    """A module by its import name, or by the path of its file, which must offer all the functions."""
    if source.endswith(".py"):
        path = Path(source)
        if not path.exists():
            raise FileNotFoundError(source)
        spec = importlib.util.spec_from_file_location(path.stem, path)
        module = importlib.util.module_from_spec(spec)
        sys.modules[path.stem] = module
        spec.loader.exec_module(module)
        spark.sparkContext.addPyFile(source)
    else:
        module = importlib.import_module(source)
    missing = [n for n in required if not hasattr(module, n)]
    if missing:
        raise ContractError(f"{source}: functions are missing: {', '.join(missing)}")
    if wrong := [n for n in required if not callable(getattr(module, n))]:
        raise ContractError(f"{source}: not functions: {', '.join(wrong)}")
    return module


def run(module: ModuleType, df: DataFrame, steps: Sequence[str], keys: Sequence[str] = ("symbol", "time")) -> DataFrame:
    """df through the module's steps; each must return a DataFrame that still has the keys."""
    for name in steps:
        df = getattr(module, name)(df)
        if not isinstance(df, DataFrame) or (lost := [k for k in keys if k not in df.columns]):
            raise ContractError(f"{module.__name__}.{name}: " + ("no DataFrame" if not isinstance(df, DataFrame) else f"lost {', '.join(lost)}"))
    return df
