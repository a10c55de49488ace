"""Registered queries: each family module holds (Spark callable, oracle SQL or None) per name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FAMILIES = ["sources", "recode", "rules", "profile", "pairs", "effects", "post", "models"]


def load() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}
    for family in FAMILIES:
        try:
            module = import_module(f"panelstat.registry.{family}")
        except ModuleNotFoundError as e:
            if e.name != f"panelstat.registry.{family}":
                raise
            continue
        for name, entry in module.QUERIES.items():
            if name in out:
                raise ValueError(f"duplicate query name {name}")
            out[name] = entry
    return out
