"""Names for loaders, transforms and scorers; a name is taken once."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class Registry:
    """Kinds of things by name (loader, transform, scorer, task, state, path)."""

    def __init__(self) -> None:
        self._things: dict[str, dict[str, Any]] = {}

    def register(self, kind: str, name: str) -> Callable[[Any], Any]:
        def put(thing: Any) -> Any:
            if name in self._things.setdefault(kind, {}):
                raise KeyError(f"{kind} {name} is taken by {self._things[kind][name]!r}")
            self._things[kind][name] = thing
            return thing

        return put

    def get(self, kind: str, name: str, default: Any = None) -> Any:
        return self._things.get(kind, {}).get(name, default)

    def names(self, kind: str) -> list[str]:
        return sorted(self._things.get(kind, {}))

    def unregister(self, kind: str, name: str) -> Any:
        return self._things.get(kind, {}).pop(name, None)


registry = Registry()


def build_splits(spark: SparkSession, loader: str, splits: dict[str, str], transforms: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """{split: table}: a registered loader reads each split's path, the split's registered transforms follow."""
    out = {}
    read = registry.get("loader", loader)
    if read is None:
        raise KeyError(f"no loader {loader}; there are {registry.names('loader')}")
    for split, path in splits.items():
        df = read(spark, path)
        for name in (transforms or {}).get(split, []):
            df = df.transform(registry.get("transform", name))
        out[split] = df
    return out


def register_views(tables: dict[str, DataFrame]) -> None:
    """Tables under their names for SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def table_names(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())
