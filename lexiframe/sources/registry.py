"""Dataset registry: name -> loader, text and label columns, class count.

A loader returns a DataFrame ``(key, text, label[, split])``.  Registering a
dataset also makes it a temp view, so it can be queried in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    loader: Callable[[SparkSession], DataFrame]
    num_classes: int
    key: str = "key"
    text: str = "text"
    label: str = "label"


class Registry:
    def __init__(self):
        self._specs: dict[str, DatasetSpec] = {}

    def register(self, spec: DatasetSpec) -> None:
        self._specs[spec.name] = spec

    def names(self) -> list[str]:
        return sorted(self._specs)

    def spec(self, name: str) -> DatasetSpec:
        if name not in self._specs:
            raise KeyError(f"unknown dataset {name!r}; known: {self.names()}")
        return self._specs[name]

    def load(self, spark: SparkSession, name: str, view: bool = True) -> DataFrame:
        spec = self.spec(name)
        df = spec.loader(spark)
        if view:
            df.createOrReplaceTempView(name)
        return df
