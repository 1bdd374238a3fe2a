"""Queries are declared once, builder and SQL side by side, so that their names and columns cannot drift apart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    builders: dict[str, Builder] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Builder], Builder]:
        """Register a builder under its own name, with the SQL it must agree with."""

        def add(builder: Builder) -> Builder:
            key = name or builder.__name__
            if key in self.builders:
                raise ValueError(f"{key} is registered twice")
            self.builders[key] = builder
            if sql:
                self.sql[key] = sql
            return builder

        return add
