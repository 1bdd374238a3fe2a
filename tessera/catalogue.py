"""All queries of the relational library."""

from __future__ import annotations

import importlib

MODULES = ("plans.pricing", "operators.projection", "operators.joins", "operators.aggregates", "operators.quantiles", "operators.sketches", "operators.sampling", "operators.windows", "operators.ordering", "functions.scalar", "functions.user", "sources.connectors", "streaming.queries", "streaming.state")


def _registries():
    return [importlib.import_module(f"tessera.{m}").R for m in MODULES]


def queries():
    return {k: v for r in _registries() for k, v in r.builders.items()}


def oracle_sql():
    return {k: v for r in _registries() for k, v in r.sql.items()}
