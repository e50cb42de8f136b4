"""Connectors that fetch datasets, and their registry."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: FIXED VALUES: the form of a connector's id; the most reviews that one fetch returns.
ID_FORM = r"[a-z0-9][a-z0-9-]*"
MOST_REVIEWS = 2000


class ConnectorDefinitionError(TypeError):
    """A connector lacks something, or its id is taken."""


class ConnectorNotFoundError(LookupError):
    """No connector supports a source."""


class ConnectorError(RuntimeError):
    """A store did not answer as it should."""

    def __init__(self, message: str, store: str, status: int = 502, retryable: bool = False):
        super().__init__(message)
        self.store, self.status, self.retryable = store, status, retryable


@dataclass(frozen=True)
class Source:
    store: str
    app_id: str
    country: str | None = None
    language: str | None = None
    canonical_url: str | None = None


@dataclass
class Dataset:
    """An application, its raw review records (any shape that reviews.normalize accepts) and what is known of the fetch."""

    app: dict[str, Any]
    reviews: DataFrame
    metadata: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Connector:
    """id, name, version, supports(source) and fetch(spark, source, options)."""

    id: str
    name: str
    supports: Callable[[Source], bool]
    fetch: Callable[[SparkSession, Source, dict], Dataset]
    version: str | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.id, str) or not re.fullmatch(ID_FORM, self.id):
            raise ConnectorDefinitionError(f"{self.id!r} is not a connector id.")
        if not isinstance(self.name, str) or not self.name.strip():
            raise ConnectorDefinitionError("A connector needs a name.")
        if not callable(self.supports) or not callable(self.fetch):
            raise ConnectorDefinitionError("A connector needs the functions supports and fetch.")


class Registry:
    """Connectors in the order in which they were registered; the first that supports a source serves it."""

    def __init__(self, connectors: list[Connector] | None = None):
        self._all: dict[str, Connector] = {}
        for connector in connectors or []:
            self.register(connector)

    def register(self, connector: Connector) -> Registry:
        if not isinstance(connector, Connector):
            raise ConnectorDefinitionError("Not a connector.")
        if connector.id in self._all:
            raise ConnectorDefinitionError(f"Connector {connector.id} is registered already.")
        self._all[connector.id] = connector
        return self

    def unregister(self, name: str) -> bool:
        return self._all.pop(name, None) is not None

    def get(self, name: str) -> Connector | None:
        return self._all.get(name)

    def resolve(self, source: Source) -> Connector:
        for connector in self._all.values():
            if connector.supports(source):
                return connector
        raise ConnectorNotFoundError(f"No connector supports {source.store}.")

    def list(self) -> list[dict[str, str | None]]:
        return [{"id": c.id, "name": c.name, "version": c.version} for c in self._all.values()]


def checked_limit(limit: Any, most: int = MOST_REVIEWS) -> int:
    """A limit between 1 and most; most for anything that is no number."""
    try:
        return max(1, min(most, int(limit)))
    except (TypeError, ValueError):
        return most


def demo_connector() -> Connector:
    from . import demo

    def fetch(spark: SparkSession, source: Source, options: dict) -> Dataset:
        other = source.app_id == "competitor"
        rows = (demo.demo_competitor_reviews if other else demo.demo_reviews)(spark, int(options.get("limit") or (84 if other else 96)))
        return Dataset(dict(demo.OTHER if other else demo.APP), rows, {"connector": "demo", "connector_version": "1", "fixture": True})

    return Connector("demo", "Deterministic offline demo", lambda s: s.store == "demo", fetch, "1")


def default_registry(include_demo: bool = False) -> Registry:
    """The two stores' connectors, with the demo on request."""
    from .stores import apple_connector, google_connector

    registry = Registry([apple_connector(), google_connector()])
    return registry.register(demo_connector()) if include_demo else registry
