"""Registered queries: a Spark function and, where SQL is fit, an equivalent DuckDB statement."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rallyframe.fixtures import Fixtures
from rallyframe.plans.oracle import CTES

SparkQuery = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, SparkQuery] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def with_ctes(body: str) -> str:
    """Prefix a statement with the shared views it names, in dependency order."""
    needed: list[str] = []

    def visit(text: str, inside: str = "") -> None:
        for name in CTES:
            if name not in needed and name != inside and re.search(rf"\b{name}\b", text):
                visit(CTES[name], name)
                if name not in needed:
                    needed.append(name)

    visit(body)
    parts = []
    for n in needed:
        # a recursive view carries its own column list and body
        text = CTES[n].strip()
        parts.append(text if text.startswith(f"{n}(") or text.startswith(f"{n} ") else f"{n} AS MATERIALIZED ({text})")
    body = body.strip()
    if body.upper().startswith("WITH"):
        body = f"SELECT * FROM ({body})"
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn(fx) -> DataFrame`` under ``name``; ``ids`` are the SURVEY rows it covers."""
    def add(fn: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        COVERS[name] = tuple(ids.split())
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def oracles() -> dict[str, str]:
    return {k: with_ctes(v) for k, v in ORACLES.items()}
