"""Queries by name, the relations they read, and the SQL they are held against.

A relation is bound to the driver's tables by one portable SELECT, which Spark and DuckDB both run; operators are
DataFrame code on one side and independent SQL on the other.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_RAW: dict[str, str] = {}
RELATIONS: dict[str, str] = {}


def relation(name: str, select: str) -> None:
    RELATIONS[name] = " ".join(select.split())


def _parts(name: str) -> list[str]:
    """Relations that ``name`` is made of, innermost first, and itself."""
    found: list[str] = []
    for word in re.findall(r"\b[a-z_0-9]+\b", RELATIONS[name]):
        if word in RELATIONS and word != name:
            found += [x for x in _parts(word) if x not in found]
    return [*found, name]


class Bound:
    """The relations of one dataset: ``data.entries_a`` is a DataFrame, read when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._have = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._have:
            if name in TABLES:
                self._have[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in RELATIONS:
                text = RELATIONS[name].replace("sha256(", "sha2x(")
                used = [w for w in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", text)) if w in TABLES or (w in RELATIONS and w != name)]
                for w in used:
                    text = re.sub(rf"(?<=FROM )\b{w}\b|(?<=JOIN )\b{w}\b", f"{{{w}}}", text)
                text = re.sub(r"sha2x\(((?:[^()]|\([^()]*\))*)\)", r"sha2(\1, 256)", text)
                self._have[name] = self.spark.sql(text, **{w: getattr(self, w) for w in used if f"{{{w}}}" in text})
            else:
                raise AttributeError(name)
        return self._have[name]


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``f(data)``; ``sql`` may use tables and relations."""

    def register(f: Callable[[Bound], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Bound(spark, sf_dir))
        if sql is not None:
            _RAW[name] = sql
        return f

    return register


def oracle_sql() -> dict[str, str]:
    """Each query's SQL with the relations it uses in front."""
    out = {}
    for name, sql in _RAW.items():
        used: list[str] = []
        for word in re.findall(r"\b[a-z_0-9]+\b", sql):
            if word in RELATIONS:
                used += [x for x in _parts(word) if x not in used]
        head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
        recursive = "RECURSIVE " if head and head[1] else ""
        body = sql[head.end():] if head else sql.strip()
        parts = [f"{n} AS ({RELATIONS[n]})" for n in used]
        out[name] = f"WITH {recursive}" + ", ".join([*parts, body]) if head else (f"WITH {', '.join(parts)} " if parts else "") + body
    return out
