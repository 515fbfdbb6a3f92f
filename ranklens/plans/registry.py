"""Registry of named queries: a Spark builder and, where SQL can state it, the equivalent SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklens.plans import domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t)``, where ``t`` holds the domain tables of a folder."""

    def wrap(fn: Callable[[domain.Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(domain.tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_domain(sql)
        return fn

    return wrap


def rows_n(name: str = "n") -> Column:
    """Row count, named."""
    return F.count(F.lit(1)).alias(name)


def with_domain(sql: str) -> str:
    """Prefix a statement with the domain tables it mentions, directly or through other tables.

    ``{CTES}`` marks the place in statements that open their own WITH list.
    """
    needed, queue = set(), [sql]
    while queue:
        words = set(re.findall(r"[a-z_0-9]+", queue.pop().lower()))
        for name in domain.CTES:
            if name in words and name not in needed:
                needed.add(name)
                queue.append(domain.CTES[name])
    ctes = ", ".join(f"{name} AS ({body})" for name, body in domain.CTES.items() if name in needed)
    body = sql.strip()
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {ctes}{', ' if ctes else ''}{re.sub(r'(?i)^with\s+recursive\s+', '', body)}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {ctes}{', ' if ctes else ''}{re.sub(r'(?i)^with\s+', '', body)}"
    return f"WITH {ctes} {body}" if ctes else body
