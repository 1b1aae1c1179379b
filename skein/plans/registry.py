"""Where queries register: a name, what it runs, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.sources import derive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: str = "") -> Callable:
    """Registers f(derived tables) under a name. sql: the same over the derived tables `uses` names; None where SQL cannot say it."""

    def add(f: Callable[[derive.Derived], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(derive.Derived(spark, sf_dir))
        if sql is not None:
            head = derive.sql(*uses.split())
            body = sql.strip()
            if head and body.startswith("with recursive "):
                head, body = head.replace("with ", "with recursive ", 1).rstrip() + ",\n", body[len("with recursive ") :]
            elif head and body.startswith("with "):
                head, body = head.rstrip() + ",\n", body[len("with ") :]
            ORACLES[name] = head + body
        return f

    return add
