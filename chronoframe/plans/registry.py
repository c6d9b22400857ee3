"""Name → query and name → DuckDB SQL of the engine's own operators, over the adapter views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoframe.plans import queries as q
from chronoframe.plans.oracles import ORACLES as _SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(q.QUERIES)
ORACLES: dict[str, str] = {k: v for k, v in _SQL.items() if k in QUERIES}
