"""Registry of checkable queries: a Spark function and, where SQL can say it, SQL.

The SQL states each operator in its plain textbook form (one window per
symbol, pairwise joins), independently of how the Spark side distributes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def rnd(c: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, keys: list[str], cols: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[rnd(f"`{c}`", digits).alias(c) for c in cols])


def r_sql(expr: str, alias: str, digits: int = 6) -> str:
    return f'round({expr}, {digits}) + 0.0 AS "{alias}"'


# -- panels as SQL ----------------------------------------------------------

TRADES = """
trades AS (
  SELECT l_suppkey AS symbol_id, CAST(step // 12 AS INTEGER) AS date_id, CAST(step % 12 AS INTEGER) AS time_id,
         sum(l_quantity) AS weight,
         ln(1 + sum(l_extendedprice) / 1000) AS feature_00,
         sqrt(0.01 + avg(l_discount)) AS feature_01,
         ln(1 + CAST(count(*) AS DOUBLE)) AS feature_02,
         ln(max(CASE WHEN l_discount > 0.015 THEN l_quantity END)) AS feature_03,
         sqrt(0.01 + avg(l_tax)) AS feature_04,
         ln(avg(l_extendedprice) / 1000) AS feature_05
  FROM (SELECT *, datediff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) // 7 AS step FROM lineitem)
  GROUP BY 1, 2, 3)"""

ACTIVITY_CELLS = """
cells AS (
  SELECT user_id % 8 AS symbol_id,
         CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS date_id,
         CAST(hour(ts) AS INTEGER) AS time_id,
         CAST(count(*) AS DOUBLE) AS weight,
         ln(1 + sum(value)) AS feature_00, ln(1 + avg(value)) AS feature_01,
         ln(1 + CAST(count(*) AS DOUBLE)) AS feature_02, ln(1 + max(value)) AS feature_03,
         sqrt(CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE)) AS feature_04
  FROM events GROUP BY 1, 2, 3)"""

ACTIVITY = ACTIVITY_CELLS + """,
activity AS (
  SELECT s.symbol_id, CAST(d.date_id AS INTEGER) AS date_id, CAST(t.time_id AS INTEGER) AS time_id,
         coalesce(c.weight, 0.0) AS weight, c.feature_00, c.feature_01, c.feature_02, c.feature_03, c.feature_04
  FROM (SELECT DISTINCT symbol_id FROM cells) s
  CROSS JOIN (SELECT unnest(range(min(date_id), max(date_id) + 1)) AS date_id FROM cells) d CROSS JOIN (SELECT unnest(range(24)) AS time_id) t
  LEFT JOIN cells c ON c.symbol_id = s.symbol_id AND c.date_id = d.date_id AND c.time_id = t.time_id)"""


def _fwd(u: str, k: int) -> str:
    w = f"(PARTITION BY symbol_id ORDER BY date_id, time_id ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)"
    return f"CASE WHEN count({u}) OVER {w} = {k} THEN avg({u}) OVER {w} END"


def labelled_cte(panel: str, a: tuple[str, float], b: tuple[str, float]) -> str:
    ua, ub = f"({a[0]} - {a[1]})", f"({b[0]} - {b[1]})"
    labels = ", ".join(f"{_fwd(u, k)} AS responder_{r}" for u, rs in ((ua, {6: 20, 7: 120, 8: 4}), (ub, {3: 20, 4: 120, 5: 4}))
                       for r, k in rs.items())
    return f"""
labels AS (SELECT *, {labels} FROM {panel}),
labelled AS (SELECT *, responder_3 - responder_6 AS responder_0, responder_4 - responder_7 AS responder_1,
             responder_5 - responder_8 AS responder_2 FROM labels)"""


TRADES_LABELLED = TRADES + "," + labelled_cte("trades", ("feature_00", 4.2), ("feature_05", 3.8))
ACTIVITY_LABELLED = ACTIVITY + "," + labelled_cte("activity", ("feature_01", 3.6), ("feature_03", 3.9))

WS = "(PARTITION BY symbol_id ORDER BY date_id, time_id)"
WSD = "(PARTITION BY symbol_id, date_id ORDER BY time_id)"
WDT = "(PARTITION BY date_id, time_id)"


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip().rstrip(",") for c in ctes) + "\n"


K = ["symbol_id", "date_id", "time_id"]
KSQL = "symbol_id, date_id, time_id"
