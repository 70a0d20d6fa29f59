"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# The fixture views as common table expressions, for the SQL side only.
TXN = """b AS (
  SELECT ((l_orderkey*100000 + l_partkey)*10000 + l_suppkey)*10 + l_linenumber AS txn_key,
         l_partkey AS security_id, n_name AS custodian, p_brand AS portfolio,
         l_returnflag AS security_type, o_orderpriority AS currency, p_type AS sector,
         l_quantity, l_extendedprice, l_discount, l_tax, o_totalprice, p_retailprice, p_size, s_acctbal,
         l_shipdate AS ts, o_orderdate,
         CAST(l_discount >= 0.08 AS INT) AS chg_factor,
         CAST(l_tax >= 0.06 AS INT) AS chg_coupon,
         CAST(l_quantity >= 40 AS INT) AS chg_principal,
         CAST(o_orderpriority IN ('1-URGENT','2-HIGH') AS INT) AS chg_date,
         CAST(l_returnflag = 'R' AS INT) AS chg_interest,
         CAST(l_linestatus = 'O' AS INT) AS chg_rating,
         (l_orderkey*7919 + l_partkey*1049 + l_suppkey*31 + l_linenumber*17) % 100 AS n1,
         (l_orderkey*3571 + l_partkey*389  + l_suppkey*97 + l_linenumber*53) % 100 AS n2,
         (l_orderkey*6151 + l_partkey*773  + l_suppkey*13 + l_linenumber*71) % 100 AS n3,
         (l_orderkey*4481 + l_partkey*1877 + l_suppkey*59 + l_linenumber*29) % 100 AS n4
  FROM lineitem
  JOIN orders   ON l_orderkey = o_orderkey
  JOIN part     ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation   ON s_nationkey = n_nationkey),
txn AS (
SELECT b.*,
       CAST(n1 < 5 + 20*chg_factor + 10*chg_coupon + 15*chg_principal + 40*chg_factor*chg_principal AS INT) AS was_exception,
       CAST(n2 < 10 + 35*chg_principal AS INT) AS fld_factor,
       CAST(n3 < 10 + 40*chg_factor + 20*CAST(n2 < 10 + 35*chg_principal AS INT) AS INT) AS fld_coupon,
       CAST(n4 < 8 + 30*chg_date AS INT) AS fld_date,
       CASE WHEN n2 % 7 = 0 THEN NULL ELSE l_extendedprice END AS price_null,
       CASE WHEN n3 % 9 = 0 THEN NULL ELSE sector END AS sector_null,
       (n3*3 + n4) % 100 AS bucket,
       (n3*3 + n4) % 5 AS fold
FROM b)"""
SCORED = (
    TXN
    + """,
scored AS (
SELECT txn_key, was_exception AS y, fld_factor, fld_coupon, fld_date,
       CASE WHEN n4 % 10 = 0 THEN 1 - was_exception ELSE was_exception END AS yhat,
       CASE WHEN n3 % 10 = 0 THEN 1 - fld_factor ELSE fld_factor END AS pred_factor,
       CASE WHEN n4 % 10 = 1 THEN 1 - fld_coupon ELSE fld_coupon END AS pred_coupon,
       CASE WHEN n2 % 10 = 2 THEN 1 - fld_date ELSE fld_date END AS pred_date,
       CAST(0.3 AS DOUBLE)*was_exception + CAST(0.7 AS DOUBLE)*n4/CAST(100.0 AS DOUBLE) AS p
FROM txn)"""
)
TXN_TEXT = (
    TXN
    + """,
txn_text AS (
SELECT txn_key, CASE WHEN n1 % 11 = 0 THEN NULL WHEN n1 % 11 = 1 THEN ''
            WHEN n1 % 3 = 0 THEN concat('c-tx per ', lower(currency), ', ', portfolio)
            WHEN n1 % 3 = 1 THEN concat(portfolio, ' ,, ', security_type)
            ELSE concat(' ', security_type, ',', sector, ' ') END AS text_field
FROM txn)"""
)
EVENTS = """txn_events AS (
SELECT event_id, ts, epoch_us(ts) AS us, user_id AS entity, event_type, value,
       CASE WHEN lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS chg_type,
       CAST(event_type = 'error' AS INT) AS was_exception
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under `name`, with the SQL that must give the same rows (if SQL can say it)."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add
