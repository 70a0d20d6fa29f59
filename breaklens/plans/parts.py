"""Pieces shared by the plans: rounding, the signature scan and repeated SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breaklens.operators.stats import signature_counts
from breaklens.plans.registry import TXN
from breaklens.sources.tables import txn
from breaklens.spec import FLAGS, TARGET


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that results do not depend on summation order."""
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])


def flags_txn(spark: SparkSession, sf: str, extra: list[str] | None = None) -> DataFrame:
    return txn(spark, sf, [*FLAGS, TARGET, *(extra or [])])


def signatures(spark: SparkSession, sf: str) -> DataFrame:
    return signature_counts(flags_txn(spark, sf), FLAGS, TARGET)


_CELLS = """CAST(count_if(f=1 AND y=1) AS DOUBLE) AS n11, CAST(count_if(f=1 AND y=0) AS DOUBLE) AS n10,
         CAST(count_if(f=0 AND y=1) AS DOUBLE) AS n01, CAST(count_if(f=0 AND y=0) AS DOUBLE) AS n00"""


def assoc_sql(keys: str, src: str, having: str = "true") -> str:
    """Association measures per key group from rows (keys, f, y), straight from their definitions."""
    return f"""SELECT *, CASE WHEN chi2 > 10.827566170662733 THEN 'Highly Significant (p<0.001)'
        WHEN chi2 > 6.6348966010212145 THEN 'Very Significant (p<0.01)'
        WHEN chi2 > 3.841458820694124 THEN 'Significant (p<0.05)'
        WHEN chi2 > 2.705543454095404 THEN 'Marginally Significant (p<0.1)'
        WHEN chi2 IS NOT NULL THEN 'Not Significant (p>=0.1)' END AS significance,
        sqrt(chi2 / (n11+n10+n01+n00)) AS cramers_v,
        n11*n00/(n10*n01) AS odds_ratio,
        n11/(n11+n10) AS rate_1, n01/(n01+n00) AS rate_0,
        (n11/(n11+n10))/(n01/(n01+n00)) AS lift
      FROM (SELECT {keys}, n11, n10, n01, n00,
        power(greatest(abs(n11-e11)-0.5,0),2)/e11 + power(greatest(abs(n10-e10)-0.5,0),2)/e10 +
        power(greatest(abs(n01-e01)-0.5,0),2)/e01 + power(greatest(abs(n00-e00)-0.5,0),2)/e00 AS chi2
        FROM (SELECT *, (n11+n10)*(n11+n01)/(n11+n10+n01+n00) AS e11, (n11+n10)*(n10+n00)/(n11+n10+n01+n00) AS e10,
                     (n01+n00)*(n11+n01)/(n11+n10+n01+n00) AS e01, (n01+n00)*(n10+n00)/(n11+n10+n01+n00) AS e00
              FROM (SELECT {keys}, {_CELLS} FROM ({src}) GROUP BY {keys} HAVING {having})))"""


FIELD_ROWS = " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS f, was_exception AS y FROM txn" for c in FLAGS)
PAIR_ROWS = " UNION ALL ".join(
    f"SELECT '{a}' AS field_1, '{b}' AS field_2, {a}*{b} AS f, was_exception AS y FROM txn"
    for a, b in combinations(FLAGS, 2)
)
TRIPLE_ROWS = " UNION ALL ".join(
    f"SELECT '{a}' AS field_1, '{b}' AS field_2, '{c}' AS field_3, {a}*{b}*{c} AS f, was_exception AS y FROM txn"
    for a, b, c in combinations(FLAGS, 3)
)

# singles(field, ...), pairs(field_1, field_2, ..., interaction_lift), trips(...)
SINGLES = f"{TXN},\n singles AS ({assoc_sql('field', FIELD_ROWS)})"
PAIRS = f"""{SINGLES},
 pairs AS (SELECT p.*, concat(field_1, ' + ', field_2) AS pair_name, n11+n10 AS cases,
            CASE WHEN greatest(s1.rate_1, s2.rate_1) > 0 THEN p.rate_1/greatest(s1.rate_1, s2.rate_1) ELSE 0 END AS interaction_lift
   FROM ({assoc_sql('field_1, field_2', PAIR_ROWS, 'count_if(f=1) > 0')}) p
   JOIN (SELECT field, rate_1 FROM singles) s1 ON p.field_1 = s1.field
   JOIN (SELECT field, rate_1 FROM singles) s2 ON p.field_2 = s2.field)"""
TRIPS = f"""{PAIRS},
 tops AS (SELECT DISTINCT unnest([field_1, field_2]) AS field FROM
    (SELECT * FROM pairs ORDER BY chi2 DESC, field_1, field_2 LIMIT 10)),
 trips AS (SELECT *, concat(field_1, ' + ', field_2, ' + ', field_3) AS triplet_name, n11+n10 AS cases
   FROM ({assoc_sql('field_1, field_2, field_3', TRIPLE_ROWS, 'count_if(f=1) >= 5')})
   WHERE field_1 IN (SELECT field FROM tops) AND field_2 IN (SELECT field FROM tops)
     AND field_3 IN (SELECT field FROM tops))"""
LIFT_ROWS = " UNION ALL ".join(
    f"SELECT '{a}' AS field_1, '{b}' AS field_2, {a} AS f1, {b} AS f2, was_exception AS y FROM txn"
    for a, b in combinations(FLAGS, 2)
)
LIFTS = f"""{TXN},
 rates AS (SELECT field_1, field_2, count(*) AS total, sum(y)::BIGINT AS breaks, sum(f1)::BIGINT AS changes_1,
   sum(f2)::BIGINT AS changes_2, count_if(f1=1 AND f2=1) AS cases_both,
   avg(y) FILTER (f1=1) AS rate_1, avg(y) FILTER (f2=1) AS rate_2,
   avg(y) FILTER (f1=0) AS rate_not_1, avg(y) FILTER (f2=0) AS rate_not_2,
   coalesce(avg(y) FILTER (f1=1 AND f2=1), 0) AS rate_both, avg(y) FILTER (f1*f2=0) AS rate_not_both
   FROM ({LIFT_ROWS}) GROUP BY ALL),
 lifts AS (SELECT *, rate_1/rate_not_1 AS lift_1, rate_2/rate_not_2 AS lift_2, rate_both/rate_not_both AS lift_pair,
   rate_1+rate_2-rate_1*rate_2 AS expected_independent, rate_both/(rate_1+rate_2-rate_1*rate_2) AS lift_interaction
   FROM rates),
 lift_report AS (SELECT *, CASE WHEN lift_interaction > 1.2 THEN 'synergistic' WHEN lift_interaction < 0.8 THEN 'interference'
     ELSE 'additive' END AS interaction,
   CASE WHEN lift_pair > 3 AND cases_both >= 10 THEN 'alert' WHEN lift_1 > 2 OR lift_2 > 2 THEN 'monitor' ELSE 'none' END AS action
   FROM lifts)"""


def r6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def big(*cols: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cols)


SINGLE_OUT = (
    f"field, {big('n11', 'n10', 'n01', 'n00')}, {r6('chi2', 'cramers_v', 'odds_ratio')}, "
    "round(rate_1,6) AS rate_changed, round(rate_0,6) AS rate_not_changed, round(lift,6) AS lift, significance"
)
PAIR_OUT = (
    f"field_1, field_2, pair_name, {big('n11', 'n10', 'n01', 'n00', 'cases')}, {r6('chi2', 'cramers_v')}, "
    "round(rate_1,6) AS rate_both, round(rate_0,6) AS rate_not_both, round(lift,6) AS lift, "
    "round(interaction_lift,6) AS interaction_lift, significance"
)
TRIP_OUT = (
    f"field_1, field_2, field_3, triplet_name, {big('n11', 'n10', 'n01', 'n00', 'cases')}, "
    f"{r6('chi2', 'cramers_v', 'odds_ratio')}, round(rate_1,6) AS rate_changed, round(rate_0,6) AS rate_not_changed, "
    "round(lift,6) AS lift, significance"
)
