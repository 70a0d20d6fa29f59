"""Contingency, lift and profile queries."""


from pyspark.sql import functions as F

from breaklens.operators import profile, stats
from breaklens.plans.parts import (
    FIELD_ROWS,
    LIFTS,
    PAIR_OUT,
    PAIRS,
    SINGLE_OUT,
    SINGLES,
    TRIP_OUT,
    TRIPS,
    flags_txn,
    r6,
    rounded,
    signatures,
)
from breaklens.plans.registry import TXN, register
from breaklens.sources.tables import txn
from breaklens.spec import FLAGS, LABELS, TARGET


def singles(spark, sf):
    return stats.chi2_individual(signatures(spark, sf), FLAGS, TARGET)


def pairs(spark, sf):
    return stats.chi2_pairwise(signatures(spark, sf), FLAGS, TARGET)


def triplets(spark, sf):
    return stats.chi2_triplet(signatures(spark, sf), FLAGS, TARGET)


@register(
    "crosstab",
    f"WITH {TXN} SELECT field, f AS changed, y AS was_exception, count(*) AS n FROM ({FIELD_ROWS}) GROUP BY ALL",
)
def crosstab(spark, sf):
    long = signatures(spark, sf).unpivot([TARGET, "n"], FLAGS, "field", "changed")
    return long.groupBy("field", "changed", TARGET).agg(F.sum("n").alias("n"))


@register(
    "signature_counts",
    f"WITH {TXN} SELECT {', '.join(FLAGS)}, was_exception, count(*) AS n FROM txn GROUP BY ALL",
)
def signature_counts(spark, sf):
    return signatures(spark, sf)


@register("chi2_individual", f"WITH {SINGLES} SELECT {SINGLE_OUT} FROM singles")
def chi2_individual(spark, sf):
    return rounded(singles(spark, sf)).orderBy(F.desc_nulls_last("chi2"), "field")


@register("chi2_pairwise", f"WITH {PAIRS} SELECT {PAIR_OUT} FROM pairs")
def chi2_pairwise(spark, sf):
    return rounded(pairs(spark, sf)).orderBy(F.desc_nulls_last("chi2"), "pair_name")


@register("chi2_triplet", f"WITH {TRIPS} SELECT {TRIP_OUT} FROM trips")
def chi2_triplet(spark, sf):
    return rounded(triplets(spark, sf)).orderBy(F.desc_nulls_last("chi2"), "triplet_name")


# erfc(z) = 1 - 2/sqrt(pi) exp(-z^2) sum 2^n z^(2n+1)/(2n+1)!! for small z, its asymptotic series for large z
_P = f"""{SINGLES}, z AS (SELECT *, sqrt(chi2/2) AS z FROM singles),
  pv AS (SELECT *, CASE WHEN z < 6 THEN 1 - 2/sqrt(pi())*exp(-z*z)*list_sum(list_transform(range(0, 200),
      lambda n: exp(2*n*ln(2) + (2*n+1)*ln(z) + lgamma(n+1) - lgamma(2*n+2))))
    ELSE exp(-z*z)/(z*sqrt(pi()))*(1 - 1/(2*z*z) + 3/(4*power(z,4)) - 15/(8*power(z,6)) + 105/(16*power(z,8))) END AS p FROM z)"""


@register("p_value", f"WITH {_P} SELECT field, round(chi2, 6) AS chi2, round(p, 9) AS p_value FROM pv")
def p_value(spark, sf):
    out = singles(spark, sf).select("field", "chi2", stats.chi2_p_value(F.col("chi2")).alias("p_value"))
    return out.select("field", F.round("chi2", 6).alias("chi2"), F.round("p_value", 9).alias("p_value"))


@register("lift_individual", f"WITH {SINGLES} SELECT field, {r6('lift')} FROM singles")
def lift_individual(spark, sf):
    return rounded(singles(spark, sf).select("field", "lift"))


def lifts(spark, sf):
    return stats.lift_report(signatures(spark, sf), FLAGS, TARGET)


@register("lift_pairwise", f"WITH {LIFTS} SELECT field_1, field_2, {r6('lift_pair')} FROM lift_report")
def lift_pairwise(spark, sf):
    return rounded(lifts(spark, sf).select("field_1", "field_2", "lift_pair"))


@register(
    "lift_interaction",
    f"WITH {LIFTS} SELECT field_1, field_2, {r6('expected_independent', 'lift_interaction')} FROM lift_report",
)
def lift_interaction(spark, sf):
    return rounded(lifts(spark, sf).select("field_1", "field_2", "expected_independent", "lift_interaction"))


_DBL = ["rate_1", "rate_2", "rate_not_1", "rate_not_2", "rate_both", "rate_not_both", "lift_1", "lift_2", "lift_pair"]


@register(
    "lift_report",
    f"""WITH {LIFTS} SELECT field_1, field_2, total, breaks, changes_1, changes_2, cases_both,
        {r6(*_DBL, 'expected_independent', 'lift_interaction')}, interaction, action FROM lift_report""",
)
def lift_report(spark, sf):
    return rounded(lifts(spark, sf))


@register(
    "base_rates",
    f"""WITH {TXN} SELECT name, count(*) AS rows, CAST(sum(f) AS BIGINT) AS positives, round(avg(f), 6) AS rate FROM
        ({' UNION ALL '.join(f"SELECT '{c}' AS name, {c} AS f FROM txn" for c in [TARGET, *FLAGS])}) GROUP BY 1""",
)
def base_rates(spark, sf):
    return rounded(profile.base_rates(signatures(spark, sf), FLAGS, TARGET))


@register(
    "field_target_corr",
    f"WITH {TXN} SELECT field, round(abs(corr(f, y)), 6) AS importance FROM ({FIELD_ROWS}) GROUP BY 1",
)
def field_target_corr(spark, sf):
    cells = stats.field_cells(signatures(spark, sf), FLAGS, TARGET)
    return rounded(cells.select("field", F.abs(profile.phi(cells)).alias("importance")))


@register(
    "label_corr_matrix",
    f"WITH {TXN} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS field_1, '{b}' AS field_2, round(corr({a}, {b}), 6) AS correlation FROM txn"
        for a in LABELS
        for b in LABELS
    ),
)
def label_corr_matrix(spark, sf):
    return rounded(profile.label_corr_matrix(txn(spark, sf, LABELS), LABELS))


@register(
    "label_combinations",
    f"""WITH {TXN}, g AS (SELECT {', '.join(LABELS)}, count(*) AS n FROM txn GROUP BY ALL)
        SELECT array_to_string(list_filter([{', '.join(f"CASE WHEN {c}=1 THEN '{c}' END" for c in LABELS)}], lambda x: x IS NOT NULL), '|') AS active,
        n, round(n/(SELECT sum(n) FROM g), 6) AS share FROM g ORDER BY n DESC, active LIMIT 10""",
)
def label_combinations(spark, sf):
    return rounded(profile.label_combinations(txn(spark, sf, LABELS), LABELS))


@register(
    "label_cardinality",
    f"""WITH {TXN} SELECT round(avg(fld_factor+fld_coupon+fld_date), 6) AS mean_labels, count_if(fld_factor+fld_coupon+fld_date=0) AS rows_without,
        count_if(fld_factor+fld_coupon+fld_date=3) AS rows_with_all FROM txn""",
)
def label_cardinality(spark, sf):
    return rounded(profile.label_cardinality(txn(spark, sf, LABELS), LABELS))


_RATES = f"""{TXN}, rates AS (SELECT field, avg(y) FILTER (f=1) AS rate_with, avg(y) FILTER (f=0) AS rate_without,
    avg(y) FILTER (f=1)/((SELECT avg(was_exception) FROM txn) + 1e-10) AS lift, CAST(sum(f) AS BIGINT) AS support FROM ({FIELD_ROWS}) GROUP BY 1)"""


@register(
    "change_break_rates",
    f"WITH {_RATES} SELECT field, {r6('rate_with', 'rate_without', 'lift')}, support FROM rates WHERE rate_with > 0.3",
)
def change_break_rates(spark, sf):
    return rounded(profile.change_break_rates(stats.field_cells(signatures(spark, sf), FLAGS, TARGET), 0.3))


@register("cond_prob", f"WITH {_RATES} SELECT field, round(rate_with, 6) AS p_break_given_change FROM rates")
def cond_prob(spark, sf):
    r = profile.change_break_rates(stats.field_cells(signatures(spark, sf), FLAGS, TARGET), -1.0)
    return rounded(r.select("field", F.col("rate_with").alias("p_break_given_change")))


_PCT = ["l_quantity", "l_extendedprice", "l_discount"]


@register(
    "percentile_range",
    f"WITH {TXN} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(quantile_cont({c}, 0.25) FILTER (was_exception=1), 4) AS p25,
        round(quantile_cont({c}, 0.75) FILTER (was_exception=1), 4) AS p75, round(avg({c}) FILTER (was_exception=1), 4) AS positive_mean,
        round(avg({c}) FILTER (was_exception=0), 4) AS negative_mean FROM txn"""
        for c in _PCT
    ),
)
def percentile_range(spark, sf):
    return rounded(profile.percentile_range(txn(spark, sf, [TARGET, *_PCT]), TARGET, _PCT), 4)


@register(
    "pair_chi2_matrix",
    f"""WITH {PAIRS}, t AS (SELECT field_1, field_2, chi2 FROM pairs ORDER BY chi2 DESC, field_1, field_2 LIMIT 20),
        m AS (SELECT field_1 AS field, field_2 AS other, chi2 FROM t WHERE chi2 <> 0 UNION ALL SELECT field_2, field_1, chi2 FROM t WHERE chi2 <> 0)
        SELECT field, {', '.join(f"round(max(chi2) FILTER (other='{c}'), 6) AS {c}" for c in FLAGS)} FROM m GROUP BY 1""",
)
def pair_chi2_matrix(spark, sf):
    return rounded(profile.pair_chi2_matrix(pairs(spark, sf), FLAGS, 20))


@register(
    "break_rate_comparison",
    f"""WITH {TRIPS} SELECT 'individual' AS category, field AS name, round(rate_1,6) AS break_rate FROM (SELECT * FROM singles ORDER BY chi2 DESC, field LIMIT 5)
        UNION ALL SELECT 'pair', pair_name, round(rate_1,6) FROM (SELECT * FROM pairs ORDER BY chi2 DESC, pair_name LIMIT 5)
        UNION ALL SELECT 'triplet', triplet_name, round(rate_1,6) FROM (SELECT * FROM trips ORDER BY chi2 DESC, triplet_name LIMIT 3)""",
)
def break_rate_comparison(spark, sf):
    return rounded(profile.break_rate_comparison(singles(spark, sf), pairs(spark, sf), triplets(spark, sf)))


@register(
    "volcano_table",
    f"""WITH {_P} SELECT field, {r6('cramers_v', 'lift')}, round(rate_1, 6) AS rate_changed,
        CASE WHEN p > 0 THEN round(-log10(p), 4) ELSE 'Infinity'::DOUBLE END AS neg_log10_p FROM pv""",
)
def volcano_table(spark, sf):
    s = singles(spark, sf).select(
        "field", "cramers_v", "lift", "rate_changed", stats.chi2_p_value(F.col("chi2")).alias("p_value")
    )
    log_p = F.when(F.col("p_value") > 0, F.round(-F.log10("p_value"), 4)).otherwise(F.lit(float("inf")))
    exact = [F.round(c, 6).alias(c) for c in ("cramers_v", "lift", "rate_changed")]
    return s.select("field", *exact, log_p.alias("neg_log10_p"))


@register(
    "rate_interval",
    f"""WITH {TXN}, g AS (SELECT {' || '.join(f'CAST({c} AS VARCHAR)' for c in FLAGS)} AS pattern, CAST(sum(was_exception) AS BIGINT) AS breaks, count(*) AS cases FROM txn GROUP BY 1),
        w AS (SELECT *, breaks/cases AS p, 1.959963984540054::DOUBLE AS z FROM g)
        SELECT pattern, breaks, cases, round(p, 6) AS rate,
        round((p + z*z/(2*cases) - z*sqrt(p*(1-p)/cases + z*z/(4.0*cases*cases)))/(1+z*z/cases), 6) AS low,
        round((p + z*z/(2*cases) + z*sqrt(p*(1-p)/cases + z*z/(4.0*cases*cases)))/(1+z*z/cases), 6) AS high FROM w""",
)
def rate_interval(spark, sf):
    return rounded(profile.rate_interval(signatures(spark, sf), FLAGS, TARGET))


_PN, _PT = ["price_null", "s_acctbal", "p_size"], ["currency", "portfolio", "sector_null"]


@register(
    "data_profile",
    f"WITH {TXN} "
    + " UNION ALL ".join(
        [
            f"""SELECT '{c}' AS column_name, round(count_if({c} IS NULL)/count(*), 6) AS null_share, count_if({c} < 0) AS negatives,
            count_if({c} IN (-999, 0)) AS sentinels, CAST(NULL AS BIGINT) AS formats FROM txn"""
            for c in _PN
        ]
        + [
            f"""SELECT '{c}', round(count_if({c} IS NULL)/count(*), 6), NULL, NULL,
            count(DISTINCT regexp_replace(regexp_replace({c}, '[A-Za-z]+', 'a', 'g'), '[0-9]+', '9', 'g')) FROM txn"""
            for c in _PT
        ]
    ),
)
def data_profile(spark, sf):
    return rounded(profile.data_profile(txn(spark, sf, [*_PN, *_PT]), _PN, _PT, [-999.0, 0.0]))


@register(
    "temporal_break_profile",
    f"""WITH {TXN}, d AS (SELECT *, last_day(CAST(ts AS DATE)) - CAST(ts AS DATE) < 3 AS me, month(ts) % 3 = 0 AS q FROM txn)
        SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, round(avg(was_exception), 6) AS break_rate,
        round(avg(was_exception) FILTER (me), 6) AS month_end_rate, round(avg(was_exception) FILTER (me AND q), 6) AS quarter_end_rate,
        round(avg(l_extendedprice) FILTER (was_exception=1), 2) AS mean_severity, round(max(l_extendedprice) FILTER (was_exception=1), 2) AS max_severity
        FROM d GROUP BY 1""",
)
def temporal_break_profile(spark, sf):
    t = txn(spark, sf, ["ts", TARGET, "l_extendedprice"])
    out = profile.temporal_break_profile(t, "ts", TARGET, "l_extendedprice")
    return out.withColumns(
        {c: F.round(c, 6) for c in ("break_rate", "month_end_rate", "quarter_end_rate")}
        | {c: F.round(c, 2) for c in ("mean_severity", "max_severity")}
    )
