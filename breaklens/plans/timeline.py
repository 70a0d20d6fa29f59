"""Top-k, ordering and time-series queries."""

from pyspark.sql import functions as F

from breaklens.operators import temporal
from breaklens.plans.parts import PAIRS, rounded
from breaklens.plans.registry import EVENTS, SCORED, register
from breaklens.plans.statistics import pairs
from breaklens.sources.tables import event_blocks, raw_events, scored, txn_events, with_type_change


@register(
    "topk_sorted",
    f"WITH {PAIRS} SELECT pair_name, round(chi2, 6) AS chi2 FROM pairs ORDER BY pairs.chi2 DESC, pair_name LIMIT 10",
)
def topk_sorted(spark, sf):
    p = pairs(spark, sf).orderBy(F.desc_nulls_last("chi2"), "pair_name").limit(10)
    return rounded(p.select("pair_name", "chi2"))


@register("topk_risk", f"WITH {SCORED} SELECT txn_key, round(p, 6) AS p FROM scored ORDER BY scored.p DESC, txn_key LIMIT 10")
def topk_risk(spark, sf):
    return rounded(scored(spark, sf).select("txn_key", "p").orderBy(F.desc("p"), "txn_key").limit(10))


@register(
    "sequence_windows",
    f"""WITH {EVENTS} SELECT event_id, entity, array_to_string(s, ',') AS sequence FROM
        (SELECT event_id, entity, list(event_type) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS s FROM txn_events)
        WHERE len(s) = 10""",
)
def sequence_windows(spark, sf):
    w = temporal.sequence_windows(event_blocks(spark, sf, 9), "entity", "event_type", 10)
    return w.select("event_id", "entity", F.array_join("sequence", ",").alias("sequence"))


_W = "WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id)"


@register(
    "lag_features",
    f"WITH {EVENTS} SELECT event_id, lag(chg_type,1) OVER w AS chg_type_lag1, lag(chg_type,2) OVER w AS chg_type_lag2, lag(chg_type,3) OVER w AS chg_type_lag3 FROM txn_events {_W}",
)
def lag_features(spark, sf):
    b = with_type_change(event_blocks(spark, sf, 4))
    out = temporal.lag_features(b, "entity", "chg_type", 3)
    return out.select("event_id", "chg_type_lag1", "chg_type_lag2", "chg_type_lag3")


@register(
    "rolling_stats",
    f"""WITH {EVENTS} SELECT event_id, round(avg(value) OVER w, 6) AS value_roll_mean, round(stddev_samp(value) OVER w, 6) AS value_roll_std FROM txn_events
        WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
)
def rolling_stats(spark, sf):
    out = temporal.rolling_stats(event_blocks(spark, sf, 5), "entity", "value", 5)
    return rounded(out.select("event_id", "value_roll_mean", "value_roll_std"))


@register(
    "change_velocity",
    f"""WITH {EVENTS} SELECT event_id, round((value - lag(value) OVER w)/nullif((us - lag(us) OVER w)/1e6::DOUBLE, 0), 9) AS velocity FROM txn_events {_W}""",
)
def change_velocity(spark, sf):
    out = temporal.change_velocity(event_blocks(spark, sf, 1), "entity", "value", "us")
    return out.select("event_id", F.round("velocity", 9).alias("velocity"))


def history(spark, sf):
    return temporal.change_history(with_type_change(event_blocks(spark, sf, 1)), "entity", "chg_type", "us")


_PAST = "WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@register(
    "hist_change_freq",
    f"WITH {EVENTS} SELECT event_id, round(avg(chg_type) OVER w, 6) AS hist_change_freq FROM txn_events {_PAST}",
)
def hist_change_freq(spark, sf):
    return rounded(history(spark, sf).select("event_id", "hist_change_freq"))


@register(
    "time_since_change",
    f"""WITH {EVENTS} SELECT event_id, round((us - max(CASE WHEN chg_type=1 THEN us END) OVER w)/1e6::DOUBLE, 6) AS seconds_since_change
        FROM txn_events {_PAST}""",
)
def time_since_change(spark, sf):
    return rounded(history(spark, sf).select("event_id", "seconds_since_change"))


@register(
    "mode_stability",
    f"""WITH {EVENTS}, c AS (SELECT entity, event_type, count(*) AS n FROM txn_events GROUP BY ALL),
        m AS (SELECT entity, event_type AS mode, n, sum(n) OVER (PARTITION BY entity) AS t, row_number() OVER (PARTITION BY entity ORDER BY n DESC, event_type) AS rn FROM c)
        SELECT entity, mode, CAST(t AS BIGINT) AS n_rows, round(1 - n/t, 6) AS share_off_mode FROM m WHERE rn = 1""",
)
def mode_stability(spark, sf):
    return rounded(temporal.mode_stability(raw_events(spark, sf), "entity", "event_type"))


@register(
    "seasonal_profile",
    f"""WITH {EVENTS}, u AS (SELECT 'hour' AS unit, CAST(hour(ts) AS INT) AS value, chg_type FROM txn_events UNION ALL
        SELECT 'weekday', CAST(dayofweek(ts)+1 AS INT), chg_type FROM txn_events UNION ALL SELECT 'month', CAST(month(ts) AS INT), chg_type FROM txn_events)
        SELECT unit, value, count(*) AS n, round(avg(chg_type), 6) AS change_rate FROM u GROUP BY ALL""",
)
def seasonal_profile(spark, sf):
    return rounded(temporal.seasonal_profile(txn_events(spark, sf), "ts", "chg_type"))
