"""Streaming and drift queries."""

from pyspark.sql import functions as F

from breaklens.plans.parts import rounded
from breaklens.plans.registry import TXN, register
from breaklens.sources.tables import txn
from breaklens.streaming import monitor

def _start(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@register(
    "stream_break_rate",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, count_if(event_type='error') AS breaks,
        round(avg(CAST(event_type='error' AS INT)), 6) AS break_rate FROM events GROUP BY 1""",
)
def stream_break_rate(spark, sf):
    s = monitor.event_stream(spark, sf).select("ts", (F.col("event_type") == "error").cast("bigint").alias("is_break"))
    out = monitor.break_rate(monitor.latest_windows(monitor.break_counts(s, "1 day", "1 day"), "break-rate"))
    return rounded(out.withColumn("window_start", _start("window_start")))


@register(
    "stream_monitor_predictions",
    """WITH e AS (SELECT ts, CAST(value > 50 AS INT) AS predicted, CAST(event_type='error' AS INT) AS outcome FROM events)
        SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, round(avg(CAST(predicted=outcome AS INT)), 6) AS accuracy,
        CAST(sum(predicted) AS BIGINT) AS alarms, CAST(sum(predicted*outcome) AS BIGINT) AS true_alarms FROM e GROUP BY 1""",
)
def stream_monitor_predictions(spark, sf):
    p = monitor.event_stream(spark, sf).select(
        F.col("event_id").alias("key"), "ts", (F.col("value") > 50).cast("bigint").alias("predicted")
    )
    o = monitor.event_stream(spark, sf).select(
        F.col("event_id").alias("outcome_key"),
        F.col("ts").alias("outcome_ts"),
        (F.col("event_type") == "error").cast("bigint").alias("outcome"),
    )
    matched = monitor.matched_outcomes(p, o, "1 day")
    out = monitor.prediction_quality(monitor.summed_windows(matched, "prediction-quality", lambda b: monitor.outcome_sums(b, "1 day")))
    return rounded(out.withColumn("window_start", _start("window_start")))


_Q = "(SELECT quantile_cont({0}, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) FROM d WHERE period = 1995)"


def _psi_sql(f: str) -> str:
    return f"""SELECT period, '{f}' AS feature, len(list_filter(list_distinct({_Q.format(f)}), lambda c: {f} > c)) AS bin, count(*) AS n FROM d GROUP BY ALL"""


@register(
    "drift_metrics",
    f"""WITH {TXN}, d AS (SELECT CAST(year(ts) AS INT) AS period, l_extendedprice, l_quantity, was_exception AS y,
          CASE WHEN n4 % 10 = 0 THEN 1 - was_exception ELSE was_exception END AS yhat FROM txn),
        c AS ({_psi_sql('l_extendedprice')} UNION ALL {_psi_sql('l_quantity')}),
        s AS (SELECT *, n/sum(n) OVER (PARTITION BY period, feature) AS share FROM c),
        g AS (SELECT DISTINCT a.period, a.feature, b.bin, b.share AS q FROM s a JOIN s b ON a.feature=b.feature AND b.period=1995),
        f AS (SELECT g.*, greatest(coalesce(share,0), 1e-6::DOUBLE) AS p FROM g LEFT JOIN s USING (period, feature, bin))
        SELECT period, 'psi:' || feature AS measure, round(sum((p-greatest(q,1e-6::DOUBLE))*ln(p/greatest(q,1e-6::DOUBLE))), 6) AS value FROM f GROUP BY ALL
        UNION ALL SELECT period, 'accuracy', round(avg(CAST(y=yhat AS INT)), 6) FROM d GROUP BY ALL""",
)
def drift_metrics(spark, sf):
    t = txn(spark, sf, ["ts", "l_extendedprice", "l_quantity", "was_exception", "n4"])
    flipped = F.when(F.col("n4") % 10 == 0, 1 - F.col("was_exception")).otherwise(F.col("was_exception"))
    d = t.select(F.year("ts").alias("period"), "l_extendedprice", "l_quantity", F.col("was_exception").alias("y"), flipped.alias("yhat"))
    drift = monitor.psi(d, "period", 1995, ["l_extendedprice", "l_quantity"])
    acc = monitor.accuracy_by_period(d, "period", "y", "yhat")
    return rounded(
        drift.select("period", F.concat(F.lit("psi:"), "feature").alias("measure"), F.col("psi").alias("value")).unionByName(
            acc.select("period", F.lit("accuracy").alias("measure"), F.col("accuracy").alias("value"))
        )
    )
