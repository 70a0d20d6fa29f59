"""Metrics and result tables."""

from pyspark.sql import functions as F

from breaklens.operators import metrics
from breaklens.plans.parts import rounded
from breaklens.plans.registry import SCORED, register
from breaklens.sources.tables import scored

FIELDS = ["factor", "coupon", "date"]
PAIRS = [(f"fld_{f}", f"pred_{f}") for f in FIELDS]
FIELD_PAIRS = {f: (f"fld_{f}", f"pred_{f}") for f in FIELDS}


def _scores_sql(src: str, key: str = "field") -> str:
    return f"""SELECT {key}, avg(CAST(y=h AS INT)) AS accuracy,
      coalesce(sum(y*h)/nullif(sum(h),0), 0) AS precision, coalesce(sum(y*h)/nullif(sum(y),0), 0) AS recall,
      coalesce(2*sum(y*h)/nullif(sum(y)+sum(h),0), 0) AS f1_score FROM ({src}) GROUP BY {key}"""


_LONG = " UNION ALL ".join(f"SELECT '{f}' AS field, fld_{f} AS y, pred_{f} AS h FROM scored" for f in FIELDS)
_R = "round(accuracy,6) AS accuracy, round(precision,6) AS precision, round(recall,6) AS recall, round(f1_score,6) AS f1_score"

# Runs of the result registry: per-field predictions against one shared score cut at several levels.
# The model names only exercise the type and complexity classes.
CUTS = [0.3, 0.5, 0.7]


def runs():
    out = {("independent", "logistic_regression"): FIELD_PAIRS}
    out[("independent", "decision_tree")] = {f: (f"fld_{f}", "yhat") for f in FIELDS}
    for name, cut in zip(["random_forest", "xgboost", "neural_small"], CUTS):
        out[("shared", name)] = {f: (f"fld_{f}", (F.col("p") > cut).cast("int")) for f in FIELDS}
    return out


def _runs_sql() -> str:
    parts = []
    for f in FIELDS:
        parts.append(f"SELECT 'independent' AS approach, 'logistic_regression' AS model, '{f}' AS field, fld_{f} AS y, pred_{f} AS h FROM scored")
        parts.append(f"SELECT 'independent', 'decision_tree', '{f}', fld_{f}, yhat FROM scored")
        for name, cut in zip(["random_forest", "xgboost", "neural_small"], CUTS):
            parts.append(f"SELECT 'shared', '{name}', '{f}', fld_{f}, CAST(p > {cut}::DOUBLE AS INT) FROM scored")
    return " UNION ALL ".join(parts)


RESULTS = f"{SCORED}, results AS ({_scores_sql(_runs_sql(), 'approach, model, field')})"
TABLE = f"""{RESULTS}, tab AS (SELECT approach, model, avg(accuracy) AS macro_accuracy, avg(precision) AS macro_precision,
   avg(recall) AS macro_recall, avg(f1_score) AS macro_f1 FROM results GROUP BY ALL),
   best AS (SELECT approach, model, macro_f1 FROM (SELECT *, row_number() OVER (PARTITION BY approach ORDER BY macro_f1 DESC, model) AS rn FROM tab) WHERE rn = 1),
   field_df AS (SELECT results.* FROM results SEMI JOIN best USING (approach, model))"""
CMP = f"""{RESULTS}, cmp AS (SELECT model, avg(accuracy) AS performance,
   CASE WHEN contains(model, 'neural') THEN 'Neural Network' WHEN model IN ('xgboost','lightgbm','gradient_boosting') THEN 'Boosting'
        WHEN model IN ('random_forest','extra_trees') THEN 'Ensemble' ELSE 'Traditional ML' END AS type,
   CASE WHEN contains(model, 'neural') THEN 'High' WHEN model IN ('xgboost','lightgbm','gradient_boosting','random_forest') THEN 'Medium-High'
        WHEN model IN ('svm_rbf','knn') THEN 'Medium' ELSE 'Low' END AS complexity
   FROM results GROUP BY model)"""


def results(spark, sf):
    return metrics.results_long(scored(spark, sf), runs())


def model_means(spark, sf):
    return results(spark, sf).groupBy("model").agg(F.avg("accuracy").alias("accuracy"))


@register(
    "m_accuracy",
    f"WITH {SCORED} SELECT round(avg(CAST(y=yhat AS INT)), 6) AS accuracy FROM scored",
)
def m_accuracy(spark, sf):
    out = metrics.with_scores(metrics.confusion(scored(spark, sf), {"break": ("y", "yhat")}))
    return rounded(out.select("accuracy"))


@register(
    "m_prf",
    f"""WITH {SCORED} SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score
        FROM ({_scores_sql("SELECT 1 AS field, y, yhat AS h FROM scored")})""",
)
def m_prf(spark, sf):
    out = metrics.with_scores(metrics.confusion(scored(spark, sf), {"break": ("y", "yhat")}))
    return rounded(out.select("precision", "recall", "f1_score"))


@register(
    "m_auc",
    f"""WITH {SCORED}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1)/2.0::DOUBLE AS rk FROM scored)
        SELECT count_if(y=1) AS positives, count_if(y=0) AS negatives,
        round((sum(rk) FILTER (y=1) - count_if(y=1)*(count_if(y=1)+1)/2.0::DOUBLE) / (count_if(y=1)*count_if(y=0)*1.0::DOUBLE), 6) AS auc FROM r""",
)
def m_auc(spark, sf):
    return rounded(metrics.auc(scored(spark, sf), "y", "p"))


@register(
    "m_report",
    f"""WITH {SCORED}, c AS (SELECT CAST(k AS VARCHAR) AS label, coalesce(count_if(yhat=k AND y=k)/nullif(count_if(yhat=k),0),0) AS precision,
          coalesce(count_if(yhat=k AND y=k)/nullif(count_if(y=k),0),0) AS recall,
          coalesce(2*count_if(yhat=k AND y=k)/nullif(count_if(y=k)+count_if(yhat=k),0),0) AS f1_score, count_if(y=k) AS support
          FROM scored, (VALUES (0),(1)) v(k) GROUP BY k),
        u AS (SELECT * FROM c UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) FROM c
        UNION ALL SELECT 'weighted avg', sum(precision*support)/sum(support), sum(recall*support)/sum(support), sum(f1_score*support)/sum(support), sum(support) FROM c)
        SELECT label, round(precision,6) AS precision, round(recall,6) AS recall, round(f1_score,6) AS f1_score, CAST(support AS BIGINT) AS support FROM u""",
)
def m_report(spark, sf):
    return rounded(metrics.report(scored(spark, sf), "y", "yhat"))


@register(
    "m_hamming",
    f"""WITH {SCORED} SELECT round(avg(CAST(fld_factor<>pred_factor AS INT) + CAST(fld_coupon<>pred_coupon AS INT)
        + CAST(fld_date<>pred_date AS INT))/3, 6) AS hamming_loss FROM scored""",
)
def m_hamming(spark, sf):
    return rounded(metrics.multilabel(scored(spark, sf), PAIRS).select("hamming_loss"))


@register(
    "m_exact_match",
    f"""WITH {SCORED} SELECT round(avg(CAST(fld_factor=pred_factor AND fld_coupon=pred_coupon AND fld_date=pred_date AS INT)), 6)
        AS exact_match_ratio FROM scored""",
)
def m_exact_match(spark, sf):
    return rounded(metrics.multilabel(scored(spark, sf), PAIRS).select("exact_match_ratio"))


@register(
    "m_jaccard_samples",
    f"""WITH {SCORED}, j AS (SELECT fld_factor*pred_factor + fld_coupon*pred_coupon + fld_date*pred_date AS i,
          greatest(fld_factor,pred_factor) + greatest(fld_coupon,pred_coupon) + greatest(fld_date,pred_date) AS u FROM scored)
        SELECT round(avg(CASE WHEN u = 0 THEN 0 ELSE i/u END), 6) AS jaccard_score FROM j""",
)
def m_jaccard_samples(spark, sf):
    return rounded(metrics.multilabel(scored(spark, sf), PAIRS).select("jaccard_score"))


@register("m_field", f"WITH {SCORED} SELECT field, {_R} FROM ({_scores_sql(_LONG)})")
def m_field(spark, sf):
    out = metrics.with_scores(metrics.confusion(scored(spark, sf), FIELD_PAIRS))
    return rounded(out.select("field", "accuracy", "precision", "recall", "f1_score"))


@register(
    "m_macro",
    f"""WITH {SCORED} SELECT round(avg(accuracy),6) AS macro_accuracy, round(avg(precision),6) AS macro_precision,
        round(avg(recall),6) AS macro_recall, round(avg(f1_score),6) AS macro_f1 FROM ({_scores_sql(_LONG)})""",
)
def m_macro(spark, sf):
    return rounded(metrics.macro(metrics.with_scores(metrics.confusion(scored(spark, sf), FIELD_PAIRS))))


@register("m_fidelity", f"WITH {SCORED} SELECT round(avg(CAST(yhat = CAST(p > 0.5 AS INT) AS INT)), 6) AS fidelity FROM scored")
def m_fidelity(spark, sf):
    s = scored(spark, sf).withColumn("surrogate", (F.col("p") > 0.5).cast("int"))
    return rounded(metrics.fidelity(s, "yhat", "surrogate"))


@register("compare_models", f"WITH {CMP} SELECT model, round(performance, 6) AS performance, type, complexity FROM cmp")
def compare_models(spark, sf):
    return rounded(metrics.compare_models(model_means(spark, sf)))


@register(
    "complexity_vs_score",
    f"""WITH {CMP} SELECT complexity, round(avg(performance), 6) AS mean, round(stddev_samp(performance), 6) AS std, count(*) AS n
        FROM cmp GROUP BY 1""",
)
def complexity_vs_score(spark, sf):
    return rounded(metrics.group_mean_std(metrics.compare_models(model_means(spark, sf)), ["complexity"], "performance"))


@register(
    "group_mean_std",
    f"""WITH {RESULTS} SELECT approach, field, round(avg(f1_score), 6) AS mean, round(stddev_samp(f1_score), 6) AS std, count(*) AS n
        FROM results GROUP BY ALL""",
)
def group_mean_std(spark, sf):
    return rounded(metrics.group_mean_std(results(spark, sf), ["approach", "field"], "f1_score"))


@register(
    "pivot_field_approach",
    f"""WITH {RESULTS} SELECT field, round(avg(f1_score) FILTER (approach='independent'), 6) AS independent,
        round(avg(f1_score) FILTER (approach='shared'), 6) AS shared FROM results GROUP BY 1""",
)
def pivot_field_approach(spark, sf):
    return rounded(
        results(spark, sf).groupBy("field").pivot("approach", ["independent", "shared"]).agg(F.avg("f1_score"))
    )


@register(
    "compare_approaches",
    f"""WITH {TABLE} SELECT approach, model, round(macro_accuracy,6) AS macro_accuracy, round(macro_precision,6) AS macro_precision,
        round(macro_recall,6) AS macro_recall, round(macro_f1,6) AS macro_f1 FROM tab""",
)
def compare_approaches(spark, sf):
    return rounded(metrics.approach_table(results(spark, sf)))


@register("best_per_approach", f"WITH {TABLE} SELECT approach, model, round(macro_f1, 6) AS macro_f1 FROM best")
def best_per_approach(spark, sf):
    return rounded(metrics.best_per_approach(metrics.approach_table(results(spark, sf))))


@register(
    "argmax_per_group",
    f"""WITH {TABLE} SELECT field, approach, round(f1_score, 6) AS f1_score FROM
        (SELECT *, row_number() OVER (PARTITION BY field ORDER BY round(f1_score,12) DESC, approach) AS rn FROM field_df) WHERE rn = 1""",
)
def argmax_per_group(spark, sf):
    f = metrics.best_field_models(results(spark, sf)).select("field", "approach", "f1_score")
    return rounded(metrics.argmax_per_group(f, "field", "f1_score", "approach"))


_WIN = f"""{TABLE}, win AS (SELECT field, approach FROM
        (SELECT *, row_number() OVER (PARTITION BY field ORDER BY round(f1_score,12) DESC, approach) AS rn FROM field_df) WHERE rn = 1)"""


@register("value_counts", f"WITH {_WIN} SELECT approach, count(*) AS n FROM win GROUP BY 1")
def value_counts(spark, sf):
    return argmax_per_group(spark, sf).groupBy("approach").agg(F.count("*").alias("n"))


@register(
    "best_approach_share",
    f"WITH {_WIN} SELECT approach, round(count(*)/(SELECT count(*) FROM win), 6) AS share FROM win GROUP BY 1",
)
def best_approach_share(spark, sf):
    n = value_counts(spark, sf)
    return rounded(n.select("approach", (F.col("n") / n.agg(F.sum("n")).scalar()).alias("share")))


@register(
    "field_difficulty",
    f"""WITH {RESULTS} SELECT field, round(avg(f1_score), 6) AS mean, round(stddev_samp(f1_score), 6) AS std, count(*) AS n
        FROM results GROUP BY 1""",
)
def field_difficulty(spark, sf):
    return rounded(metrics.group_mean_std(results(spark, sf), ["field"], "f1_score").orderBy("mean", "field"))


@register(
    "recommend_best",
    f"""WITH {TABLE} SELECT 'best overall' AS section, approach, model, round(macro_f1,6) AS macro_f1 FROM (SELECT * FROM best ORDER BY macro_f1 DESC, approach LIMIT 1)
        UNION ALL SELECT 'best of approach', approach, model, round(macro_f1,6) FROM best
        UNION ALL SELECT 'approach mean', approach, '', round(avg(macro_f1),6) FROM tab GROUP BY approach""",
)
def recommend_best(spark, sf):
    return rounded(metrics.recommend(results(spark, sf)))


@register(
    "union_results",
    f"""WITH {RESULTS} SELECT approach, model, field, round(f1_score,6) AS f1_score, CAST(NULL AS DOUBLE) AS hamming_loss FROM results
        UNION ALL SELECT 'independent', 'logistic_regression', 'all', NULL,
          round(avg(CAST(fld_factor<>pred_factor AS INT) + CAST(fld_coupon<>pred_coupon AS INT) + CAST(fld_date<>pred_date AS INT))/3, 6) FROM scored""",
)
def union_results(spark, sf):
    a = results(spark, sf).select("approach", "model", "field", "f1_score")
    b = metrics.multilabel(scored(spark, sf), PAIRS).select(
        F.lit("independent").alias("approach"),
        F.lit("logistic_regression").alias("model"),
        F.lit("all").alias("field"),
        "hamming_loss",
    )
    return rounded(a.unionByName(b, allowMissingColumns=True))


@register(
    "score_histogram",
    f"""WITH {SCORED} SELECT y, CAST(least(floor((p-0.0::DOUBLE)/(1.0::DOUBLE/20))+1, 20) AS INT) AS bin, count(*) AS n FROM scored GROUP BY ALL""",
)
def score_histogram(spark, sf):
    return metrics.histogram(scored(spark, sf), "p", 20, 0.0, 1.0, ["y"])



@register(
    "root_cause_accuracy",
    f"""WITH {SCORED}, e AS (SELECT txn_key, CASE WHEN pred_coupon=1 THEN 'coupon' WHEN pred_factor=1 THEN 'factor' WHEN pred_date=1 THEN 'date' END AS cause,
          fld_factor, fld_coupon, fld_date FROM scored WHERE p > 0.5)
        SELECT count(*) AS n_explained, round(avg(CASE cause WHEN 'coupon' THEN fld_coupon WHEN 'factor' THEN fld_factor ELSE fld_date END), 6) AS accuracy
        FROM e WHERE cause IS NOT NULL""",
)
def root_cause_accuracy(spark, sf):
    s = scored(spark, sf).filter("p > 0.5")
    cause = F.when(F.col("pred_coupon") == 1, "coupon").when(F.col("pred_factor") == 1, "factor").when(F.col("pred_date") == 1, "date")
    causes = s.select("txn_key", cause.alias("cause")).filter("cause IS NOT NULL")
    labels = s.select(
        "txn_key",
        F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"fld_{f}").alias("changed")) for f in FIELDS])),
    )
    return rounded(metrics.root_cause_accuracy(causes, labels, "txn_key"))


_LEVELS = [0.5, 0.8, 0.9, 0.95]


@register(
    "precision_at_recall",
    f"""WITH {SCORED}, c AS (SELECT p, sum(y) AS pos, count(*) - sum(y) AS neg FROM scored GROUP BY p),
        k AS (SELECT p AS threshold, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM c),
        q AS (SELECT threshold, fp, round(tp/(tp+fp)::DOUBLE, 12) AS precision, tp/(SELECT sum(y) FROM scored)::DOUBLE AS recall FROM k),
        l AS (SELECT unnest({_LEVELS})::DOUBLE AS recall_level)
        SELECT recall_level, round(precision, 6) AS precision, CAST(fp AS BIGINT) AS false_alarms, round(threshold, 6) AS threshold FROM
         (SELECT *, row_number() OVER (PARTITION BY recall_level ORDER BY precision DESC, fp, threshold DESC) AS rn FROM l JOIN q ON recall >= recall_level) WHERE rn = 1""",
)
def precision_at_recall(spark, sf):
    return rounded(metrics.precision_at_recall(scored(spark, sf), "y", "p", _LEVELS))


@register(
    "weighted_loss",
    f"""WITH {SCORED}, q AS (SELECT *, least(greatest(p, 1e-7::DOUBLE), 1-1e-7::DOUBLE) AS q FROM scored),
        l AS (SELECT -avg(y*ln(q)+(1-y)*ln(1-q)) AS cash_break, -avg(fld_factor*ln(q)+(1-fld_factor)*ln(1-q)) AS factor_change,
              -avg(fld_coupon*ln(q)+(1-fld_coupon)*ln(1-q)) AS coupon_change, -avg(fld_date*ln(q)+(1-fld_date)*ln(1-q)) AS date_change FROM q)
        SELECT round(cash_break,6) AS cash_break, round(factor_change,6) AS factor_change, round(coupon_change,6) AS coupon_change,
          round(date_change,6) AS date_change, round(.5*cash_break+.2*factor_change+.2*coupon_change+.1*date_change, 6) AS total_loss FROM l""",
)
def weighted_loss(spark, sf):
    tasks = {
        "cash_break": ("y", "p", 0.5),
        "factor_change": ("fld_factor", "p", 0.2),
        "coupon_change": ("fld_coupon", "p", 0.2),
        "date_change": ("fld_date", "p", 0.1),
    }
    return rounded(metrics.weighted_loss(scored(spark, sf), tasks))


@register(
    "weighted_ensemble",
    f"""WITH {SCORED} SELECT txn_key, round((0.6::DOUBLE*a.p + 0.3::DOUBLE*b.yhat + 0.3::DOUBLE*c.pred_coupon)/1.2, 6) AS p_ensemble
        FROM scored a JOIN scored b USING (txn_key) JOIN scored c USING (txn_key)""",
)
def weighted_ensemble(spark, sf):
    from breaklens.operators.multitask import weighted_ensemble as combine

    s = scored(spark, sf)
    parts = {
        "p_a": (s.select("txn_key", F.col("p").alias("p_a")), 0.6),
        "p_b": (s.select("txn_key", F.col("yhat").cast("double").alias("p_b")), 0.3),
        "p_c": (s.select("txn_key", F.col("pred_coupon").cast("double").alias("p_c")), 0.3),
    }
    return rounded(combine(parts, "txn_key"))
