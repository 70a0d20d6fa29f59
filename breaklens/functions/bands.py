"""Scalar rules that turn numbers into labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chi-square critical values at one degree of freedom, and the labels of the bands.
SIGNIFICANCE = [
    (10.827566170662733, "Highly Significant (p<0.001)"),
    (6.6348966010212145, "Very Significant (p<0.01)"),
    (3.841458820694124, "Significant (p<0.05)"),
    (2.705543454095404, "Marginally Significant (p<0.1)"),
]
NOT_SIGNIFICANT = "Not Significant (p>=0.1)"
CHI2_05 = 3.841458820694124

# Lower bound of the probability, risk level and the action it asks for.
RISK = [
    (0.8, "CRITICAL", "Immediate intervention required"),
    (0.6, "HIGH", "Urgent review recommended"),
    (0.4, "MODERATE", "Monitor closely"),
]
LOW_RISK = ("LOW", "Standard monitoring")


def _ladder(steps: list[tuple[Column, Column]], default: Column) -> Column:
    out = F.when(*steps[0])
    for cond, value in steps[1:]:
        out = out.when(cond, value)
    return out.otherwise(default)


def significance_band(chi2: Column) -> Column:
    """Band of a one-degree chi-square statistic; NULL stays NULL."""
    band = _ladder([(chi2 > v, F.lit(t)) for v, t in SIGNIFICANCE], F.lit(NOT_SIGNIFICANT))
    return F.when(chi2.isNotNull(), band)


def sample_size_needed(v: Column) -> Column:
    """Rows needed to see an effect of size V, at most 10,000."""
    return F.when(v > 0, F.least(2.706 / (v * v), F.lit(10000.0))).otherwise(F.lit(10000.0))


def interaction_class(lift: Column) -> Column:
    return _ladder([(lift > 1.2, F.lit("synergistic")), (lift < 0.8, F.lit("interference"))], F.lit("additive"))


def alert_class(pair_lift: Column, cases: Column, lift_1: Column, lift_2: Column) -> Column:
    """'alert' for a strong pair with enough cases, 'monitor' when a single field is strong."""
    return _ladder(
        [((pair_lift > 3) & (cases >= 10), F.lit("alert")), ((lift_1 > 2) | (lift_2 > 2), F.lit("monitor"))],
        F.lit("none"),
    )


def risk_level(p: Column) -> Column:
    return _ladder([(p > t, F.lit(level)) for t, level, _ in RISK], F.lit(LOW_RISK[0]))


def risk_action(p: Column) -> Column:
    return _ladder([(p > t, F.lit(action)) for t, _, action in RISK], F.lit(LOW_RISK[1]))


def model_type(name: Column) -> Column:
    return _ladder(
        [
            (F.contains(name, F.lit("neural")), F.lit("Neural Network")),
            (name.isin("xgboost", "lightgbm", "gradient_boosting"), F.lit("Boosting")),
            (name.isin("random_forest", "extra_trees"), F.lit("Ensemble")),
        ],
        F.lit("Traditional ML"),
    )


def model_complexity(name: Column) -> Column:
    return _ladder(
        [
            (F.contains(name, F.lit("neural")), F.lit("High")),
            (name.isin("xgboost", "lightgbm", "gradient_boosting", "random_forest"), F.lit("Medium-High")),
            (name.isin("svm_rbf", "knn"), F.lit("Medium")),
        ],
        F.lit("Low"),
    )


def ratio_or_inf(num: Column, den: Column) -> Column:
    """num / den; Infinity when only the denominator is 0, NULL for 0/0."""
    return F.when(den != 0, num / den).when(num > 0, F.lit(float("inf")))
