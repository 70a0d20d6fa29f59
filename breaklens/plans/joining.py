"""Joins and set operations in effect."""

from itertools import combinations


from pyspark.sql import functions as F

from breaklens.operators import rules, stats
from breaklens.operators.rules import Rule
from breaklens.plans.parts import PAIR_ROWS, PAIRS, TRIPLE_ROWS, r6, rounded, signatures
from breaklens.plans.registry import SCORED, TXN, register
from breaklens.sources.tables import scored, txn
from breaklens.spec import FLAGS, TARGET

# An ordered rule list over fixture columns.
LIST = [
    Rule((("l_discount", ">", 0.075), ("l_quantity", ">", 39.5)), 1, 0.83, 0, name="rule_0"),
    Rule((("l_quantity", ">", 39.5), ("l_tax", ">", 0.055)), 0, 0.33, 0, name="rule_1"),
    Rule((("l_discount", ">", 0.075),), 0, 0.28, 0, name="rule_2"),
    Rule((("l_tax", "<=", 0.015),), 0, 0.08, 0, name="rule_3"),
]
_COND = [
    "l_discount > 0.075 AND l_quantity > 39.5",
    "l_quantity > 39.5 AND l_tax > 0.055",
    "l_discount > 0.075",
    "l_tax <= 0.015",
]
_COLS = ["txn_key", "l_discount", "l_quantity", "l_tax", TARGET]


@register(
    "join_lookup",
    f"""WITH {PAIRS} SELECT pair_name, round(a.rate_1,6) AS rate_field_1, round(b.rate_1,6) AS rate_field_2 FROM pairs
        JOIN singles a ON a.field=field_1 JOIN singles b ON b.field=field_2""",
)
def join_lookup(spark, sf):
    sig = signatures(spark, sf)
    one = stats.chi2_individual(sig, FLAGS, TARGET).select("field", "rate_changed")
    p = stats.pair_cells(sig, FLAGS, TARGET).filter("n11 + n10 > 0")
    out = p.join(one.toDF("field_1", "rate_field_1"), "field_1").join(one.toDF("field_2", "rate_field_2"), "field_2")
    return rounded(
        out.select(F.concat_ws(" + ", "field_1", "field_2").alias("pair_name"), "rate_field_1", "rate_field_2")
    )


@register(
    "join_combinations",
    f"""WITH {TXN} SELECT concat_ws(' + ', field_1, field_2) AS fields, 2 AS n_fields, CAST(sum(f) AS BIGINT) AS cases FROM ({PAIR_ROWS}) GROUP BY 1
        UNION ALL SELECT concat_ws(' + ', field_1, field_2, field_3), 3, CAST(sum(f) AS BIGINT) FROM ({TRIPLE_ROWS}) GROUP BY 1""",
)
def join_combinations(spark, sf):
    """All combinations of two and three fields with their cases (field counts bound the list)."""
    items = [
        F.struct(
            F.lit(" + ".join(c)).alias("fields"),
            F.lit(len(c)).alias("n_fields"),
            F.array_min(F.array(*[F.col(x) for x in c])).alias("all_set"),
        )
        for k in (2, 3)
        for c in combinations(FLAGS, k)
    ]
    long = signatures(spark, sf).select("n", F.inline(F.array(*items)))
    return long.groupBy("fields", "n_fields").agg(F.sum(F.col("n") * F.col("all_set")).alias("cases"))


@register(
    "join_positional",
    f"""WITH {SCORED} SELECT t.txn_key, l_quantity, l_discount, round(p, 6) AS p, pred_factor, pred_coupon FROM txn t JOIN scored s ON t.txn_key = s.txn_key""",
)
def join_positional(spark, sf):
    features = txn(spark, sf, ["txn_key", "l_quantity", "l_discount"])
    return rounded(features.join(scored(spark, sf).select("txn_key", "p", "pred_factor", "pred_coupon"), "txn_key"))


@register(
    "join_rules_first_match",
    f"WITH {TXN} SELECT txn_key, CASE "
    + " ".join(f"WHEN {c} THEN 'rule_{i}'" for i, c in enumerate(_COND))
    + " END AS first_rule FROM txn",
)
def join_rules_first_match(spark, sf):
    t = txn(spark, sf, _COLS)
    return t.select("txn_key", rules.first_match(LIST, lambda r: F.lit(r.name)).alias("first_rule"))


@register(
    "join_rules_all_match",
    f"WITH {TXN} SELECT txn_key, concat_ws(',', "
    + ", ".join(f"CASE WHEN {c} THEN 'rule_{i}' END" for i, c in enumerate(_COND))
    + ") AS fired FROM txn",
)
def join_rules_all_match(spark, sf):
    t = txn(spark, sf, _COLS)
    return t.select("txn_key", F.array_join(rules.all_matches(LIST, lambda r: F.lit(r.name)), ",").alias("fired"))


# Break rules over predicted changes, and change rules over flags, both measured on the data.
_CHANGE_SQL = " UNION ALL ".join(
    f"SELECT '{lab}' AS change, '{c}' AS feature, avg(fld_{lab}) AS confidence, count(*) AS support FROM txn WHERE {c}=1"
    for lab in ("factor", "coupon", "date")
    for c in FLAGS
)
_BREAK_SQL = " UNION ALL ".join(
    f"SELECT 'predicted_{lab} > 0.500' AS primary_condition, avg(was_exception) FILTER (fld_{lab}=1) AS confidence, count_if(fld_{lab}=1) AS support FROM txn"
    for lab in ("factor", "coupon", "date")
)
CHAIN = f"""{TXN}, change_rules AS ({_CHANGE_SQL}), break_rules AS ({_BREAK_SQL}),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY change ORDER BY round(confidence,12) DESC, feature) AS rn FROM change_rules) WHERE rn = 1),
  chain AS (SELECT b.primary_condition, c.change, c.feature, c.confidence AS change_confidence, b.confidence AS break_confidence,
    c.confidence*b.confidence AS full_chain_confidence, b.support FROM break_rules b JOIN best c ON regexp_extract(b.primary_condition, 'predicted_(\\S+)', 1) = c.change)"""


def change_rule_table(spark, sf):
    """Per field label and flag: how often the label is set when the flag is (one scan)."""
    labs = ["factor", "coupon", "date"]
    t = txn(spark, sf, [*FLAGS, *[f"fld_{x}" for x in labs]])
    long = t.groupBy(*t.columns).agg(F.count("*").alias("n"))
    items = [
        F.struct(F.lit(x).alias("change"), F.lit(c).alias("feature"), F.col(c).alias("f"), F.col(f"fld_{x}").alias("y"))
        for x in labs
        for c in FLAGS
    ]
    long = long.select("n", F.inline(F.array(*items))).filter("f = 1")
    return long.groupBy("change", "feature").agg(
        (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("confidence"), F.sum("n").alias("support")
    )


def break_rule_table(spark, sf):
    labs = ["factor", "coupon", "date"]
    t = txn(spark, sf, [TARGET, *[f"fld_{x}" for x in labs]])
    wide = t.agg(
        *[F.avg(F.when(F.col(f"fld_{x}") == 1, F.col(TARGET))).alias(f"c_{x}") for x in labs],
        *[F.count_if(F.col(f"fld_{x}") == 1).alias(f"n_{x}") for x in labs],
    )
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f"predicted_{x} > 0.500").alias("primary_condition"),
                        F.col(f"c_{x}").alias("confidence"),
                        F.col(f"n_{x}").alias("support"),
                    )
                    for x in labs
                ]
            )
        )
    )


def chain_rules(change_rules, break_rules):
    """Break rule -> best change rule of the change it names; confidences multiply."""
    best = change_rules.groupBy("change").agg(
        F.min(F.struct((-F.round("confidence", 12)).alias("k"), F.col("feature"), F.col("confidence"))).alias("b")
    )
    named = break_rules.withColumn("change", F.regexp_extract("primary_condition", r"predicted_(\S+)", 1))
    return named.join(best, "change").select(
        "primary_condition",
        "change",
        F.col("b.feature").alias("feature"),
        F.col("b.confidence").alias("change_confidence"),
        F.col("confidence").alias("break_confidence"),
        (F.col("b.confidence") * F.col("confidence")).alias("full_chain_confidence"),
        "support",
    )


@register(
    "join_chain_rules",
    f"WITH {CHAIN} SELECT primary_condition, change, feature, {r6('change_confidence', 'break_confidence')} FROM chain",
)
def join_chain_rules(spark, sf):
    c = chain_rules(change_rule_table(spark, sf), break_rule_table(spark, sf))
    return rounded(c.select("primary_condition", "change", "feature", "change_confidence", "break_confidence"))


@register(
    "semi_anti_coverage",
    f"""WITH {TXN} SELECT CASE WHEN {_COND[0]} THEN 'covered' ELSE 'not_covered' END AS side, count(*) AS n, round(avg(was_exception), 6) AS rate
        FROM txn GROUP BY 1""",
)
def semi_anti_coverage(spark, sf):
    return rounded(rules.coverage(txn(spark, sf, _COLS), LIST[0], TARGET))


@register(
    "set_union_fields",
    f"""WITH {PAIRS} SELECT DISTINCT unnest([field_1, field_2]) AS field FROM (SELECT * FROM pairs ORDER BY chi2 DESC, field_1, field_2 LIMIT 3)""",
)
def set_union_fields(spark, sf):
    return stats.top_pair_fields(stats.chi2_pairwise(signatures(spark, sf), FLAGS, TARGET), 3)
