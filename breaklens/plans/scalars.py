"""Projections, filters and scalar rules."""

from itertools import combinations

from pyspark.sql import functions as F

from breaklens.functions import bands, rows, text
from breaklens.operators import assoc, insights, stats
from breaklens.plans.parts import LIFTS, PAIRS, SINGLES, TRIPS, flags_txn, r6, rounded, signatures
from breaklens.plans.registry import SCORED, TXN, TXN_TEXT, register
from breaklens.sources.tables import orphan_keys, scored, txn, txn_text
from breaklens.spec import FLAGS, TARGET

KEYWORDS = ["C-TX", "Brand#1", "R", "steel"]
OPTIONS = ["N", "R", "A", "Brand#11", "Brand#23", "PROMO"]
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice", "p_retailprice", "s_acctbal"]

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_BODY = STRIP.format("text_field")
_ITEMS = rf"list_filter(list_transform(string_split(text_field, ','), lambda x: {STRIP.format('x')}), lambda x: x <> '')"


def _clean_sql(lower: bool) -> str:
    hay = f"lower({_BODY})" if lower else _BODY
    whens = " ".join(f"WHEN contains({hay}, '{k.lower() if lower else k}') THEN '{k}'" for k in KEYWORDS)
    return f"CASE WHEN text_field IS NULL OR text_field = '' THEN '' {whens} ELSE {_BODY} END"


@register(
    "clean_text_field",
    f"WITH {TXN_TEXT} SELECT txn_key, {_clean_sql(True)} AS cleaned, {_clean_sql(False)} AS cleaned_case FROM txn_text",
)
def clean_text_field(spark, sf):
    t = txn_text(spark, sf)
    return t.select(
        "txn_key",
        text.clean_text_field(F.col("text_field"), KEYWORDS).alias("cleaned"),
        text.clean_text_field(F.col("text_field"), KEYWORDS, case_sensitive=True).alias("cleaned_case"),
    )


@register(
    "multi_hot",
    f"WITH {TXN_TEXT} SELECT txn_key, text_field, "
    + ", ".join(
        f"CAST(coalesce(list_contains({_ITEMS}, '{o}'), false) AS INT) AS \"{text.option_column('opt', o)}\"" for o in OPTIONS
    )
    + " FROM txn_text",
)
def multi_hot(spark, sf):
    return text.multi_hot(txn_text(spark, sf), "text_field", OPTIONS, "opt")


@register(
    "option_in_text",
    f"WITH {TXN_TEXT} SELECT txn_key, coalesce(list_contains({_ITEMS}, 'R'), false) AS has_option FROM txn_text",
)
def option_in_text(spark, sf):
    return txn_text(spark, sf).select("txn_key", text.option_in_text(F.col("text_field"), "R").alias("has_option"))


@register(
    "both_changed",
    f"WITH {TXN} SELECT txn_key, CAST(chg_factor=1 AND chg_principal=1 AS INT) AS both_changed FROM txn",
)
def both_changed(spark, sf):
    t = txn(spark, sf, ["txn_key", "chg_factor", "chg_principal"])
    return t.select("txn_key", rows.all_changed("chg_factor", "chg_principal").alias("both_changed"))


@register(
    "all_changed",
    f"""WITH {TXN} SELECT txn_key, CAST(chg_factor=1 AND chg_coupon=1 AND chg_principal=1 AS INT) AS all_changed FROM txn""",
)
def all_changed(spark, sf):
    t = txn(spark, sf, ["txn_key", "chg_factor", "chg_coupon", "chg_principal"])
    return t.select("txn_key", rows.all_changed("chg_factor", "chg_coupon", "chg_principal").alias("all_changed"))


@register(
    "significance_band",
    f"WITH {PAIRS} SELECT field AS name, significance FROM singles UNION ALL SELECT pair_name, significance FROM pairs",
)
def significance_band(spark, sf):
    sig = signatures(spark, sf)
    singles = stats.chi2_individual(sig, FLAGS, TARGET).select(F.col("field").alias("name"), "significance")
    return singles.union(stats.chi2_pairwise(sig, FLAGS, TARGET).select("pair_name", "significance"))


@register(
    "sample_size_needed",
    f"""WITH {SINGLES} SELECT field, round(CASE WHEN cramers_v > 0 THEN least(2.706/power(cramers_v,2), 10000) ELSE 10000 END, 4)
        AS sample_size FROM singles""",
)
def sample_size_needed(spark, sf):
    s = stats.chi2_individual(signatures(spark, sf), FLAGS, TARGET)
    return s.select("field", F.round(bands.sample_size_needed(F.col("cramers_v")), 4).alias("sample_size"))


@register("interaction_class", f"WITH {LIFTS} SELECT field_1, field_2, interaction, action FROM lift_report")
def interaction_class(spark, sf):
    report = stats.lift_report(signatures(spark, sf), FLAGS, TARGET)
    return report.select("field_1", "field_2", "interaction", "action")


@register(
    "risk_band",
    f"""WITH {SCORED} SELECT txn_key,
      CASE WHEN p > 0.8 THEN 'CRITICAL' WHEN p > 0.6 THEN 'HIGH' WHEN p > 0.4 THEN 'MODERATE' ELSE 'LOW' END AS risk,
      CASE WHEN p > 0.8 THEN 'Immediate intervention required' WHEN p > 0.6 THEN 'Urgent review recommended'
           WHEN p > 0.4 THEN 'Monitor closely' ELSE 'Standard monitoring' END AS action
      FROM scored""",
)
def risk_band(spark, sf):
    p = F.col("p")
    return scored(spark, sf).select("txn_key", bands.risk_level(p).alias("risk"), bands.risk_action(p).alias("action"))


@register(
    "missing_indicators",
    f"""WITH {TXN} SELECT txn_key, l_quantity, price_null, CAST(l_quantity IS NULL AS INT) AS l_quantity_missing,
        CAST(price_null IS NULL AS INT) AS price_null_missing FROM txn""",
)
def missing_indicators(spark, sf):
    t = txn(spark, sf, ["txn_key", "l_quantity", "price_null"])
    return rows.missing_indicators(t, ["l_quantity", "price_null"])


@register(
    "fill_missing_category",
    f"WITH {TXN} SELECT txn_key, coalesce(sector_null, 'MISSING') AS sector_filled FROM txn",
)
def fill_missing_category(spark, sf):
    t = txn(spark, sf, ["txn_key", "sector_null"])
    return t.select("txn_key", rows.fill_missing_category("sector_null").alias("sector_filled"))


@register(
    "interaction_features",
    f"WITH {TXN} SELECT txn_key, "
    + ", ".join(
        f"{a}*{b} AS {a}_x_{b}, {a}/({b}+1e-8::DOUBLE) AS {a}_div_{b}" for a, b in combinations(NUMERIC[:6], 2)
    )
    + " FROM txn",
)
def interaction_features(spark, sf):
    t = txn(spark, sf, ["txn_key", *NUMERIC])
    return rows.interaction_features(t, NUMERIC).drop(*NUMERIC)


_STAT_COLS = ["l_quantity", "price_null", "l_discount", "l_tax", "p_retailprice"]
_STAT_LIST = "list_filter([" + ", ".join(_STAT_COLS) + "], lambda x: x IS NOT NULL)"


@register(
    "row_stats",
    f"""WITH {TXN} SELECT txn_key,
        {' + '.join(f'CAST({c} IS NULL AS INT)' for c in [*_STAT_COLS, 'sector_null'])} AS num_missing,
        round(list_avg({_STAT_LIST}), 4) AS num_features_mean, round(list_stddev_samp({_STAT_LIST}), 4) AS num_features_std
        FROM txn""",
)
def row_stats(spark, sf):
    t = txn(spark, sf, ["txn_key", *_STAT_COLS, "sector_null"])
    out = rows.row_stats(t, [*_STAT_COLS, "sector_null"], _STAT_COLS)
    return rounded(out, 4).select("txn_key", "num_missing", "num_features_mean", "num_features_std")


# Two-condition rules on flag pairs, with statistics from the data.
PAIR_RULES = f"""{PAIRS},
 prules AS (SELECT pair_name, field_1, field_2, rate_1 AS confidence, CAST(n11+n10 AS BIGINT) AS support,
            CAST(rate_1 > 0.5 AS INT) AS prediction FROM pairs)"""


def pair_rules(spark, sf):
    p = stats.chi2_pairwise(signatures(spark, sf), FLAGS, TARGET)
    cond = F.array(
        *[
            F.struct(F.col(f).alias("feature"), F.lit(">").alias("op"), F.lit(0.5).alias("threshold"))
            for f in ("field_1", "field_2")
        ]
    )
    return p.select(
        "pair_name",
        cond.alias("conditions"),
        F.col("rate_both").alias("confidence"),
        F.col("cases").alias("support"),
        (F.col("rate_both") > 0.5).cast("int").alias("prediction"),
    )


@register(
    "format_rule",
    f"""WITH {PAIR_RULES} SELECT pair_name, printf('IF %s > %.3f AND %s > %.3f THEN cash_break = %d (confidence: %.2f%%, support: %d samples)',
        field_1, 0.5::DOUBLE, field_2, 0.5::DOUBLE, prediction, confidence*100, support) AS rule_text FROM prules""",
)
def format_rule(spark, sf):
    c = F.col
    return pair_rules(spark, sf).select(
        "pair_name",
        text.format_rule(c("conditions"), c("prediction"), c("confidence"), c("support")).alias("rule_text"),
    )


_ITEMS_SQL = "list_filter([" + ", ".join(f"CASE WHEN {c}=1 THEN '{c}_changed' END" for c in FLAGS) + "], lambda x: x IS NOT NULL)"


@register(
    "rule_label",
    f"""WITH {TXN}, i AS (SELECT txn_key, {_ITEMS_SQL} AS items FROM txn)
        SELECT txn_key, concat(array_to_string(items[1:3], ' + '), CASE WHEN len(items) > 3 THEN '...' ELSE '' END) AS label FROM i""",
)
def rule_label(spark, sf):
    t = assoc.transactions(flags_txn(spark, sf, ["txn_key"]), FLAGS, None)
    return t.select("txn_key", text.rule_label(F.col("items")).alias("label"))


@register(
    "strip_item_suffix",
    f"""WITH {TXN}, i AS (SELECT txn_key, list_append({_ITEMS_SQL}, CASE WHEN was_exception=1 THEN 'BREAK_OCCURRED' ELSE 'NO_BREAK' END) AS items FROM txn),
        s AS (SELECT txn_key, list_transform(list_filter(items, lambda x: contains(x, '_changed')), lambda x: replace(x, '_changed', '')) AS f FROM i)
        SELECT txn_key, array_to_string(f, ',') AS fields, CAST(len(f) AS INT) AS num_changes FROM s""",
)
def strip_item_suffix(spark, sf):
    t = assoc.transactions(flags_txn(spark, sf, ["txn_key"]), FLAGS, TARGET)
    f = text.strip_item_suffix(F.col("items"))
    return t.select("txn_key", F.array_join(f, ",").alias("fields"), F.size(f).alias("num_changes"))


@register(
    "nl_rule_text",
    f"""WITH {PAIR_RULES}, s AS (SELECT p.*, p.confidence - greatest(a.rate_1, b.rate_1) AS synergy FROM prules p
          JOIN singles a ON a.field = field_1 JOIN singles b ON b.field = field_2)
        SELECT pair_name,
          printf('When %s > %.2f AND %s > %.2f, cash break probability increases to %.1f%% (synergy effect: +%.1f%%)',
            field_1, 0.5::DOUBLE, field_2, 0.5::DOUBLE, confidence*100, synergy*100) AS interaction_text,
          printf(E'Cash break is likely when:\\n1. %s > %.2f (indicates %s will change)\\n2. This leads to %.1f%% chance of cash break\\n3. This pattern occurred %d times historically',
            field_1, 0.5::DOUBLE, field_2, confidence*100, support) AS composite_text
        FROM s WHERE synergy > 0""",
)
def nl_rule_text(spark, sf):
    c = F.col
    singles = stats.chi2_individual(signatures(spark, sf), FLAGS, TARGET).select("field", "rate_changed")
    r = pair_rules(spark, sf).withColumn("f1", c("conditions")[0]["feature"]).withColumn("f2", c("conditions")[1]["feature"])
    r = r.join(singles.toDF("f1", "r1"), "f1").join(singles.toDF("f2", "r2"), "f2")
    r = r.withColumn("synergy", c("confidence") - F.greatest("r1", "r2")).filter("synergy > 0")
    return r.select(
        "pair_name",
        text.interaction_rule_text(c("conditions"), c("confidence"), c("synergy")).alias("interaction_text"),
        text.composite_rule_text(c("f1"), F.lit(">"), F.lit(0.5), c("f2"), c("confidence"), c("support")).alias(
            "composite_text"
        ),
    )


@register(
    "actionable_fields",
    f"""WITH {SINGLES} SELECT field, {r6('chi2', 'lift')}, round(rate_1,6) AS rate_changed FROM singles
        WHERE chi2 > 3.841458820694124 AND rate_1 > 0.3 AND lift > 1.5""",
)
def actionable_fields(spark, sf):
    s = stats.chi2_individual(signatures(spark, sf), FLAGS, TARGET)
    return rounded(insights.actionable_fields(s).select("field", "chi2", "lift", "rate_changed"))


@register(
    "dangerous_pairs",
    f"""WITH {PAIRS} SELECT pair_name, CAST(cases AS BIGINT) AS cases, {r6('chi2')}, round(rate_1,6) AS rate_both FROM pairs
        WHERE chi2 > 3.841458820694124 AND cases >= 10 AND rate_1 > 0.3""",
)
def dangerous_pairs(spark, sf):
    p = stats.chi2_pairwise(signatures(spark, sf), FLAGS, TARGET)
    return rounded(insights.dangerous_pairs(p).select("pair_name", "cases", "chi2", "rate_both"))


@register(
    "pattern_summary",
    f"""WITH {TRIPS}, s1 AS (SELECT * FROM singles ORDER BY chi2 DESC, field LIMIT 1),
      p1 AS (SELECT * FROM pairs ORDER BY chi2 DESC, pair_name LIMIT 1),
      t1 AS (SELECT * FROM trips ORDER BY chi2 DESC, triplet_name LIMIT 1)
      SELECT 'individual' AS section, 'significant' AS item, CAST(count_if(chi2 > 3.841458820694124) AS DOUBLE) AS value FROM singles
      UNION ALL SELECT 'individual', 'tested', CAST(count(*) AS DOUBLE) FROM singles
      UNION ALL SELECT 'individual', concat('top: ', field), round(rate_1, 6) FROM s1
      UNION ALL SELECT 'individual', concat('top lift: ', field), round(lift, 6) FROM s1
      UNION ALL SELECT 'pairwise', 'significant', CAST(count_if(chi2 > 3.841458820694124) AS DOUBLE) FROM pairs
      UNION ALL SELECT 'pairwise', 'tested', CAST(count(*) AS DOUBLE) FROM pairs
      UNION ALL SELECT 'pairwise', concat('top: ', pair_name), round(rate_1, 6) FROM p1
      UNION ALL SELECT 'pairwise', concat('top interaction lift: ', pair_name), round(interaction_lift, 6) FROM p1
      UNION ALL SELECT 'triplet', concat('top: ', triplet_name), round(rate_1, 6) FROM t1
      UNION ALL SELECT 'recommendation', concat('monitor: ', field), round(lift, 6) FROM
         (SELECT * FROM singles WHERE lift > 2 ORDER BY chi2 DESC, field LIMIT 3)
      UNION ALL SELECT 'recommendation', concat('watch: ', pair_name), round(interaction_lift, 6) FROM
         (SELECT * FROM pairs WHERE interaction_lift > 1.5 ORDER BY chi2 DESC, pair_name LIMIT 2)""",
)
def pattern_summary(spark, sf):
    sig = signatures(spark, sf)
    return rounded(
        insights.pattern_summary(
            stats.chi2_individual(sig, FLAGS, TARGET),
            stats.chi2_pairwise(sig, FLAGS, TARGET),
            stats.chi2_triplet(sig, FLAGS, TARGET),
        )
    )


@register(
    "consistency_check",
    f"""WITH {TXN}
    SELECT 'factor_flag_vs_discount' AS check_name, count_if(chg_factor <> CAST(l_discount > 0.075 AS INT)) AS n_rows FROM txn
    UNION ALL SELECT 'price_vs_quantity_times_retail', count_if(abs(l_extendedprice - l_quantity*p_retailprice) > 0.01*l_extendedprice) FROM txn
    UNION ALL SELECT 'orders_without_partner', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'part_without_partner', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'supplier_without_partner', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)""",
)
def consistency_check(spark, sf):
    t = txn(spark, sf, ["chg_factor", "l_discount", "l_extendedprice", "l_quantity", "p_retailprice"])
    return insights.consistency_check(
        t,
        {
            "factor_flag_vs_discount": F.col("chg_factor") != (F.col("l_discount") > 0.075).cast("int"),
            "price_vs_quantity_times_retail": F.abs(F.col("l_extendedprice") - F.col("l_quantity") * F.col("p_retailprice"))
            > 0.01 * F.col("l_extendedprice"),
        },
    ).unionByName(orphan_keys(spark, sf))


@register(
    "ratio_guard",
    f"""WITH {TXN} SELECT 'price_per_discount' AS ratio, count_if(l_discount = 0) AS zero_denominators,
        round(avg(CASE WHEN l_discount <> 0 THEN l_tax/l_discount END), 6) AS mean_ratio FROM txn""",
)
def ratio_guard(spark, sf):
    t = txn(spark, sf, ["l_tax", "l_discount"])
    return rounded(insights.ratio_guard(t, "price_per_discount", "l_tax", "l_discount"))
