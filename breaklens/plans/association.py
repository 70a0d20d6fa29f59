"""Baskets, rules and co-occurrence."""

from itertools import combinations

from pyspark.sql import functions as F

from breaklens.operators import assoc, network, prep, splits
from breaklens.plans.parts import flags_txn, rounded, signatures
from breaklens.plans.registry import TXN, register
from breaklens.scale import key_hash_sql
from breaklens.sources.tables import txn
from breaklens.spec import FLAGS, TARGET

H = key_hash_sql("txn_key")
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.3


def _item_list(cond_items: list[tuple[str, str]]) -> str:
    return (
        "list_filter(["
        + ", ".join(f"CASE WHEN {cond} THEN '{item}' END" for cond, item in cond_items)
        + "], lambda x: x IS NOT NULL)"
    )


_BASKET = [(f"{c}=1", f"{c}_changed") for c in FLAGS] + [
    ("was_exception=1", assoc.BREAK),
    ("was_exception=0", assoc.NO_BREAK),
]


def rules_sql(base: str, src: str, items: list[tuple[str, str]], min_support: float, min_conf: float, min_lift: float) -> str:
    """Itemsets and rules by enumerating bit masks over all items: nothing is pruned on the way.

    Items are (condition, name expression or plain name).
    """
    mask = " + ".join(f"CASE WHEN {cond} THEN {1 << i} ELSE 0 END" for i, (cond, _) in enumerate(items))
    names = "[" + ", ".join(item if item.startswith("printf(") else f"'{item}'" for _, item in items) + "]"
    base = f"{base}, item_names AS (SELECT {names} AS l)"
    listing = "list_sort(list_filter((SELECT l FROM item_names), lambda x, i: ({m} >> (i-1)) & 1 = 1))"
    return f"""{base}, m AS (SELECT {mask} AS mask, count(*) AS n FROM {src} GROUP BY 1), tot AS (SELECT sum(n)::DOUBLE AS t FROM m),
      sets AS (SELECT k, sum(n)::BIGINT AS n, sum(n)/(SELECT t FROM tot) AS support FROM m JOIN range(1, {1 << len(items)}) r(k) ON (mask & k) = k
               GROUP BY k HAVING sum(n) >= {min_support}::DOUBLE * (SELECT t FROM tot)),
      itemsets AS (SELECT {listing.format(m='k')} AS itemset, n, support FROM sets),
      rules AS (SELECT {listing.format(m='a.k')} AS antecedents, {listing.format(m='c.k')} AS consequents, a.support AS antecedent_support,
                c.support AS consequent_support, s.support AS support, s.n AS n, s.support/a.support AS confidence, s.support/a.support/c.support AS lift
                FROM sets s JOIN sets a ON (s.k & a.k) = a.k AND a.k <> s.k JOIN sets c ON c.k = s.k - a.k
                WHERE s.support/a.support >= {min_conf} - 1e-12 AND s.support/a.support/c.support >= {min_lift} - 1e-12)"""


RULES = rules_sql(TXN, "txn", _BASKET, MIN_SUPPORT, MIN_CONFIDENCE, 1.0)
_KEYS = "array_to_string(antecedents, ',') AS antecedents, array_to_string(consequents, ',') AS consequents"


def baskets(spark, sf, extra=None):
    return assoc.transactions(flags_txn(spark, sf, extra), FLAGS, TARGET)


def itemsets(spark, sf):
    b = assoc.transactions(txn(spark, sf, [*FLAGS, TARGET], heavy=True), FLAGS, TARGET)
    return assoc.frequent_itemsets(b.select("items"), MIN_SUPPORT)


def rules(spark, sf):
    return assoc.association_rules(itemsets(spark, sf), MIN_CONFIDENCE, 1.0)


def _text(df):
    return df.withColumns({c: F.array_join(c, ",") for c in ("antecedents", "consequents")})


@register(
    "transactions",
    f"WITH {TXN} SELECT txn_key, array_to_string({_item_list(_BASKET)}, ',') AS items FROM txn",
)
def transactions(spark, sf):
    return baskets(spark, sf, ["txn_key"]).select("txn_key", F.array_join("items", ",").alias("items"))


@register(
    "frequent_itemsets",
    f"WITH {RULES} SELECT array_to_string(itemset, ',') AS itemset, n, round(support, 6) AS support FROM itemsets",
)
def frequent_itemsets(spark, sf):
    return rounded(itemsets(spark, sf)).withColumn("itemset", F.array_join("itemset", ","))


@register(
    "association_rules",
    f"WITH {RULES} SELECT {_KEYS}, round(support,6) AS support, round(confidence,6) AS confidence, round(lift,6) AS lift FROM rules",
)
def association_rules(spark, sf):
    r = rules(spark, sf).orderBy(F.desc("confidence"), F.desc("lift"))
    return rounded(_text(r).select("antecedents", "consequents", "support", "confidence", "lift"))


@register(
    "rule_measures",
    f"""WITH {RULES} SELECT {_KEYS}, n, round(antecedent_support,6) AS antecedent_support, round(consequent_support,6) AS consequent_support,
        round(support - antecedent_support*consequent_support, 6) AS leverage,
        round((1-consequent_support)/(1-confidence), 6) AS conviction FROM rules""",
)
def rule_measures(spark, sf):
    cols = ["antecedents", "consequents", "n", "antecedent_support", "consequent_support", "leverage", "conviction"]
    return rounded(_text(rules(spark, sf)).select(*cols))


_BREAKS = f"""{RULES}, brk AS (SELECT *, list_transform(list_filter(antecedents, lambda x: contains(x, '_changed')), lambda x: replace(x, '_changed', '')) AS f
   FROM rules WHERE list_contains(consequents, 'BREAK_OCCURRED'))"""


@register(
    "break_rules",
    f"""WITH {_BREAKS} SELECT {_KEYS}, array_to_string(f, ',') AS antecedent_changes, CAST(len(f) AS INT) AS num_changes,
        round(support,6) AS support, round(confidence,6) AS confidence, round(lift,6) AS lift FROM brk""",
)
def break_rules(spark, sf):
    r = _text(assoc.break_rules(rules(spark, sf))).withColumn("antecedent_changes", F.array_join("antecedent_changes", ","))
    return rounded(
        r.select("antecedents", "consequents", "antecedent_changes", "num_changes", "support", "confidence", "lift")
    )


@register(
    "top_break_predictors",
    f"""WITH {_BREAKS} SELECT array_to_string(f, ',') AS antecedent_changes,
        concat(array_to_string(f[1:3], ' + '), CASE WHEN len(f) > 3 THEN '...' ELSE '' END) AS label,
        round(support,6) AS support, round(confidence,6) AS confidence, round(lift,6) AS lift, CAST(len(f) AS INT) AS num_changes
        FROM brk ORDER BY round(brk.confidence,12) DESC, round(brk.lift,12) DESC, antecedents, consequents LIMIT 10""",
)
def top_break_predictors(spark, sf):
    r = assoc.top_break_predictors(rules(spark, sf), 10)
    return rounded(r.withColumn("antecedent_changes", F.array_join("antecedent_changes", ",")))


@register(
    "rule_complexity_hist",
    f"WITH {_BREAKS} SELECT CAST(len(f) AS INT) AS num_changes, count(*) AS n FROM brk GROUP BY 1",
)
def rule_complexity_hist(spark, sf):
    return assoc.break_rules(rules(spark, sf)).groupBy("num_changes").agg(F.count("*").alias("n"))


_SORTED = sorted(_BASKET, key=lambda t: t[1])
_MASK = " + ".join(f"CASE WHEN {cond} THEN {1 << i} ELSE 0 END" for i, (cond, _) in enumerate(_SORTED))
_NAMES = "[" + ", ".join(f"'{item}'" for _, item in _SORTED) + "]"
_BREAK_BIT = 1 << [item for _, item in _SORTED].index(assoc.BREAK)
_LIST = "array_to_string(list_filter({names}, lambda x, i: ({m} >> (i-1)) & 1 = 1), ',')"


@register(
    "rule_stability",
    f"""WITH {TXN}, fo AS (SELECT *, (row_number() OVER (PARTITION BY was_exception ORDER BY {H}, txn_key) - 1) % 5 AS fold_id FROM txn),
      m AS (SELECT fold_id, {_MASK} AS mask, count(*) AS n FROM fo GROUP BY ALL),
      tot AS (SELECT f, sum(n)::DOUBLE AS t FROM m, range(5) r(f) WHERE fold_id <> f GROUP BY f),
      sets AS (SELECT f, k, sum(n)::DOUBLE/any_value(t) AS support FROM m JOIN range(1, {1 << len(_SORTED)}) r(k) ON (mask & k) = k JOIN tot ON fold_id <> f
               GROUP BY f, k HAVING sum(n) >= {MIN_SUPPORT}::DOUBLE*any_value(t)),
      ru AS (SELECT s.f, a.k AS ak, c.k AS ck, s.support/a.support AS confidence, s.support/a.support/c.support AS lift FROM sets s
             JOIN sets a ON a.f=s.f AND (s.k & a.k) = a.k AND a.k <> s.k JOIN sets c ON c.f=s.f AND c.k = s.k - a.k
             WHERE s.support/a.support >= {MIN_CONFIDENCE}-1e-12 AND s.support/a.support/c.support >= 1-1e-12 AND (c.k & {_BREAK_BIT}) > 0)
      SELECT {_LIST.format(names=_NAMES, m='ak')} AS antecedents, {_LIST.format(names=_NAMES, m='ck')} AS consequents, count(*) AS folds,
        round(avg(confidence), 6) AS mean_confidence, round(stddev_pop(confidence), 6) AS std_confidence, round(avg(lift), 6) AS mean_lift FROM ru GROUP BY ak, ck""",
)
def rule_stability(spark, sf):
    t = txn(spark, sf, [*FLAGS, TARGET, "txn_key"], heavy=True)
    folded = splits.stratified_folds(t, "txn_key", TARGET, 5)
    b = assoc.transactions(folded, FLAGS, TARGET).select("items", "fold_id").persist()
    try:
        return rounded(_text(assoc.rule_stability(b, "fold_id", 5, MIN_SUPPORT, MIN_CONFIDENCE)))
    finally:
        b.unpersist()


@register(
    "break_vs_nobreak",
    f"""WITH {TXN}, r AS (SELECT *, row_number() OVER (PARTITION BY was_exception ORDER BY {H}, txn_key) AS rn FROM txn),
        k AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM txn GROUP BY was_exception))
        SELECT txn_key, CASE WHEN was_exception=1 THEN 'break' ELSE 'no_break' END AS class, array_to_string({_item_list(_BASKET)}, ',') AS items
        FROM r WHERE rn <= (SELECT c FROM k)""",
)
def break_vs_nobreak(spark, sf):
    sample = splits.balanced(flags_txn(spark, sf, ["txn_key"]), "txn_key", TARGET)
    b = assoc.transactions(sample, FLAGS, TARGET)
    cls = F.when(F.col(TARGET) == 1, "break").otherwise("no_break")
    return b.select("txn_key", cls.alias("class"), F.array_join("items", ",").alias("items"))


def _bins(c: str) -> list[tuple[str, str]]:
    q = f"(SELECT q FROM q_{c})"
    return [
        (f"{c} <= {q}[2]", f"printf('{c}_(%.3f, %.3f]', {q}[1], {q}[2])"),
        (f"({c} > {q}[2] AND {c} <= {q}[3])", f"printf('{c}_(%.3f, %.3f]', {q}[2], {q}[3])"),
        (f"{c} > {q}[3]", f"printf('{c}_(%.3f, %.3f]', {q}[3], {q}[4])"),
    ]


_DISC_BASE = f"{TXN}, " + ", ".join(
    f"q_{c} AS (SELECT quantile_cont({c}, [0, 1.0/3, 2.0/3, 1]) AS q FROM txn)" for c in ("l_quantity", "l_discount")
)
_DISC = [*_bins("l_quantity"), *_bins("l_discount")]
_DISC += [(f"{c}={v}", f"{c}={v}") for c in ("chg_factor", "chg_principal", "chg_coupon") for v in (0, 1)]
_DISC += [("was_exception=1", "cash_break")]


@register(
    "mine_discretised_rules",
    f"""WITH {rules_sql(_DISC_BASE, 'txn', _DISC, 0.01, 0.4, 0.0)} SELECT {_KEYS}, n, round(support,6) AS support, round(confidence,6) AS confidence,
        round(lift,6) AS lift FROM rules WHERE list_contains(consequents, 'cash_break')""",
)
def mine_discretised_rules(spark, sf):
    """Rules from binned features and categories to the break."""
    return rounded(_text(discretised_rules(spark, sf, 0.4)))


def discretised_rules(spark, sf, min_confidence, min_support=0.01):
    numeric, flags = ["l_quantity", "l_discount"], ["chg_factor", "chg_principal", "chg_coupon"]
    t = txn(spark, sf, [*numeric, *flags, TARGET], heavy=True)
    fitted = prep.fit_qcut(t, numeric, 3)
    items = prep.qcut_items(t, fitted, flags, "feature_items")
    target = F.when(F.col(TARGET) == 1, F.array(F.lit("cash_break"))).otherwise(F.array().cast("array<string>"))
    b = items.select(F.concat("feature_items", target).alias("items"))
    sets = assoc.frequent_itemsets(b, min_support)
    r = assoc.association_rules(sets, min_confidence, 0.0, consequent_has="cash_break")
    return r.select("antecedents", "consequents", "confidence", "support", "lift", "n")


_PAIRS = list(combinations(FLAGS, 2))
_COOC = f"""{TXN}, cooc AS ({' UNION ALL '.join(
    f"SELECT '{a}' AS field_1, '{b}' AS field_2, was_exception AS y, {a} AS f1, {b} AS f2 FROM txn" for a, b in _PAIRS)})"""
_J = "coalesce(count_if(f1=1 AND f2=1 {0})/nullif(count_if((f1=1 OR f2=1) {0}), 0), 0)"


@register(
    "cooccurrence_counts",
    f"""WITH {_COOC} SELECT field_1, field_2, count_if(f1=1) AS c1, count_if(f2=1) AS c2, count_if(f1=1 AND f2=1) AS c12 FROM cooc GROUP BY ALL""",
)
def cooccurrence_counts(spark, sf):
    return network.cooccurrence_counts(signatures(spark, sf), FLAGS)


@register(
    "jaccard_matrix",
    f"""WITH {_COOC}, j AS (SELECT field_1, field_2, {_J.format('')} AS jaccard FROM cooc GROUP BY ALL)
        SELECT field_1, field_2, round(jaccard, 6) AS jaccard FROM (SELECT * FROM j UNION ALL SELECT field_2, field_1, jaccard FROM j
        UNION ALL SELECT f, f, 1.0 FROM (VALUES {', '.join(f"('{c}')" for c in FLAGS)}) v(f))""",
)
def jaccard_matrix(spark, sf):
    return rounded(network.jaccard_matrix(network.cooccurrence_counts(signatures(spark, sf), FLAGS), FLAGS))


NETS = f"""{_COOC}, jac AS (SELECT field_1 AS src, field_2 AS dst, {_J.format('AND y=1')} AS wb, {_J.format('AND y=0')} AS wn FROM cooc GROUP BY ALL),
   edges AS (SELECT 'break' AS network_type, src, dst, wb AS weight FROM jac WHERE abs(wb) > 0.1
    UNION ALL SELECT 'no_break', src, dst, wn FROM jac WHERE abs(wn) > 0.1
    UNION ALL SELECT 'difference', src, dst, wb-wn FROM jac WHERE abs(wb-wn) > 0.05)"""


def edges(spark, sf):
    return network.networks(signatures(spark, sf), FLAGS, TARGET)


@register("cooccurrence_networks", f"WITH {NETS} SELECT network_type, src, dst, round(weight, 6) AS weight FROM edges")
def cooccurrence_networks(spark, sf):
    return rounded(edges(spark, sf))


@register(
    "critical_pairs",
    f"""WITH {NETS} SELECT 'strongest_break_pairs' AS list_name, src, dst, round(weight, 6) AS weight FROM
          (SELECT * FROM edges WHERE network_type='break' ORDER BY round(weight,12) DESC, src, dst LIMIT 10)
        UNION ALL SELECT 'most_break_specific_pairs', src, dst, round(weight, 6) FROM
          (SELECT * FROM edges WHERE network_type='difference' ORDER BY round(weight,12) DESC, src, dst LIMIT 10)""",
)
def critical_pairs(spark, sf):
    return rounded(network.critical_pairs(edges(spark, sf)))
