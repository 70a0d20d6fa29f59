"""Rule extraction, ranking and explanation queries."""

from contextlib import contextmanager

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import functions as F

from breaklens.functions.text import composite_rule_text
from breaklens.operators import explain, extract, models, multitask, rules, ruleset, stats
from breaklens.operators.rules import Rule
from breaklens.plans.association import discretised_rules
from breaklens.plans.joining import CHAIN, LIST, break_rule_table, chain_rules, change_rule_table
from breaklens.plans.parts import PAIRS, r6, rounded, signatures
from breaklens.plans.registry import SCORED, TXN, register
from breaklens.plans.scalars import pair_rules
from breaklens.session import pin
from breaklens.sources.tables import scored, txn
from breaklens.spec import FLAGS, LABELS, TARGET

NUMERIC = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
FEATURES = [*FLAGS, *NUMERIC]


def rule_data(spark, sf):
    t = txn(spark, sf, ["txn_key", "bucket", "fold", *FEATURES, TARGET, *LABELS], heavy=True)
    return models.assemble(t, FEATURES)


def gbt(rounds=3, depth=3):
    return GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=depth, seed=models.SEED)


def shown(df):
    """Rule table with readable conditions."""
    return df.withColumn("conditions", F.array_join(F.transform("conditions", lambda x: F.format_string("%s %s %.3f", x["feature"], x["op"], x["threshold"])), " AND "))


@register("tree_rules")
def tree_rules(spark, sf):
    d = rule_data(spark, sf)
    tree = models.fit("tree", extract.small_tree(5), d, TARGET)
    return shown(rules.rules_frame(spark, rules.tree_rules(tree.model, FEATURES, spark, 50, 0.5)))


@register("surrogate_rules")
def surrogate_rules(spark, sf):
    d = rule_data(spark, sf)
    with models.cached(d):
        m = models.fit("gbt", gbt(), d, TARGET)
        found, _ = extract.surrogate(m.score(d), "prob", FEATURES)
    return shown(rules.rules_frame(spark, found))


@register("anchor_rules")
def anchor_rules(spark, sf):
    with models.cached(rule_data(spark, sf)) as d:
        m = models.fit("tree", extract.small_tree(5), d, TARGET)
        numeric, flags = ["l_quantity", "l_discount"], ["chg_factor", "chg_principal", "chg_coupon"]
        with models.cached(m.score(d).select("txn_key", *numeric, *flags, "features", "pred")) as s:
            return pin(extract.anchor_rules(s, "txn_key", numeric, flags, "pred", clusters=6), "anchors")  # a row per cluster


@register("gbm_path_ranges")
def gbm_path_ranges(spark, sf):
    """Merged range per feature over all tree paths, for rows with P > .7."""
    d = rule_data(spark, sf)
    with models.cached(d):
        m = models.fit("gbt", gbt().setLeafCol("leaves"), d, TARGET)
    found = rules.leaves(m.model, FEATURES, spark)
    out = m.model.transform(d)
    p = F.get(models.vector_to_array("probability"), F.lit(1))
    out = out.filter(p > 0.7).select("txn_key", p.alias("prob"), models.vector_to_array("leaves").alias("leaves"))
    return out.select("txn_key", "prob", rules.path_ranges(found, "leaves", FEATURES).alias("ranges"))


@register("gbm_important_rules")
def gbm_important_rules(spark, sf):
    d = rule_data(spark, sf)
    with models.cached(d):
        m = models.fit("gbt", gbt(), d, TARGET)
        return extract.important_ranges(d, m, FEATURES, TARGET, 5)


_GF = ["l_discount", "l_quantity", "l_tax"]
_DEC = "[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]"


def greedy_sql(max_rules: int) -> str:
    parts = [
        TXN,
        "cuts AS ("
        + " UNION ALL ".join(
            f"SELECT DISTINCT '{f}' AS f, c FROM (SELECT unnest(quantile_cont({f}, {_DEC})) AS c FROM txn) WHERE c < (SELECT max({f}) FROM txn)"
            for f in _GF
        )
        + ")",
        f"rem0 AS (SELECT txn_key, was_exception AS y, {', '.join(_GF)} FROM txn)",
    ]
    x = "CASE b.f " + " ".join(f"WHEN '{f}' THEN r.{f}" for f in _GF) + " END"
    for i in range(1, max_rules + 1):
        prev = f"rem{i - 1}"
        long = " UNION ALL ".join(f"SELECT '{f}' AS f, {f} AS x, y FROM {prev}" for f in _GF)
        parts.append(
            f"""s{i} AS (SELECT f, c, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p, count_if(x<=c)::DOUBLE AS nl, coalesce(sum(y) FILTER (x<=c),0)::DOUBLE AS pl
              FROM ({long}) JOIN cuts USING (f) GROUP BY ALL)"""
        )
        parts.append(
            f"""b{i} AS (SELECT *, CASE WHEN pl/nl > (p-pl)/(n-nl) THEN '<=' ELSE '>' END AS op FROM s{i}
              WHERE nl >= floor(n*0.05) AND n-nl >= floor(n*0.05) AND n >= 0.01*(SELECT count(*) FROM rem0) AND p > 0 AND p < n
              ORDER BY round(2*p/n*(1-p/n) - nl/n*2*pl/nl*(1-pl/nl) - (n-nl)/n*2*(p-pl)/(n-nl)*(1-(p-pl)/(n-nl)), 12) DESC, f, c LIMIT 1)"""
        )
        parts.append(f"rem{i} AS (SELECT r.* FROM {prev} r, b{i} b WHERE NOT (CASE WHEN b.op = '<=' THEN {x} <= b.c ELSE {x} > b.c END))")
    out = []
    for i in range(1, max_rules + 1):
        conf, sup = ("CASE WHEN op = '<=' THEN pl/nl ELSE (p-pl)/(n-nl) END", "CASE WHEN op = '<=' THEN nl ELSE n-nl END")
        out.append(
            f"SELECT 'rule_{i - 1}' AS name, concat(f, ' ', op, ' ', printf('%.3f', c)) AS conditions, CAST({conf} > 0.5 AS INT) AS prediction, round({conf}, 6) AS confidence, CAST({sup} AS BIGINT) AS support FROM b{i}"
        )
    out.append(
        f"SELECT 'rule_{max_rules}', '', CAST(avg(y) > 0.5 AS INT), round(CASE WHEN avg(y) > 0.5 THEN avg(y) ELSE 1-avg(y) END, 6), count(*) FROM rem{max_rules}"
    )
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(out)


def greedy(spark, sf):
    t = txn(spark, sf, [*_GF, TARGET])
    return rules.greedy_rule_list(t, _GF, TARGET, max_rules=4)


@register("greedy_rule_list", greedy_sql(4))
def greedy_rule_list(spark, sf):
    out = shown(rules.rules_frame(spark, greedy(spark, sf)))
    return rounded(out.select("name", "conditions", "prediction", "confidence", "support"))


_ELSE = [*LIST, Rule((), 0, 0.9, 0, name="rule_4")]
_COND_TEXT = ["l_discount > 0.075 AND l_quantity > 39.500", "l_quantity > 39.500 AND l_tax > 0.055", "l_discount > 0.075", "l_tax <= 0.015"]
_COND_SQL = ["l_discount > 0.075 AND l_quantity > 39.5", "l_quantity > 39.5 AND l_tax > 0.055", "l_discount > 0.075", "l_tax <= 0.015"]


@register(
    "rule_list_predict",
    f"WITH {TXN} SELECT txn_key, CASE WHEN {_COND_SQL[0]} THEN 1 ELSE 0 END AS rule_prediction, CASE "
    + " ".join(f"WHEN {c} THEN 'Rule {i}: IF {t} THEN {1 if i == 0 else 0}'" for i, (c, t) in enumerate(zip(_COND_SQL, _COND_TEXT)))
    + " ELSE 'Default rule: predict 0' END AS explanation FROM txn",
)
def rule_list_predict(spark, sf):
    t = txn(spark, sf, ["txn_key", "l_discount", "l_quantity", "l_tax"])
    return rules.predict_rule_list(t, _ELSE).select("txn_key", "rule_prediction", "explanation")


@register("change_rules")
def change_rules(spark, sf):
    d = rule_data(spark, sf)
    with models.cached(d):
        found = extract.change_rules(d, FEATURES, FLAGS, TARGET, 0.3, 10, 0.6)
    return shown(rules.rules_frame(spark, found))


# Single and pair rules measured on the data, as two methods to combine.
_SCORE = "0.4*confidence + 0.3*least(support/1000.0::DOUBLE, 1) + 0.2*least(lift/3, 1) + 0.1/(1+k)"
_COMBINED = f"""{PAIRS}, base AS (SELECT avg(was_exception) AS r FROM txn),
  comb AS (SELECT field AS name, concat(field, ' > 0.500') AS conditions, 1 AS k, rate_1 AS confidence, CAST(n11+n10 AS BIGINT) AS support,
      rate_1/(SELECT r FROM base) AS lift, 'change_rules' AS method FROM singles
    UNION ALL SELECT pair_name, concat(field_1, ' > 0.500 AND ', field_2, ' > 0.500'), 2, rate_1, CAST(n11+n10 AS BIGINT), rate_1/(SELECT r FROM base), 'association_rules' FROM pairs),
  sc AS (SELECT *, {_SCORE} AS score FROM comb)"""


def combined_rules(spark, sf):
    sig = signatures(spark, sf)
    base = sig.agg(F.sum(F.col("n") * F.col(TARGET)) / F.sum("n")).scalar()
    one = stats.chi2_individual(sig, FLAGS, TARGET)
    cond = F.array(F.struct(F.col("field").alias("feature"), F.lit(">").alias("op"), F.lit(0.5).alias("threshold")))
    singles = one.select(
        F.col("field").alias("name"),
        cond.alias("conditions"),
        F.lit(1).alias("prediction"),
        F.col("rate_changed").alias("confidence"),
        (F.col("n11") + F.col("n10")).alias("support"),
        (F.col("rate_changed") / base).alias("lift"),
        F.lit("change_rules").alias("method"),
    )
    pairs = pair_rules(spark, sf).select(
        F.col("pair_name").alias("name"),
        "conditions",
        F.lit(1).alias("prediction"),
        "confidence",
        "support",
        (F.col("confidence") / base).alias("lift"),
        F.lit("association_rules").alias("method"),
    )
    return rules.rank_and_combine([singles, pairs])


@register("rule_score", f"WITH {_COMBINED} SELECT name, round(score, 6) AS score FROM sc")
def rule_score(spark, sf):
    return rounded(combined_rules(spark, sf).select("name", "score"))


@register(
    "rule_rank_combine",
    f"WITH {_COMBINED} SELECT name, method, conditions, {r6('confidence', 'lift', 'score')}, support FROM sc",
)
def rule_rank_combine(spark, sf):
    return rounded(shown(combined_rules(spark, sf)).select("name", "method", "conditions", "confidence", "lift", "score", "support"))


@register(
    "ops_rule_report",
    f"""WITH {_COMBINED} SELECT name, concat(printf('(Confidence: %.1f%%) WHEN: ', confidence*100), conditions, ' THEN: Cash Break Likely',
        printf(' Support: %d historical cases', support), printf(' Lift: %.2fx more likely than baseline', lift), ' Detection Method: ', method) AS report
        FROM (SELECT * FROM sc ORDER BY round(score, 12) DESC, name LIMIT 10)""",
)
def ops_rule_report(spark, sf):
    return rules.ops_report(combined_rules(spark, sf), 10)


def all_rules(spark, sf):
    """Tree, association and change rules on one schema, ranked."""
    d = rule_data(spark, sf)
    with models.cached(d):
        tree = models.fit("tree", extract.small_tree(5), d, TARGET)
        found = rules.measure(d, rules.tree_rules(tree.model, FEATURES, spark, 50, 0.6, "tree_rules"), TARGET)
        found += extract.change_rules(d, FEATURES, FLAGS, TARGET, 0.3, 10, 0.6)
    mined = discretised_rules(spark, sf, 0.6)
    cond = F.transform("antecedents", lambda x: F.struct(x.alias("feature"), F.lit("=").alias("op"), F.lit(1.0).alias("threshold")))
    mined = mined.select(
        F.array_join("antecedents", " & ").alias("name"),
        cond.alias("conditions"),
        F.lit(1).alias("prediction"),
        "confidence",
        F.col("n").alias("support"),
        "lift",
        F.lit("association_rules").alias("method"),
    )
    return rules.rank_and_combine([rules.rules_frame(spark, found), mined])


@register("extract_comprehensive_rules")
def extract_comprehensive_rules(spark, sf):
    return shown(all_rules(spark, sf))


_CUBE_NAME = " ".join(
    f"CASE WHEN {c} IS NOT NULL THEN ['{c} = ' || {c}] ELSE [] END" + (" ||" if c != FLAGS[-1] else "") for c in FLAGS
)


@register(
    "rule_dedup",
    f"""WITH RECURSIVE {TXN},
        cu AS (SELECT {', '.join(FLAGS)}, count(*) AS support, sum(was_exception)::DOUBLE / count(*) AS confidence FROM txn GROUP BY CUBE ({', '.join(FLAGS)})),
        r AS (SELECT {_CUBE_NAME} AS items, support, confidence, confidence / (SELECT avg(was_exception) FROM txn) AS lift FROM cu WHERE support >= 50),
        s AS (SELECT *, array_to_string(items, ' AND ') AS name,
                confidence * 0.4::DOUBLE + least(support / 1000.0::DOUBLE, 1) * 0.3::DOUBLE + least(lift / 3.0::DOUBLE, 1) * 0.2::DOUBLE + 0.1::DOUBLE / (1 + len(items)) AS score
              FROM r WHERE len(items) > 0),
        p AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, name) AS i FROM s),
        bt AS MATERIALIZED (SELECT y.i, list(x.i) FILTER (len(list_intersect(x.items, y.items)) > 0.8::DOUBLE * len(list_distinct(x.items || y.items))) AS better
              FROM p y LEFT JOIN p x ON x.i < y.i GROUP BY y.i),
        g(i, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
              SELECT bt.i, CASE WHEN list_has_any(kept, coalesce(better, [])) THEN kept ELSE list_append(kept, bt.i) END FROM g JOIN bt ON bt.i = g.i + 1)
        SELECT name, name AS conditions, 1 AS prediction, round(confidence, 6) AS confidence, support, round(lift, 6) AS lift, 'conjunctions' AS method, round(score, 6) AS score
        FROM p WHERE i IN (SELECT unnest(kept) FROM g WHERE i = (SELECT count(*) FROM p))""",
)
def rule_dedup(spark, sf):
    """Rules of all conjunctions of flags, without those too similar to a better one."""
    kept = ruleset.deduplicate(ruleset.conjunction_rules(signatures(spark, sf), FLAGS, TARGET))
    return rounded(kept.withColumn("conditions", F.col("name")))


@contextmanager
def chained(spark, sf, keep=True):
    """Scored rows of a chain (predicted_* columns, prob), and the chain itself.

    With `keep` the scores are kept while the caller reads them, made from the joined rows that the fits have read;
    those are given up before.
    """
    d = rule_data(spark, sf).withColumn("oof", F.col("fold") % 2)
    with models.cached(d):
        chain = multitask.fit_chain(d, LABELS, TARGET, extract.small_tree(4), extract.small_tree(5), 2, "oof")
        s = chain.score(d)
        if keep:
            s.persist().count()
    try:
        yield s, chain
    finally:
        if keep:
            s.unpersist()


@register("hierarchical_rules")
def hierarchical_rules(spark, sf):
    """Rules per change, rules from changes to the break, and direct rules, with fidelity."""
    with chained(spark, sf) as (s, _):
        found = hierarchy_levels(spark, s)
        rows = [(level, name, r.text(), r.confidence, r.support, fid) for level, name, rs, fid in found for r in rs]
    return spark.createDataFrame(rows, "level string, name string, rule string, confidence double, support bigint, fidelity double")


def hierarchy_levels(spark, s):
    """(level, name, rules, fidelity) of the three levels of surrogates."""
    names = [f"predicted_{y}" for y in sorted(LABELS)]
    ready = models.assemble(s, names, "_changes")
    asked = [extract.Mimic(f"predicted_{y}", FEATURES, 4, 50, 0.7, method=y) for y in LABELS]
    asked.append(extract.Mimic("prob", names, 3, 1, 0.5, features="_changes", method="meta"))
    asked.append(extract.Mimic("prob", FEATURES, 5, 30, 0.75, method="direct"))
    levels = [*[("change", y) for y in LABELS], ("meta", TARGET), ("direct", TARGET)]
    return [(*level, rs, fid) for level, (rs, fid) in zip(levels, extract.surrogates(ready, asked))]


@register("hierarchical_explain")
def hierarchical_explain(spark, sf):
    with chained(spark, sf) as (s, _):
        found = hierarchy_levels(spark, s)
        changes = {n: (f"predicted_{n}", rs) for level, n, rs, _ in found if level == "change"}
        meta = next(rs for level, _, rs, _ in found if level == "meta")
        direct = next(rs for level, _, rs, _ in found if level == "direct")
        return pin(explain.hierarchical(s, "txn_key", "prob", changes, meta, direct, 10), "explained")  # ten rows


@register(
    "explain_text",
    f"""WITH {SCORED}, t AS (SELECT txn_key, p, y, array_to_string(list_filter([CASE WHEN pred_factor=1 THEN 'factor payment' END,
          CASE WHEN pred_coupon=1 THEN 'coupon rate' END, CASE WHEN pred_date=1 THEN 'date' END], lambda x: x IS NOT NULL), ', ') AS ch FROM scored),
        h AS (SELECT ch, avg(y) AS share FROM t WHERE p > 0.7 GROUP BY 1)
        SELECT txn_key, concat(printf('Cash Break Risk: %.1f%%. ', p*100), CASE WHEN ch = '' THEN 'No specific field changes predicted, but other risk factors may be present.'
          ELSE concat('The model predicts changes in: ', ch, CASE WHEN p > 0.7 THEN printf('. HIGH RISK: this combination has led to cash breaks in %d%% of similar cases.', CAST(floor(share*100) AS INT))
          WHEN p > 0.4 THEN '. MODERATE RISK: Monitor these fields closely.' ELSE '.' END) END) AS explanation FROM t LEFT JOIN h USING (ch)""",
)
def explain_text(spark, sf):
    s = scored(spark, sf).select("txn_key", "p", "y", "pred_factor", "pred_coupon", "pred_date")
    probs = {"factor payment": "pred_factor", "coupon rate": "pred_coupon", "date": "pred_date"}
    return explain.explain_text(s, "p", probs, "y").select("txn_key", "explanation")


@register("threshold_rules")
def threshold_rules(spark, sf):
    d = rule_data(spark, sf)
    parts = []
    with models.cached(d):
        for t in (TARGET, "fld_coupon"):
            m = models.fit(t, gbt(), d, t)
            # 'x <= t' holds the low side; a rule for 1 - y finds what keeps the target away
            flipped = d.withColumn("_stable", 1 - F.col(t))
            parts += [(t, r.text(), r.confidence, r.support, r.extra["importance"]) for r in extract.threshold_rules(flipped, m, FEATURES, "_stable")]
    return spark.createDataFrame(parts, "target string, rule string, confidence double, support bigint, importance double")


@register("augmented_rules")
def augmented_rules(spark, sf):
    with chained(spark, sf) as (s, chain):
        found = extract.augmented_rules(s, chain.final, [*FEATURES, *chain.final_inputs], TARGET, 10, 1.2)
        if not found:
            # the final tree may split on flags alone; a model of the predictions alone always uses them
            ready = models.assemble(s, chain.final_inputs, "_p")
            m = models.fit("augmented", extract.small_tree(3, 1, "_p"), ready, TARGET)
            found = extract.augmented_rules(s, m, chain.final_inputs, TARGET, 10, 1.2)
    return shown(rules.rules_frame(spark, found))


@register(
    "composite_rules",
    f"""WITH {CHAIN} SELECT primary_condition, change, feature, {r6('full_chain_confidence')},
        printf(E'Cash break is likely when:\\n1. %s > %.2f (indicates %s will change)\\n2. This leads to %.1f%% chance of cash break\\n3. This pattern occurred %d times historically',
          feature, 0.5::DOUBLE, change, break_confidence*100, support) AS interpretation FROM chain
        ORDER BY round(chain.full_chain_confidence, 12) DESC, primary_condition LIMIT 5""",
)
def composite_rules(spark, sf):
    c = chain_rules(change_rule_table(spark, sf), break_rule_table(spark, sf))
    top = c.orderBy(F.desc(F.round("full_chain_confidence", 12)), "primary_condition").limit(5)
    text = composite_rule_text(F.col("feature"), F.lit(">"), F.lit(0.5), F.col("change"), F.col("break_confidence"), F.col("support"))
    return rounded(top.select("primary_condition", "change", "feature", "full_chain_confidence", text.alias("interpretation")))


@register("chain_trace")
def chain_trace(spark, sf):
    with chained(spark, sf, keep=False) as (s, chain):
        names = [*FEATURES]
        found = multitask.chain_rules(spark, chain, names, 50, 0.5)
        stages = {y: (f"predicted_{y}", [r for r in found if r.method == y and r.prediction == 1]) for y in LABELS}
        final = [r for r in found if r.method == TARGET and r.prediction == 1]
        return explain.chain_trace(s, "txn_key", "prob", stages, final)


_TASKS = [TARGET, *LABELS]
_IMP = " UNION ALL ".join(f"SELECT '{t}' AS task, '{f}' AS feature, abs(corr({f}, {t})) AS importance FROM txn" for t in _TASKS for f in NUMERIC)


@register(
    "shared_features",
    f"""WITH {TXN}, imp AS ({_IMP}), n AS (SELECT *, importance/(sum(importance) OVER (PARTITION BY task) + 1e-10::DOUBLE) AS share FROM imp)
        SELECT feature, count_if(share > 0.1) AS n_tasks, array_to_string(list_sort(list(task) FILTER (share > 0.1)), ',') AS tasks, round(avg(share), 6) AS avg_importance
        FROM n GROUP BY 1 HAVING count_if(share > 0.1) >= 2""",
)
def shared_features(spark, sf):
    """Importance of a feature for a task is its absolute correlation here, so that SQL can check it."""
    t = txn(spark, sf, [*NUMERIC, *_TASKS])
    wide = t.agg(*[F.abs(F.corr(f, y)).alias(f"{y}__{f}") for y in _TASKS for f in NUMERIC])
    items = [F.struct(F.lit(y).alias("task"), F.lit(f).alias("feature"), F.col(f"{y}__{f}").alias("importance")) for y in _TASKS for f in NUMERIC]
    return rounded(extract.shared_features(wide.select(F.inline(F.array(*items)))))


_SHARED = {"l_quantity": [TARGET, "fld_factor"], "l_discount": [TARGET, "fld_coupon"]}


def _side(f, y):
    return f"""SELECT '{f}' AS feature, q.p AS percentile, q.t AS threshold, '{y}' AS task, count_if({f}<=q.t) AS nb, count_if({f}>q.t) AS na,
      avg({y}) FILTER ({f}<=q.t) AS lo, avg({y}) FILTER ({f}>q.t) AS hi FROM txn,
      (SELECT unnest([0.25,0.5,0.75])::DOUBLE AS p, unnest(quantile_cont({f}, [0.25,0.5,0.75])) AS t FROM txn) q GROUP BY q.p, q.t"""


@register(
    "shared_rules",
    f"""WITH {TXN}, s AS ({' UNION ALL '.join(_side(f, y) for f, ys in _SHARED.items() for y in ys)}),
        d AS (SELECT *, CASE WHEN lo > hi THEN '<=' ELSE '>' END AS direction, greatest(lo, hi) AS confidence FROM s WHERE nb >= 20 AND na >= 20)
        SELECT feature, percentile, round(threshold, 6) AS threshold, min(direction) AS direction, array_to_string(list_sort(list(task)), ',') AS affects_tasks, round(avg(confidence), 6) AS avg_confidence
        FROM d GROUP BY feature, percentile, threshold HAVING count(DISTINCT direction) = 1 AND avg(confidence) > 0.3""",
)
def shared_rules(spark, sf):
    t = txn(spark, sf, [*_SHARED, *_TASKS])
    out = extract.shared_rules(t, _SHARED, min_confidence=0.3)
    return rounded(out.select("feature", "percentile", "threshold", "direction", "affects_tasks", "avg_confidence"))


def task_scores(spark, sf):
    """Rows with P of every task, from one tree per task."""
    with models.cached(rule_data(spark, sf)) as d:
        fitted = {y: models.fit(y, extract.small_tree(4), d, y) for y in _TASKS}
        out = d
        for y, m in fitted.items():
            out = m.score(out, f"predicted_{y}", "_h").drop("_h")
        # callers read the scores many times; the assembled features are columns of their own
        return pin(out.drop("features", "bucket", "fold"), "task-scores")


_PROBS = [f"predicted_{y}" for y in LABELS]


@register("interaction_rules")
def interaction_rules(spark, sf):
    with models.cached(task_scores(spark, sf)) as s:
        found = extract.interaction_rules(s, _PROBS, TARGET, min_synergy=0.01)
    rows = [(r.text(2), r.confidence, r.extra["synergy"], r.support) for r in found]
    return spark.createDataFrame(rows, "conditions string, joint_confidence double, synergy double, support bigint")


def explained_rows(spark, sf):
    s = task_scores(spark, sf)
    with models.cached(s):
        table = extract.shared_rules(s, _SHARED, min_confidence=0.3).orderBy("feature", "percentile").collect()
        inter = extract.interaction_rules(s, _PROBS, TARGET, min_synergy=0.01)
    shared = [Rule(((r["feature"], r["direction"], r["threshold"]),), 1, r["avg_confidence"], 0, name=r["interpretation"]) for r in table]
    return explain.unified(s, "txn_key", f"predicted_{TARGET}", dict(zip(LABELS, _PROBS)), shared, inter)


@register("unified_explain")
def unified_explain(spark, sf):
    return explained_rows(spark, sf)


@register("ops_risk_report")
def ops_risk_report(spark, sf):
    return explain.ops_report(explained_rows(spark, sf), "txn_key")


@register("root_causes")
def root_causes(spark, sf):
    s = task_scores(spark, sf)
    inputs = ["chg_factor", "chg_principal", *_PROBS]
    ready = models.assemble(s, inputs, "_in")
    with models.cached(ready):
        m = models.fit("lr", LogisticRegression(featuresCol="_in", labelCol="label", maxIter=20), ready, TARGET)
        return explain.root_causes(m.score(ready), "txn_key", "prob", m, inputs, LABELS, 0.7)


@register("permutation_importance")
def permutation_importance(spark, sf):
    cols = ["chg_factor", "chg_principal", "chg_coupon", "l_extendedprice"]
    t = txn(spark, sf, ["txn_key", *cols, TARGET])
    m = models.fit("tree", extract.small_tree(4), models.assemble(t, cols), TARGET)
    return explain.permutation_importance(t, "txn_key", m, cols, TARGET)


@register("partial_dependence")
def partial_dependence(spark, sf):
    cols = ["l_quantity", "l_discount", "l_tax"]
    t = txn(spark, sf, [*cols, TARGET])
    m = models.fit("tree", extract.small_tree(5), models.assemble(t, cols), TARGET)
    return explain.partial_dependence(t, m, cols, "l_quantity", 5)


@register("break_signatures")
def break_signatures(spark, sf):
    t = txn(spark, sf, [*FLAGS, TARGET])
    return explain.break_signatures(models.assemble(t, FLAGS), FLAGS, TARGET, 4)
