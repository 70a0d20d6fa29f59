"""Models of several targets: independent, shared, stacked, chained, hierarchical, ensembles.

Every stage adds its probability as a column of the same row, so positions never matter and no
join is needed. Out-of-fold probabilities score each row once with the model of its own fold.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breaklens.operators import metrics, models, trees
from breaklens.operators.extratrees import ExtraTrees
from breaklens.operators.models import Fitted, fit
from breaklens.operators.rules import Rule, first_match, tree_rules
from breaklens.session import checkpoint_root, pin

FEATURES = "features"


def _with_features(est, col: str):
    return est.copy({est.getParam("featuresCol"): col})


def _extend(df: DataFrame, extra: list[str], out: str) -> DataFrame:
    return VectorAssembler(inputCols=[FEATURES, *extra], outputCol=out).transform(df) if extra else df.withColumn(out, F.col(FEATURES))


def weighted_ensemble(parts: dict[str, tuple[DataFrame, float]], key: str, out: str = "p_ensemble") -> DataFrame:
    """Weighted mean of the probability column of each frame, joined on the row key."""
    total = sum(w for _, w in parts.values())
    joined = reduce(lambda a, b: a.join(b, key), [df for df, _ in parts.values()])
    return joined.select(
        key, (reduce(lambda a, b: a + b, [F.col(c) * w for c, (_, w) in parts.items()]) / total).alias(out)
    )


# ---- independent and shared models per field ----------------------------------------------------


def train_independent(train: DataFrame, labels: list[str], zoo: dict) -> dict[str, dict[str, Fitted]]:
    """model -> label -> fitted, each label on its own."""
    return {name: {y: fit(name, est, train, y) for y in labels} for name, est in zoo.items()}


def score_labels(df: DataFrame, fitted: dict[str, Fitted]) -> DataFrame:
    for y, m in fitted.items():
        df = m.score(df, f"p_{y}", f"h_{y}")
    return df


def _fit_together(train: DataFrame, asked: list[tuple[str, object, str, int | None]], fold_col: str | None = None, folds: int = 1) -> list[Fitted]:
    """A model for each (name, estimator, target, fold left out). Trees are grown in the same scans; other models are fitted one by one."""
    targets = list(dict.fromkeys(y for _, _, y, _ in asked))
    ests = [est for _, est, _, _ in asked]
    col = ests[0].getFeaturesCol()
    fold = F.col(fold_col) if fold_col else None
    rows = trees.Rows.of(train, vector_to_array(col), trees.categories(train, col), {y: F.col(y) for y in targets}, ests, fold, folds)
    if rows is None:
        return [fit(name, est, train if f is None else train.filter(F.col(fold_col) != f), y) for name, est, y, f in asked]
    asks = [trees.Ask(est, y, tuple(range(rows.width)), f) for _, est, y, f in asked]
    return [Fitted(name, rows.model(a, g)) for (name, _, _, _), a, g in zip(asked, asks, rows.grow(asks))]


def train_shared(train: DataFrame, labels: list[str], zoo: dict[str, list]) -> dict[str, dict[str, Fitted]]:
    """One parameter set for all labels: the candidate with the best share of fully right rows."""
    out = {}
    for name, candidates in zoo.items():
        best = None
        fitted = _fit_together(train, [(name, est, y, None) for est in candidates for y in labels])
        for i in range(len(candidates)):
            group = dict(zip(labels, fitted[i * len(labels) :]))
            if len(candidates) == 1:
                best = (0.0, group)
                break
            scored = score_labels(train, group)
            exact = metrics.multilabel(scored, [(y, f"h_{y}") for y in labels]).first()["exact_match_ratio"]
            if best is None or exact > best[0]:
                best = (exact, group)
        out[name] = best[1]
    return out


def field_results(test: DataFrame, fitted: dict[str, dict[str, Fitted]], approach: str) -> DataFrame:
    """Result registry rows (approach, model, field, metrics) on the test frame."""
    parts = []
    for name, group in fitted.items():
        scored = score_labels(test, group)
        parts.append(metrics.results_long(scored, {(approach, name): {y: (y, f"h_{y}") for y in group}}))
    return reduce(DataFrame.unionByName, parts)


def field_table(scored: DataFrame, labels: list[str], approach: str) -> DataFrame:
    """Field metrics of predictions h_<label>."""
    return metrics.results_long(scored, {(approach, approach): {y: (y, f"h_{y}") for y in labels}})


def importance_matrix(train: DataFrame, targets: list[str], est, names: list[str]) -> DataFrame:
    """Importance of each feature in one model per target, long form."""
    parts = {m.name: models.importances(m, names) for m in _fit_together(train, [(t, est, t, None) for t in targets])}
    return models.importance_frame(train.sparkSession, parts)


# ---- stacks and chains --------------------------------------------------------------------------


def out_of_fold(df: DataFrame, est, target: str, folds: int, fold_col: str, prob: str) -> tuple[DataFrame, Fitted]:
    """Add the probability of the model that did not see the row, and fit the model for new rows.

    The frame is read once: each row passes all fold models and keeps its own fold's answer, which
    costs scoring but no extra scan, union or join.
    """
    *fold_models, whole = _fit_together(df, [(target, est, target, f) for f in (*range(folds), None)], fold_col, folds)
    out = df
    for f, m in enumerate(fold_models):
        out = m.score(out, f"_p{f}", f"_h{f}")
    own = F.coalesce(*[F.when(F.col(fold_col) == f, F.col(f"_p{f}")) for f in range(folds)])
    out = out.withColumn(prob, own).drop(*[f"_{x}{f}" for f in range(folds) for x in "ph"])
    return out, whole


@dataclass
class Chain:
    """Stages that each add P(label) to the features of the next, then the final model."""

    labels: list[str]
    target: str
    stages: list[Fitted]
    inputs: list[list[str]]
    final: Fitted
    final_inputs: list[str] = field(default_factory=list)

    def add_labels(self, df: DataFrame) -> DataFrame:
        for y, m, extra in zip(self.labels, self.stages, self.inputs):
            df = _extend(df, extra, f"_x_{y}")
            df = m.score(df, f"predicted_{y}", f"_h_{y}").drop(f"_x_{y}", f"_h_{y}")
        return df

    def score(self, df: DataFrame, prob: str = "prob", pred: str = "pred") -> DataFrame:
        out = _extend(self.add_labels(df), self.final_inputs, "_x_final")
        return self.final.score(out, prob, pred).drop("_x_final")


def _fit_staged(train, labels, target, est, final_est, folds, fold_col, chained: bool, oof: bool) -> Chain:
    current, stages, inputs, added = train, [], [], []
    for y in labels:
        extra = list(added) if chained else []
        col = f"_x_{y}"
        current = _extend(current, extra, col)
        e = _with_features(est, col)
        prob = f"predicted_{y}"
        if oof:
            current, m = out_of_fold(current, e, y, folds, fold_col, prob)
        else:
            (m,) = _fit_together(current, [(y, e, y, None)])
            current = m.score(current, prob, "_h").drop("_h")
        # a stage's probabilities are written once; later stages read them instead of scoring all earlier ones again
        current = pin(current.drop(col), "stage")
        stages.append(m)
        inputs.append(extra)
        added.append(prob)
    current = _extend(current, added, "_x_final")
    (final,) = _fit_together(current, [(target, _with_features(final_est, "_x_final"), target, None)])
    return Chain(labels, target, stages, inputs, final, added)


def fit_stack(train: DataFrame, labels: list[str], target: str, est, final_est, folds: int, fold_col: str) -> Chain:
    """Label models side by side; their out-of-fold probabilities feed the break model."""
    return _fit_staged(train, labels, target, est, final_est, folds, fold_col, chained=False, oof=True)


def fit_chain(
    train: DataFrame, labels: list[str], target: str, est, final_est, folds: int, fold_col: str, oof: bool = True
) -> Chain:
    """Label models in order, each reading the earlier probabilities; the break model reads all."""
    return _fit_staged(train, labels, target, est, final_est, folds, fold_col, chained=True, oof=oof)


def chain_contributions(spark, chain: Chain, names: list[str]) -> DataFrame:
    """Importance of the added probabilities in the final model."""
    imp = dict(models.importances(chain.final, [*names, *chain.final_inputs]))
    rows = [(y, imp[f"predicted_{y}"]) for y in chain.labels]
    return spark.createDataFrame(rows, "label string, importance double").orderBy(F.desc("importance"), "label")


def chain_rules(spark, chain: Chain, names: list[str], min_samples: int, min_confidence: float) -> list[Rule]:
    """Tree rules of every stage and of the final model."""
    out = []
    for y, m, extra in zip(chain.labels, chain.stages, chain.inputs):
        out += tree_rules(m.model, [*names, *extra], spark, min_samples, min_confidence, y, (0, 1))
    return out + tree_rules(
        chain.final.model, [*names, *chain.final_inputs], spark, min_samples, min_confidence, chain.target, (0, 1)
    )


# ---- hierarchies --------------------------------------------------------------------------------


@dataclass
class Hierarchy:
    """Child models per group, a combiner per group, and the break model on everything."""

    groups: dict[str, list[str]]
    children: dict[str, Fitted]
    combiners: dict[str, Fitted]
    final: Fitted

    def inputs(self) -> list[str]:
        return [f"group_{g}" for g in self.groups] + [f"child_{c}" for cs in self.groups.values() for c in cs]

    def add_groups(self, df: DataFrame) -> DataFrame:
        for c, m in self.children.items():
            df = m.score(df, f"child_{c}", "_h").drop("_h")
        for g, cs in self.groups.items():
            df = VectorAssembler(inputCols=[f"child_{c}" for c in cs], outputCol=f"_g_{g}").transform(df)
            df = self.combiners[g].score(df, f"group_{g}", "_h").drop("_h", f"_g_{g}")
        return df

    def score(self, df: DataFrame, prob: str = "prob", pred: str = "pred") -> DataFrame:
        out = _extend(self.add_groups(df), self.inputs(), "_x_final")
        return self.final.score(out, prob, pred).drop("_x_final")


def fit_hierarchy(train: DataFrame, groups: dict[str, list[str]], target: str, child_est, combiner_est, final_est) -> Hierarchy:
    """A group's target is that any of its children is predicted above one half."""
    children = {c: fit(c, child_est, train, c) for cs in groups.values() for c in cs}
    current = train
    for c, m in children.items():
        current = m.score(current, f"child_{c}", "_h").drop("_h")
    combiners = {}
    for g, cs in groups.items():
        ps = [F.col(f"child_{c}") for c in cs]
        any_high = (F.greatest(*ps) if len(ps) > 1 else ps[0]) > 0.5
        ready = VectorAssembler(inputCols=[f"child_{c}" for c in cs], outputCol=f"_g_{g}").transform(current)
        ready = ready.withColumn("_group_y", any_high.cast("int"))
        combiners[g] = fit(g, _with_features(combiner_est, f"_g_{g}"), ready, "_group_y")
    h = Hierarchy(groups, children, combiners, None)
    ready = _extend(h.add_groups(train), h.inputs(), "_x_final")
    h.final = fit(target, _with_features(final_est, "_x_final"), ready, target)
    return h


@dataclass
class BreakThenFields:
    """The break probability is an input of the field models; two predictors per field are averaged."""

    target: str
    first: Fitted
    classifiers: dict[str, Fitted]
    regressors: dict

    def score(self, df: DataFrame) -> DataFrame:
        out = self.first.score(df, "break_prob", "break_pred")
        out = _extend(out, ["break_prob"], "_x")
        for y, m in self.classifiers.items():
            out = m.score(out, "_pc", "_h").drop("_h")
            out = self.regressors[y].transform(out).withColumn(f"p_{y}", (F.col("_pc") + F.col("prediction")) / 2)
            out = out.withColumn(f"h_{y}", (F.col(f"p_{y}") > 0.5).cast("int")).drop("_pc", "prediction")
        return out.drop("_x")


def fit_break_then_fields(train: DataFrame, labels: list[str], target: str, est, rounds: int) -> BreakThenFields:
    checkpoint_root(train.sparkSession)  # many rounds cut their lineage there
    first = fit(target, est, train, target)
    ready = _extend(first.score(train, "break_prob", "_h").drop("_h"), ["break_prob"], "_x")
    ready = pin(ready.select("_x", *labels), "fields")  # scored once, for every pass of the fits
    classifiers = {y: fit(y, _with_features(est, "_x"), ready, y) for y in labels}
    regressors = {
        y: GBTRegressor(featuresCol="_x", labelCol=y, maxIter=rounds, maxDepth=est.getMaxDepth(), stepSize=est.getStepSize(), seed=models.SEED).fit(ready)
        for y in labels
    }
    return BreakThenFields(target, first, classifiers, regressors)


@dataclass
class Levels:
    """Level 1 predicts the break; level 2 predicts fields from features, P(break) and component scores."""

    first: Fitted
    components: object
    fields: dict[str, Fitted]

    def prepare(self, df: DataFrame) -> DataFrame:
        out = self.components.transform(self.first.score(df, "break_prob", "break_pred"))
        return _extend(out, ["break_prob", "_code"], "_x")

    def score(self, df: DataFrame) -> DataFrame:
        out = self.prepare(df)
        for y, m in self.fields.items():
            out = m.score(out, f"p_{y}", f"h_{y}")
        return out.drop("_x", "_code")


def fit_levels(train: DataFrame, labels: list[str], target: str, components: int = 3) -> Levels:
    first = fit(target, LogisticRegression(labelCol="label", maxIter=20), train, target)
    pca = PCA(k=components, inputCol=FEATURES, outputCol="_code").fit(train)
    levels = Levels(first, pca, {})
    ready = levels.prepare(train)
    levels.fields = {y: fit(y, LogisticRegression(featuresCol="_x", labelCol="label", maxIter=20), ready, y) for y in labels}
    return levels


def architecture_table(test: DataFrame, parts: dict, labels: list[str], target: str) -> DataFrame:
    """Break accuracy and field Hamming loss of each architecture on the same rows."""
    rows = []
    for name, m in parts.items():
        # scored once, for both tables
        scored = pin(m.score(test).select(target, "break_pred", *labels, *[f"h_{y}" for y in labels]), "architecture")
        brk = metrics.with_scores(metrics.confusion(scored, {"b": (target, "break_pred")})).select("accuracy")
        ham = metrics.multilabel(scored, [(y, f"h_{y}") for y in labels]).select("hamming_loss")
        rows.append(
            brk.select(F.lit(name).alias("architecture"), F.col("accuracy").alias("break_accuracy")).withColumn(
                "field_hamming", ham.scalar()
            )
        )
    return reduce(DataFrame.unionByName, rows)


# ---- uncertainty and hybrids --------------------------------------------------------------------


def bootstrap_uncertainty(train: DataFrame, test: DataFrame, key: str, target: str, rounds: int = 100, depth: int = 8) -> DataFrame:
    """Mean and deviation of the probability over bootstrap models, and a confidence per row.

    A round is a randomised tree whose rows count by a Poisson hash of (key, round): the same for any
    partitioning. All rounds grow in the same scans and score in one pass.
    """
    ready = train.withColumn("label", F.col(target).cast("double"))
    model = ExtraTrees(trees=rounds, depth=depth, seed=models.SEED, bootstrapKey=key).fit(ready)
    out = model.with_spread(test, "mean_prob", "std_prob")
    return out.select(key, "mean_prob", "std_prob", (1 / (1 + F.col("std_prob"))).alias("confidence"))


def rule_hybrid(scored: DataFrame, known: list[Rule], pred: str = "pred") -> DataFrame:
    """The first known rule decides; rows without one keep the model's prediction."""
    return scored.select(
        "*",
        first_match(known, lambda r: F.lit(r.name)).alias("rule_name"),
        F.coalesce(first_match(known, lambda r: F.lit(r.prediction)), F.col(pred)).alias("hybrid_pred"),
    )
