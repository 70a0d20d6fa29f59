"""Preprocessing. Fitting aggregates the data to a few numbers; transforming is a projection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breaklens.functions.rows import fill_missing_category, missing_indicators
from breaklens.scale import exact_quantiles
from breaklens.session import pin
from breaklens.spec import infer_types


@dataclass
class Fills:
    """Value per column that replaces NULL."""

    values: dict

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.values.items() if v is not None})


def fit_median(df: DataFrame, cols: list[str]) -> Fills:
    """Exact medians."""
    return Fills({c: q[0] for c, q in exact_quantiles(df, cols, [0.5]).items()})


def fit_mode(df: DataFrame, cols: list[str]) -> Fills:
    """Most frequent value, the smallest among equals; counted per value, not in one buffer."""
    out = {}
    for c in cols:
        top = df.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()
        out[c] = top[c] if top else None
    return Fills(out)


@dataclass
class Scaler:
    """(x - shift) / scale per column."""

    params: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame, suffix: str = "_scaled") -> DataFrame:
        return df.withColumns({f"{c}{suffix}": (F.col(c) - F.lit(a)) / F.lit(b) for c, (a, b) in self.params.items()})


def fit_standard(df: DataFrame, cols: list[str]) -> Scaler:
    """Mean and population deviation; a constant column is divided by 1."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return Scaler({c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in cols if row[f"m_{c}"] is not None})


def fit_minmax(df: DataFrame, cols: list[str]) -> Scaler:
    row = df.agg(*[F.min(c).alias(f"a_{c}") for c in cols], *[F.max(c).alias(f"b_{c}") for c in cols]).first()
    return Scaler(
        {c: (float(row[f"a_{c}"]), float(row[f"b_{c}"] - row[f"a_{c}"]) or 1.0) for c in cols if row[f"a_{c}"] is not None}
    )


def fit_label_encoder(df: DataFrame, cols: list[str], unseen: str = "error") -> StringIndexerModel:
    """Index of each category in sorted order, as a model on the driver; for many categories see operators.dictionary.

    Unseen values raise, or get the last index with 'keep'.
    """
    return StringIndexer(
        inputCols=cols,
        outputCols=[f"{c}_idx" for c in cols],
        stringOrderType="alphabetAsc",
        handleInvalid=unseen,
    ).fit(df)


@dataclass
class OneHot:
    """Dummy columns per level, the first sorted level left out; NULL gives all zeros."""

    levels: dict[str, list[str]]

    def columns(self) -> list[str]:
        return [f"{c}_{v}" for c, vs in self.levels.items() for v in vs[1:]]

    def transform(self, df: DataFrame) -> DataFrame:
        cols = [
            F.coalesce(F.col(c) == v, F.lit(False)).cast("int").alias(f"{c}_{v}")
            for c, vs in self.levels.items()
            for v in vs[1:]
        ]
        return df.select("*", *cols)


def fit_one_hot(df: DataFrame, cols: list[str]) -> OneHot:
    """Levels become columns, so their number is bounded by the width of the output schema."""
    return OneHot({c: sorted(r[0] for r in df.select(c).dropna().distinct().collect()) for c in cols})


def align_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly the given columns: absent ones are 0, others are dropped."""
    have = set(df.columns)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) if c in have else F.lit(0).alias(c) for c in columns])


def stack_columns(df: DataFrame, aggs: dict[str, list[Column]], names: list[str]) -> DataFrame:
    """One-row aggregate reshaped to one row per column: aggs maps column -> expressions named `names`."""
    wide = df.agg(*[e.alias(f"{c}__{n}") for c, es in aggs.items() for n, e in zip(names, es)])
    items = [
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{c}__{n}`").alias(n) for n in names]) for c in aggs
    ]
    return wide.select(F.inline(F.array(*items)))


def feature_stats_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean, sample deviation and share of missing values per numeric column."""
    aggs = {
        c: [
            F.avg(F.col(c).cast("double")),
            F.stddev(F.col(c).cast("double")),
            F.count_if(F.isnull(c)) / F.count("*").cast("double"),
        ]
        for c in cols
    }
    return stack_columns(df, aggs, ["mean", "std", "missing_rate"])


def vocabulary_sizes(df: DataFrame, cols: list[str], missing: str = "MISSING") -> DataFrame:
    """Number of categories per column, missing values being one of them."""
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("value")) for c in cols])
    return df.select(F.inline(items)).distinct().groupBy("column_name").agg(F.count("*").alias("vocab_size"))


def embedding_dim(vocab: Column) -> Column:
    return F.least(F.lit(50), F.floor((vocab + 1) / 2)).cast("int")


def missing_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null count per column, only columns with nulls, most first."""
    out = stack_columns(df, {c: [F.count_if(F.isnull(c))] for c in cols}, ["n_missing"])
    return out.filter("n_missing > 0").orderBy(F.desc("n_missing"), "column_name")


def type_table(df: DataFrame) -> DataFrame:
    """Inferred kind and number of values of each column."""
    kinds = infer_types(df)
    out = stack_columns(df, {c: [F.lit(k), F.count(c)] for c, k in kinds.items()}, ["kind", "n_values"])
    return out


@dataclass
class Quantiler:
    """Bin edges per numeric column, turned into items."""

    edges: dict[str, list[float]]

    def bins(self, c: str) -> list[tuple[str, Column]]:
        """(item, membership) of each right-closed bin; the lowest value belongs to the first bin."""
        e = self.edges[c]
        out = []
        for i, (lo, hi) in enumerate(zip(e[:-1], e[1:])):
            x = F.col(c)
            inside = (x >= lo) & (x <= hi) if i == 0 else (x > lo) & (x <= hi)
            out.append((f"{c}_({lo:.3f}, {hi:.3f}]", inside))
        return out


def fit_qcut(df: DataFrame, cols: list[str], n_bins: int = 3) -> Quantiler:
    """Exact quantile edges, duplicates dropped."""
    q = exact_quantiles(df, cols, [i / n_bins for i in range(n_bins + 1)])
    return Quantiler({c: sorted(set(v for v in e if v is not None)) for c, e in q.items()})


def qcut_items(df: DataFrame, fitted: Quantiler, categorical: list[str], out: str = "items") -> DataFrame:
    """Item array per row: the bin of each numeric column and 'name=value' of each category."""
    parts = [F.when(cond, F.lit(item)) for c in fitted.edges for item, cond in fitted.bins(c)]
    parts += [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in categorical]
    return df.withColumn(out, F.array_compact(F.array(*parts)))


_LIGHT = ["green", "yellow", "red"]


def readiness_score(df: DataFrame, cols: list[str]) -> DataFrame:
    """Traffic light by row count and by share of missing values; the worse one counts."""
    nulls = reduce(lambda a, b: a + b, [F.isnull(c).cast("bigint") for c in cols])
    base = df.agg(F.count("*").alias("n_rows"), (F.sum(nulls) / (F.count("*") * float(len(cols)))).alias("missing_share"))
    by_rows = F.when(F.col("n_rows") >= 100_000, 0).when(F.col("n_rows") >= 10_000, 1).otherwise(2)
    by_missing = F.when(F.col("missing_share") < 0.05, 0).when(F.col("missing_share") <= 0.20, 1).otherwise(2)
    lights = F.array(*[F.lit(x) for x in _LIGHT])
    return base.select(
        "n_rows",
        "missing_share",
        F.get(lights, by_rows).alias("rows_light"),
        F.get(lights, by_missing).alias("missing_light"),
        F.get(lights, F.greatest(by_rows, by_missing)).alias("readiness"),
    )


def with_peer_stats(df: DataFrame, peers: list[str], cols: list[str]) -> DataFrame:
    """Add mean and sample deviation of the row's peer group.

    Aggregate and join instead of a window over the group: a peer group may be a third of the data,
    and partial aggregation never moves its rows.
    """
    stats = df.groupBy(*peers).agg(
        *[F.avg(c).alias(f"{c}_peer_mean") for c in cols], *[F.stddev(c).alias(f"{c}_peer_std") for c in cols]
    )
    return df.join(stats, peers)


def zscores(df: DataFrame, peers: list[str], cols: list[str], limit: float = 3.0) -> DataFrame:
    """z-score per column within the peer group, and a flag when any exceeds the limit."""
    with_stats = with_peer_stats(df, peers, cols)
    z = {f"{c}_z": F.try_divide(F.col(c) - F.col(f"{c}_peer_mean"), F.col(f"{c}_peer_std")) for c in cols}
    out = with_stats.withColumns(z)
    flag = reduce(lambda a, b: a | b, [F.coalesce(F.abs(F.col(k)) > limit, F.lit(False)) for k in z])
    return out.select(*df.columns, *z, flag.cast("int").alias("is_anomaly"))


@dataclass
class Inputs:
    """Fitted preparation of model inputs."""

    numeric: list[str]
    categorical: list[str]
    passthrough: list[str]
    indicators: bool
    fills: Fills
    scaler: Scaler
    stages: PipelineModel

    def names(self) -> list[str]:
        extra = [f"{c}_missing" for c in self.numeric] if self.indicators else []
        return [f"{c}_scaled" for c in self.numeric] + extra + [f"{c}_idx" for c in self.categorical] + self.passthrough

    def transform(self, df: DataFrame) -> DataFrame:
        out = missing_indicators(df, self.numeric) if self.indicators else df
        out = self.scaler.transform(self.fills.transform(out))
        out = out.withColumns({c: fill_missing_category(c) for c in self.categorical}) if self.categorical else out
        return self.stages.transform(out)


def fit_inputs(
    train: DataFrame,
    numeric: list[str],
    categorical: list[str],
    passthrough: list[str] | None = None,
    indicators: bool = True,
    features: str = "features",
) -> Inputs:
    """Impute and scale numerics, index categories, assemble; fitted on the training rows only."""
    passthrough = passthrough or []
    fills = fit_median(train, numeric)
    filled = fills.transform(train)
    scaler = fit_standard(filled, numeric)
    filled = filled.withColumns({c: fill_missing_category(c) for c in categorical}) if categorical else filled
    index = [
        StringIndexer(
            inputCols=categorical,
            outputCols=[f"{c}_idx" for c in categorical],
            stringOrderType="alphabetAsc",
            handleInvalid="keep",
        )
    ] if categorical else []
    empty = PipelineModel([])
    spec = Inputs(numeric, categorical, passthrough, indicators, fills, scaler, empty)
    assembler = VectorAssembler(inputCols=spec.names(), outputCol=features)
    spec.stages = PipelineModel([*Pipeline(stages=index).fit(filled).stages, assembler])
    return spec


def encode_reconstruct(df: DataFrame, key: str, cols: list[str], k: int = 3, cut: float = 0.99) -> DataFrame:
    """Compress scaled columns to k components, rebuild them; the squared error is the anomaly score.

    The rows are read many times (medians, scales, components, the cut), so they are written once.
    """
    df = pin(df.select(key, *cols), "reconstruct")
    inputs = fit_inputs(df, cols, [], indicators=False)
    ready = inputs.transform(df).select(key, "features")
    model = PCA(k=k, inputCol="features", outputCol="code").fit(ready)
    loads = model.pc.toArray()
    coded = model.transform(ready).select(
        key, vector_to_array("features").alias("x"), vector_to_array("code").alias("code")
    )
    error = reduce(
        lambda a, b: a + b,
        [
            F.pow(
                F.col("x")[j] - reduce(lambda a, b: a + b, [F.lit(float(loads[j][i])) * F.col("code")[i] for i in range(k)]),
                F.lit(2.0),
            )
            for j in range(len(cols))
        ],
    )
    scored = coded.select(key, error.alias("error"))
    limit = exact_quantiles(scored, ["error"], [cut])["error"][0]
    return scored.withColumn("is_anomaly", (F.col("error") > limit).cast("int"))
