"""Preprocessing queries."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from breaklens.operators import dictionary, prep
from breaklens.plans.parts import rounded
from breaklens.plans.registry import TXN, register
from breaklens.session import pin
from breaklens.sources.tables import TXN_COLUMNS, txn

NUM = ["l_quantity", "price_null", "l_discount", "o_totalprice"]
CAT = ["security_type", "currency", "sector_null"]


_KIND = """CASE WHEN typeof(any_value({c})) IN ('BIGINT','INTEGER','DOUBLE','HUGEINT') THEN 'numeric'
    WHEN typeof(any_value({c})) = 'VARCHAR' THEN 'categorical' ELSE 'other' END"""
_TYPES = f"{TXN}, types AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {_KIND.format(c=c)} AS kind, count({c}) AS n_values FROM txn" for c in TXN_COLUMNS
) + ")"


@register("infer_types", f"WITH {_TYPES} SELECT * FROM types")
def infer_types(spark, sf):
    return prep.type_table(txn(spark, sf))


@register(
    "dtype_counts",
    f"WITH {_TYPES} SELECT kind, count(*) AS n_columns, CAST(sum(n_values) AS BIGINT) AS n_values FROM types GROUP BY 1",
)
def dtype_counts(spark, sf):
    kinds = prep.type_table(txn(spark, sf))
    return kinds.groupBy("kind").agg(F.count("*").alias("n_columns"), F.sum("n_values").alias("n_values"))


@register(
    "impute_median",
    f"""WITH {TXN} SELECT txn_key, round(coalesce(price_null, (SELECT median(price_null) FROM txn)), 6) AS price_null,
        l_quantity FROM txn""",
)
def impute_median(spark, sf):
    t = txn(spark, sf, ["txn_key", "price_null", "l_quantity"])
    return prep.fit_median(t, ["price_null", "l_quantity"]).transform(t).withColumn("price_null", F.round("price_null", 6))


@register(
    "impute_mode",
    f"""WITH {TXN}, m AS (SELECT sector_null AS v FROM txn WHERE sector_null IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
        SELECT txn_key, coalesce(sector_null, (SELECT v FROM m)) AS sector_null FROM txn""",
)
def impute_mode(spark, sf):
    t = txn(spark, sf, ["txn_key", "sector_null"])
    return prep.fit_mode(t, ["sector_null"]).transform(t)


_CODED = [*CAT, "security_id"]


@register(
    "label_encode",
    f"""WITH {TXN}, f AS (SELECT txn_key, security_type, currency, coalesce(sector_null, 'MISSING') AS sector_null, security_id FROM txn)
        SELECT txn_key, {', '.join(f'dense_rank() OVER (ORDER BY {c}) - 1 AS {c}_idx' for c in _CODED)} FROM f""",
)
def label_encode(spark, sf):
    """Indexes of categories, also of a column with as many values as there are securities."""
    t = txn(spark, sf, ["txn_key", *_CODED]).withColumn("sector_null", F.coalesce("sector_null", F.lit("MISSING")))
    return dictionary.encode(t, {c: dictionary.fit_dictionary(t, c) for c in _CODED}).drop(*_CODED)


@register(
    "standard_scale",
    f"""WITH {TXN}, s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(o_totalprice) AS mp, stddev_pop(o_totalprice) AS sp FROM txn)
        SELECT txn_key, round((l_quantity-mq)/sq, 6) AS l_quantity_scaled, round((o_totalprice-mp)/sp, 6) AS o_totalprice_scaled FROM txn, s""",
)
def standard_scale(spark, sf):
    t = txn(spark, sf, ["txn_key", "l_quantity", "o_totalprice"])
    out = prep.fit_standard(t, ["l_quantity", "o_totalprice"]).transform(t)
    return rounded(out.drop("l_quantity", "o_totalprice"))


@register(
    "minmax_scale",
    f"""WITH {TXN}, s AS (SELECT min(l_quantity) AS aq, max(l_quantity) AS bq, min(o_totalprice) AS ap, max(o_totalprice) AS bp FROM txn WHERE bucket < 80)
        SELECT txn_key, round((l_quantity-aq)/(bq-aq), 6) AS l_quantity_scaled, round((o_totalprice-ap)/(bp-ap), 6) AS o_totalprice_scaled FROM txn, s""",
)
def minmax_scale(spark, sf):
    t = txn(spark, sf, ["txn_key", "bucket", "l_quantity", "o_totalprice"])
    out = prep.fit_minmax(t.filter("bucket < 80"), ["l_quantity", "o_totalprice"]).transform(t)
    return rounded(out.select("txn_key", "l_quantity_scaled", "o_totalprice_scaled"))


@register(
    "one_hot_drop_first",
    f"""WITH {TXN} SELECT txn_key, CAST(security_type='N' AS INT) AS "security_type_N", CAST(security_type='R' AS INT) AS "security_type_R",
        """
    + ", ".join(
        f"CAST(currency='{v}' AS INT) AS \"currency_{v}\"" for v in ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    )
    + " FROM txn",
)
def one_hot_drop_first(spark, sf):
    t = txn(spark, sf, ["txn_key", "security_type", "currency"])
    return prep.fit_one_hot(t, ["security_type", "currency"]).transform(t).drop("security_type", "currency")


@register(
    "align_columns",
    f"""WITH {TXN} SELECT txn_key, CAST(security_type='N' AS INT) AS "security_type_N", CAST(security_type='R' AS INT) AS "security_type_R"
        FROM txn WHERE bucket >= 80 AND security_type <> 'A'""",
)
def align_columns(spark, sf):
    t = txn(spark, sf, ["txn_key", "bucket", "security_type"])
    train, test = t.filter("bucket < 80"), t.filter("bucket >= 80 AND security_type <> 'A'")
    fitted = prep.fit_one_hot(train, ["security_type"])
    # the test frame alone would drop another first level and lack a column
    own = prep.fit_one_hot(test, ["security_type"])
    seen = own.levels["security_type"]
    dummies = prep.OneHot({"security_type": [seen[0], *seen]}).transform(test)
    return prep.align_columns(dummies, ["txn_key", *fitted.columns()])


_NUM_ROWS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS x FROM txn" for c in NUM)


@register(
    "feature_stats_numeric",
    f"""WITH {TXN} SELECT column_name, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std,
        round(count_if(x IS NULL)/count(*), 4) AS missing_rate FROM ({_NUM_ROWS}) GROUP BY 1""",
)
def feature_stats_numeric(spark, sf):
    return rounded(prep.feature_stats_numeric(txn(spark, sf, NUM), NUM), 4)


_CATEGORIES = ["security_type", "currency", "sector_null", "custodian", "portfolio", "security_id"]
_CATEGORY_ROWS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v FROM txn" for c in _CATEGORIES)
_CATSTAT = f"""{TXN}, cr AS ({_CATEGORY_ROWS}),
    cs AS (SELECT column_name, count(DISTINCT coalesce(v, 'MISSING')) AS vocab_size, round(count_if(v IS NULL)/count(*), 6) AS missing_rate FROM cr GROUP BY 1),
    cc AS (SELECT column_name, coalesce(v, 'MISSING') AS category, count(*) AS n FROM cr GROUP BY ALL)"""


@register(
    "feature_stats_categorical",
    f"""WITH {_CATSTAT} SELECT column_name, category, row_number() OVER (PARTITION BY column_name ORDER BY category) - 1 AS idx, n, vocab_size, missing_rate
        FROM cc JOIN cs USING (column_name)""",
)
def feature_stats_categorical(spark, sf):
    """Categories as rows, with their index and the column's vocabulary."""
    return rounded(dictionary.categories(txn(spark, sf, _CATEGORIES), _CATEGORIES))


@register(
    "embedding_dim_rule",
    f"WITH {_CATSTAT} SELECT column_name, vocab_size, CAST(least(50, (vocab_size+1)//2) AS INT) AS embedding_dim FROM cs",
)
def embedding_dim_rule(spark, sf):
    s = prep.vocabulary_sizes(txn(spark, sf, _CATEGORIES), _CATEGORIES)
    return s.select("column_name", "vocab_size", prep.embedding_dim(F.col("vocab_size")).alias("embedding_dim"))


def _scaled_sql(c: str, where: str) -> str:
    """Median fill, then (x - mean) / population deviation, all fitted on the rows `where`."""
    fill = f"coalesce({c}, (SELECT median({c}) FROM txn WHERE {where}))"
    return f"round(({fill} - (SELECT avg({fill}) FROM txn WHERE {where}))/(SELECT stddev_pop({fill}) FROM txn WHERE {where}), 6) AS {c}_scaled"


def _index_sql(c: str, where: str) -> str:
    v = f"coalesce({c}, 'MISSING')"
    return f"CAST(list_position((SELECT list_sort(list(DISTINCT {v})) FROM txn WHERE {where}), {v}) - 1 AS DOUBLE) AS {c}_idx"


def spread(df, names):
    """Assembled features back in named columns."""
    x = vector_to_array("features")
    return df.select("txn_key", *[F.round(x[i], 6).alias(n) for i, n in enumerate(names)], *[c for c in df.columns if c in _LAB])


_LAB = ["was_exception", "fld_factor", "fld_coupon", "fld_date"]


@register(
    "prepare_inputs",
    f"WITH {TXN} SELECT txn_key, {', '.join(_scaled_sql(c, 'true') for c in NUM)}, "
    + ", ".join(f"CAST({c} IS NULL AS DOUBLE) AS {c}_missing" for c in NUM)
    + f", {', '.join(_index_sql(c, 'true') for c in CAT)}, {', '.join(_LAB)} FROM txn",
)
def prepare_inputs(spark, sf):
    """Model input per row: scaled numerics, missing indicators, category indexes; labels beside it."""
    # joined once: fitting takes many passes
    t = pin(txn(spark, sf, ["txn_key", *NUM, *CAT, *_LAB]), "inputs")
    fitted = prep.fit_inputs(t, NUM, CAT)
    return spread(fitted.transform(t).select("txn_key", "features", *_LAB), fitted.names())


@register(
    "preprocess_stages",
    f"WITH {TXN} SELECT txn_key, {', '.join(_scaled_sql(c, 'bucket < 80') for c in NUM)}, "
    + f"{', '.join(_index_sql(c, 'bucket < 80') for c in CAT)} FROM txn WHERE bucket >= 80",
)
def preprocess_stages(spark, sf):
    """Fitted on the training rows, applied to the test rows."""
    t = pin(txn(spark, sf, ["txn_key", "bucket", *NUM, *CAT]), "inputs")
    fitted = prep.fit_inputs(t.filter("bucket < 80"), NUM, CAT, indicators=False)
    return spread(fitted.transform(t.filter("bucket >= 80")).select("txn_key", "features"), fitted.names())


@register(
    "missing_summary",
    f"""WITH {TXN} SELECT * FROM ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS n_missing FROM txn" for c in TXN_COLUMNS)})
        WHERE n_missing > 0""",
)
def missing_summary(spark, sf):
    return prep.missing_summary(txn(spark, sf), TXN_COLUMNS)


def _bin_sql(c: str) -> str:
    q = f"(SELECT quantile_cont({c}, [0, 1.0/3, 2.0/3, 1]) FROM txn)"
    return f"""CASE WHEN {c} <= {q}[2] THEN printf('{c}_(%.3f, %.3f]', {q}[1], {q}[2])
        WHEN {c} <= {q}[3] THEN printf('{c}_(%.3f, %.3f]', {q}[2], {q}[3]) ELSE printf('{c}_(%.3f, %.3f]', {q}[3], {q}[4]) END"""


@register(
    "qcut_items",
    f"""WITH {TXN} SELECT txn_key, concat_ws('|', {_bin_sql('l_quantity')}, {_bin_sql('l_extendedprice')}, 'security_type=' || security_type) AS items FROM txn""",
)
def qcut_items(spark, sf):
    t = txn(spark, sf, ["txn_key", "l_quantity", "l_extendedprice", "security_type"])
    fitted = prep.fit_qcut(t, ["l_quantity", "l_extendedprice"], 3)
    return prep.qcut_items(t, fitted, ["security_type"]).select("txn_key", F.array_join("items", "|").alias("items"))


_READY = ["l_quantity", "price_null", "sector_null", "security_type"]


@register(
    "readiness_score",
    f"""WITH {TXN}, s AS (SELECT count(*) AS n_rows, ({' + '.join(f'count_if({c} IS NULL)' for c in _READY)})/(count(*)*4.0::DOUBLE) AS missing_share FROM txn),
        l AS (SELECT *, CASE WHEN n_rows >= 100000 THEN 0 WHEN n_rows >= 10000 THEN 1 ELSE 2 END AS a,
               CASE WHEN missing_share < 0.05 THEN 0 WHEN missing_share <= 0.2 THEN 1 ELSE 2 END AS b FROM s)
        SELECT n_rows, round(missing_share, 6) AS missing_share, ['green','yellow','red'][a+1] AS rows_light,
               ['green','yellow','red'][b+1] AS missing_light, ['green','yellow','red'][greatest(a,b)+1] AS readiness FROM l""",
)
def readiness_score(spark, sf):
    return rounded(prep.readiness_score(txn(spark, sf, _READY), _READY))


@register(
    "zscore_anomaly",
    f"""WITH {TXN}, z AS (SELECT txn_key,
          (l_extendedprice - avg(l_extendedprice) OVER w)/stddev_samp(l_extendedprice) OVER w AS a,
          (o_totalprice - avg(o_totalprice) OVER w)/stddev_samp(o_totalprice) OVER w AS b
          FROM txn WINDOW w AS (PARTITION BY security_type))
        SELECT txn_key, round(a, 6) AS l_extendedprice_z, round(b, 6) AS o_totalprice_z, CAST(abs(a) > 2 OR abs(b) > 2 AS INT) AS is_anomaly FROM z""",
)
def zscore_anomaly(spark, sf):
    t = txn(spark, sf, ["txn_key", "security_type", "l_extendedprice", "o_totalprice"])
    out = prep.zscores(t, ["security_type"], ["l_extendedprice", "o_totalprice"], 2.0)
    return rounded(out.select("txn_key", "l_extendedprice_z", "o_totalprice_z", "is_anomaly"))


@register(
    "peer_compare",
    f"""WITH {TXN} SELECT txn_key, round((l_extendedprice - avg(l_extendedprice) OVER w)/stddev_samp(l_extendedprice) OVER w, 6) AS gap_in_deviations,
        round(l_extendedprice/avg(l_extendedprice) OVER w, 6) AS ratio_to_peers FROM txn WINDOW w AS (PARTITION BY custodian, security_type)""",
)
def peer_compare(spark, sf):
    t = txn(spark, sf, ["txn_key", "custodian", "security_type", "l_extendedprice"])
    out = prep.with_peer_stats(t, ["custodian", "security_type"], ["l_extendedprice"])
    x, mean, std = (F.col(f"l_extendedprice{s}") for s in ("", "_peer_mean", "_peer_std"))
    gap, ratio = F.try_divide(x - mean, std), F.try_divide(x, mean)
    return rounded(out.select("txn_key", gap.alias("gap_in_deviations"), ratio.alias("ratio_to_peers")))


@register("encode_reconstruct")
def encode_reconstruct(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice"]
    return prep.encode_reconstruct(txn(spark, sf, ["txn_key", *cols]), "txn_key", cols, 3)
