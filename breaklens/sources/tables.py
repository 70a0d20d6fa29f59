"""Parquet sources and the transaction fixture derived from them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breaklens.scale import block_window, bucket_count, lookback_blocks, spread, value_buckets


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL: turn NaN into NULL in every floating-point column."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


# Columns of the fixture by the table they come from.
_BASE = {
    "txn_key": "((l_orderkey*100000 + l_partkey)*10000 + l_suppkey)*10 + l_linenumber",
    "security_id": "l_partkey",
    "security_type": "l_returnflag",
    "l_quantity": "l_quantity",
    "l_extendedprice": "l_extendedprice",
    "l_discount": "l_discount",
    "l_tax": "l_tax",
    "ts": "l_shipdate",
    "chg_factor": "CAST(l_discount >= 0.08 AS INT)",
    "chg_coupon": "CAST(l_tax >= 0.06 AS INT)",
    "chg_principal": "CAST(l_quantity >= 40 AS INT)",
    "chg_interest": "CAST(l_returnflag = 'R' AS INT)",
    "chg_rating": "CAST(l_linestatus = 'O' AS INT)",
    "n1": "(l_orderkey*7919 + l_partkey*1049 + l_suppkey*31 + l_linenumber*17) % 100",
    "n2": "(l_orderkey*3571 + l_partkey*389  + l_suppkey*97 + l_linenumber*53) % 100",
    "n3": "(l_orderkey*6151 + l_partkey*773  + l_suppkey*13 + l_linenumber*71) % 100",
    "n4": "(l_orderkey*4481 + l_partkey*1877 + l_suppkey*59 + l_linenumber*29) % 100",
}
_ORDERS = {
    "currency": "o_orderpriority",
    "o_totalprice": "o_totalprice",
    "o_orderdate": "o_orderdate",
    "chg_date": "CAST(o_orderpriority IN ('1-URGENT','2-HIGH') AS INT)",
}
_PART = {"portfolio": "p_brand", "sector": "p_type", "p_retailprice": "p_retailprice", "p_size": "p_size"}
_SUPPLIER = {"s_acctbal": "s_acctbal"}
_NATION = {"custodian": "n_name"}
# name -> (expression over the columns above, columns it needs)
_DERIVED = {
    "was_exception": (
        "CAST(n1 < 5 + 20*chg_factor + 10*chg_coupon + 15*chg_principal + 40*chg_factor*chg_principal AS INT)",
        ["n1", "chg_factor", "chg_coupon", "chg_principal"],
    ),
    "fld_factor": ("CAST(n2 < 10 + 35*chg_principal AS INT)", ["n2", "chg_principal"]),
    "fld_coupon": (
        "CAST(n3 < 10 + 40*chg_factor + 20*CAST(n2 < 10 + 35*chg_principal AS INT) AS INT)",
        ["n3", "n2", "chg_factor", "chg_principal"],
    ),
    "fld_date": ("CAST(n4 < 8 + 30*chg_date AS INT)", ["n4", "chg_date"]),
    "price_null": ("CASE WHEN n2 % 7 = 0 THEN NULL ELSE l_extendedprice END", ["n2", "l_extendedprice"]),
    "sector_null": ("CASE WHEN n3 % 9 = 0 THEN NULL ELSE sector END", ["n3", "sector"]),
    "bucket": ("(n3*3 + n4) % 100", ["n3", "n4"]),
    "fold": ("(n3*3 + n4) % 5", ["n3", "n4"]),
}
TXN_COLUMNS = [*_BASE, *_ORDERS, *_PART, *_SUPPLIER, *_NATION, *_DERIVED]


def txn(
    spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None, heavy: bool = False
) -> DataFrame:
    """One row per transaction: features, change flags, break label and field labels.

    Only the look-up tables that the asked columns come from are joined: every line item has its
    order, part, supplier and nation (`orphan_keys` counts exceptions to that), so an unused inner
    join would only add a shuffle of the fact table. Without `columns` all joins are made. `heavy` is for
    work that costs much more than the scan (model fits): it spreads a small scan over all cores.
    """
    wanted = list(columns) if columns is not None else TXN_COLUMNS
    needed = set(wanted)
    for c in wanted:
        if c in _DERIVED:
            needed.update(_DERIVED[c][1])
    df = table(spark, sf_dir, "lineitem")
    if heavy:
        df = spread(df)
    exprs = dict(_BASE)
    if needed & set(_ORDERS):
        df = df.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        exprs |= _ORDERS
    if needed & set(_PART):
        df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        exprs |= _PART
    if needed & (set(_SUPPLIER) | set(_NATION)):
        df = df.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        exprs |= _SUPPLIER
    if needed & set(_NATION):
        df = df.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        exprs |= _NATION
    df = df.select(*[F.expr(e).alias(c) for c, e in exprs.items() if c in needed])
    return df.select(*[F.expr(_DERIVED[c][0]).alias(c) if c in _DERIVED else F.col(c) for c in wanted])


def orphan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items without a partner in each look-up table (the assumption behind join pruning)."""
    li = table(spark, sf_dir, "lineitem")
    checks = [
        ("orders", "l_orderkey", "o_orderkey"),
        ("part", "l_partkey", "p_partkey"),
        ("supplier", "l_suppkey", "s_suppkey"),
    ]
    parts = [
        li.join(table(spark, sf_dir, t), F.col(fk) == F.col(pk), "left_anti").agg(
            F.lit(f"{t}_without_partner").alias("check_name"), F.count("*").alias("n_rows")
        )
        for t, fk, pk in checks
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, predictions and a score with many ties, for the metric operators."""
    t = txn(spark, sf_dir, ["txn_key", "was_exception", "fld_factor", "fld_coupon", "fld_date", "n2", "n3", "n4"])
    return t.selectExpr(
        "txn_key",
        "was_exception AS y",
        "fld_factor",
        "fld_coupon",
        "fld_date",
        "CASE WHEN n4 % 10 = 0 THEN 1 - was_exception ELSE was_exception END AS yhat",
        "CASE WHEN n3 % 10 = 0 THEN 1 - fld_factor ELSE fld_factor END AS pred_factor",
        "CASE WHEN n4 % 10 = 1 THEN 1 - fld_coupon ELSE fld_coupon END AS pred_coupon",
        "CASE WHEN n2 % 10 = 2 THEN 1 - fld_date ELSE fld_date END AS pred_date",
        "CAST(0.3 AS DOUBLE)*was_exception + CAST(0.7 AS DOUBLE)*n4/CAST(100.0 AS DOUBLE) AS p",
    )


def txn_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = txn(spark, sf_dir, ["txn_key", "n1", "currency", "portfolio", "security_type", "sector"])
    return t.selectExpr(
        "txn_key",
        """CASE WHEN n1 % 11 = 0 THEN NULL WHEN n1 % 11 = 1 THEN ''
             WHEN n1 % 3 = 0 THEN concat('c-tx per ', lower(currency), ', ', portfolio)
             WHEN n1 % 3 = 1 THEN concat(portfolio, ' ,, ', security_type)
             ELSE concat(' ', security_type, ',', sector, ' ') END AS text_field""",
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("user_id").alias("entity"),
        "event_type",
        "value",
    )


def event_blocks(spark: SparkSession, sf_dir: str, depth: int = 1) -> DataFrame:
    """Events of each entity in time order, in even blocks that can look back `depth` rows."""
    e = value_buckets(raw_events(spark, sf_dir), "us", bucket_count(spark))
    return lookback_blocks(e, "entity", [F.col("us"), F.col("event_id")], "_bucket", depth).drop("_bucket")


def with_type_change(blocks: DataFrame) -> DataFrame:
    """chg_type: the event type differs from the entity's previous one (0 for the first event)."""
    prev = F.lag("event_type").over(block_window("entity"))
    return blocks.select(
        "*",
        F.when(prev != F.col("event_type"), 1).otherwise(0).alias("chg_type"),
        (F.col("event_type") == "error").cast("int").alias("was_exception"),
    )


def txn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = with_type_change(event_blocks(spark, sf_dir, depth=1))
    return blocks.filter(~F.col("_copy")).drop("_rank", "_block", "_copy")
