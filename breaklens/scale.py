"""Order statistics and running aggregates that never put one group in one task.

A window partitioned by a label, an entity or nothing at all sorts the whole group in one task.
The functions below split every group into ordered buckets, aggregate each bucket, carry the
bucket totals forward (a table of groups x buckets rows) and finish inside the buckets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the integer hash: a Mersenne prime and two multipliers below it.
HASH_PRIME = 2147483647
HASH_MULT_1 = 1327217885
HASH_MULT_2 = 1103515245


def key_hash(key: str, seed: int = 42) -> Column:
    """Integer hash of a non-negative key into [0, HASH_PRIME); portable to plain SQL."""
    k = F.col(key)
    h1 = (k % HASH_PRIME * F.lit(HASH_MULT_1).cast("bigint") + F.lit(seed * 16807)) % HASH_PRIME
    h2 = h1.bitwiseXOR(F.shiftright(h1, 15))
    return h2 % HASH_PRIME * F.lit(HASH_MULT_2).cast("bigint") % HASH_PRIME


def key_hash_sql(key: str, seed: int = 42) -> str:
    """The same hash as SQL text (for engines with xor() and >>)."""
    h1 = f"((({key}) % {HASH_PRIME} * CAST({HASH_MULT_1} AS BIGINT) + {seed * 16807}) % {HASH_PRIME})"
    return f"((xor({h1}, {h1} >> 15) % {HASH_PRIME}) * CAST({HASH_MULT_2} AS BIGINT) % {HASH_PRIME})"


def bucket_count(spark: SparkSession) -> int:
    """Buckets per group: a few per shuffle partition, so that tasks stay even."""
    return max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def hash_bucket(hash_col: str, buckets: int) -> Column:
    """Order-preserving bucket of a uniform hash."""
    return F.floor(F.col(hash_col) * F.lit(buckets).cast("bigint") / F.lit(HASH_PRIME)).cast("int")


#: Histogram rows that reach the driver in one round, whatever the data and the number of open ranges.
HISTOGRAM = 1 << 15


@dataclass
class Run:
    """Rows of a column with low <= value <= high, `before` of them below; all equal if low == high."""

    low: float
    high: float
    before: int
    rows: int


def _ends(df: DataFrame, cols: list[str]) -> dict[str, list[Run]]:
    row = df.agg(*[f(_number(c)).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("n", F.count), ("a", F.min), ("b", F.max))]).first()
    return {c: [Run(row[f"a{i}"], row[f"b{i}"], 0, row[f"n{i}"])] if row[f"n{i}"] else [] for i, c in enumerate(cols)}


def _number(c: str) -> Column:
    """The column as a double; NaN is missing."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _split(df: DataFrame, open_: dict[str, list[Run]]) -> dict[tuple[str, int], list[Run]]:
    """The runs of equal-width bins of every open run, by one grouped count.

    The lowest and the highest value always fall into different bins, so each run becomes shorter.
    """
    bins = max(2, HISTOGRAM // sum(len(runs) for runs in open_.values()))
    cols = list(open_)
    splits = []
    for c in cols:
        edges = sorted({e for r in open_[c] for e in (r.low, math.nextafter(r.high, math.inf))})
        splits.append([-math.inf, *([e for e in edges if math.isfinite(e)] or [0.0]), math.inf])
    inputs = df.select(*[_number(c).alias(f"x{i}") for i, c in enumerate(cols)])
    names = [f"x{i}" for i in range(len(cols))]
    cells = Bucketizer(splitsArray=splits, inputCols=names, outputCols=[f"c{i}" for i in range(len(cols))], handleInvalid="keep").transform(inputs)
    items = []
    for i, c in enumerate(cols):
        at = [next((k for k, r in enumerate(open_[c]) if r.low <= e <= r.high), -1) for e in splits[i][:-1]]
        half = [(r.low / 2, r.high / 2) for r in open_[c]]
        run = F.get(F.lit(at), F.col(f"c{i}").cast("int"))
        low, high = (F.get(F.lit([getattr(r, e) for r in open_[c]]), run) for e in ("low", "high"))
        # halves, since the width of a run may not fit a double
        scale = F.get(F.lit([(bins / (b - a) if b - a > 0 else 0.0) for a, b in half]), run)
        x = F.col(f"x{i}")
        place = F.floor((x / 2 - low / 2) * scale)
        place = F.when(x <= low, 0).when(x >= high, bins - 1).otherwise(F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)))
        items.append(F.when((run >= 0) & (x >= low) & (x <= high), F.struct(F.lit(i).alias("c"), run.alias("run"), place.cast("int").alias("bin"), x.alias("x"))))
    long = cells.select(F.inline(F.array_compact(F.array(*items))))
    counts = long.groupBy("c", "run", "bin").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
    out: dict[tuple[str, int], list[Run]] = {}
    for r in sorted(counts.collect(), key=lambda r: (r["c"], r["run"], r["bin"])):
        runs = out.setdefault((cols[r["c"]], r["run"]), [])
        before = runs[-1].before + runs[-1].rows if runs else open_[cols[r["c"]]][r["run"]].before
        runs.append(Run(r["a"], r["b"], before, r["n"]))
    return out


def value_buckets(df: DataFrame, col: str, buckets: int, out: str = "_bucket") -> DataFrame:
    """Add an order-preserving bucket of a numeric column, of about equal numbers of rows.

    A histogram is counted, and its bins with more rows than a bucket should have are split again until they
    are single values or small enough. The edges (at most `buckets` numbers) only steer the load: results do
    not depend on them. Missing values share a bucket of their own.
    """
    runs = _ends(df, [col])[col]
    size = runs[0].rows / buckets if runs else 0
    while True:
        heavy = [r for r in runs if r.rows > size and r.low < r.high]
        if not heavy:
            break
        parts = _split(df, {col: heavy})
        runs = sorted([r for r in runs if r not in heavy] + [r for part in parts.values() for r in part], key=lambda r: r.before)
    edges = {r.low for last, r in zip(runs, runs[1:]) if int(last.before / size) < int(r.before / size)}
    splits = [-math.inf, *sorted(e for e in edges if math.isfinite(e)), math.inf]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0))
    tagged = df.withColumn("_bucket_in", F.col(col).cast("double"))
    cut = Bucketizer(splits=splits, inputCol="_bucket_in", outputCol="_bucket_raw", handleInvalid="keep")
    return cut.transform(tagged).withColumn(out, F.col("_bucket_raw").cast("int")).drop("_bucket_in", "_bucket_raw")


_COMBINE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
}
_AGG = {"sum": F.sum, "max": F.max}


def prefix_aggregate(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    bucket: str,
    aggs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    group_total: dict[str, str] | None = None,
) -> DataFrame:
    """Running sums / maxima per `by` along `order`, bucket by bucket.

    `bucket` must not decrease along `order`. Each value is name -> ('sum' | 'max', expression).
    `group_total` (output name -> aggregate name) also adds the value over the whole group, which
    the bucket totals give without another scan.
    """
    inputs = df.select("*", *[e.alias(f"_in_{n}") for n, (_, e) in aggs.items()])
    totals = inputs.groupBy(*by, bucket).agg(*[_AGG[k](f"_in_{n}").alias(f"_tot_{n}") for n, (k, _) in aggs.items()])
    before = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in [*by, bucket]],
        *[_AGG[k](f"_tot_{n}").over(before).alias(f"_carry_{n}") for n, (k, _) in aggs.items()],
        *[_AGG[aggs[n][0]](f"_tot_{n}").over(W.partitionBy(*by)).alias(out) for out, n in (group_total or {}).items()],
    )
    inside = W.partitionBy(*by, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = inputs.select(
        *df.columns, *[_AGG[k](f"_in_{n}").over(inside).alias(f"_local_{n}") for n, (k, _) in aggs.items()]
    )
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*by, bucket]])
    return local.join(carry, on).select(
        *df.columns,
        *[_COMBINE[k](F.col(f"_carry_{n}"), F.col(f"_local_{n}")).alias(n) for n, (k, _) in aggs.items()],
        *(group_total or {}),
    )


def global_rank(
    df: DataFrame, by: list[str], order: list[Column], bucket: str, out: str = "_rank", size: str | None = None
) -> DataFrame:
    """Exact 1-based row number per `by` along `order`, and the group size when `size` names a column."""
    one = {out: ("sum", F.lit(1).cast("bigint"))}
    return prefix_aggregate(df, by, order, bucket, one, group_total={size: out} if size else None)


def lookback_blocks(
    df: DataFrame, entity: str, order: list[Column], bucket: str, depth: int, block_rows: int = 50_000
) -> DataFrame:
    """Split each entity into blocks of consecutive rows, each led by copies of its `depth` previous rows.

    Window functions over (entity, _block) that look back at most `depth` rows are then exact;
    drop the rows with `_copy` afterwards.
    """
    if depth > block_rows:
        raise ValueError("depth must not exceed block_rows")
    ranked = global_rank(df, [entity], order, bucket)
    pos = F.col("_rank") - 1
    own = F.floor(pos / block_rows)
    places = F.array(F.struct(own.alias("block"), F.lit(False).alias("copy")))
    tail = F.array(F.struct((own + 1).alias("block"), F.lit(True).alias("copy")))
    target = F.when(pos % block_rows >= block_rows - depth, F.concat(places, tail)).otherwise(places)
    return ranked.withColumn("_place", F.explode(target)).select(
        *df.columns, "_rank", F.col("_place.block").alias("_block"), F.col("_place.copy").alias("_copy")
    )


def block_window(entity: str) -> W:
    return W.partitionBy(entity, "_block").orderBy("_rank")


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles (linear interpolation between order statistics) of numeric columns, by histogram selection.

    Every round counts equal-width bins of the runs that still hold a wanted rank, for all columns in one
    partially aggregated scan, and only bins with a wanted rank are split again, until a bin is a single
    value. No values are gathered, only HISTOGRAM counts a round. Nulls and NaN do not count; a column
    without values has null quantiles.
    """
    ends = _ends(df, cols)
    n = {c: runs[0].rows if runs else 0 for c, runs in ends.items()}
    ranks = {c: sorted({r for p in probs for r in (int(p * (n[c] - 1)), min(int(p * (n[c] - 1)) + 1, n[c] - 1))}) for c in cols if n[c]}
    found: dict[tuple[str, int], float] = {}
    runs = {c: ends[c] for c in ranks}
    while runs:
        open_: dict[str, list[Run]] = {}
        for c in runs:
            for run in runs[c]:
                inside = [r for r in ranks[c] if run.before <= r < run.before + run.rows]
                if run.low == run.high:
                    found |= {(c, r): run.low for r in inside}
                elif inside:
                    open_.setdefault(c, []).append(run)
        runs = {}
        for (c, _), parts in (_split(df, open_) if open_ else {}).items():
            runs.setdefault(c, []).extend(parts)
    out: dict[str, list[float | None]] = {}
    for c in cols:
        out[c] = []
        for p in probs:
            if not n[c]:
                out[c].append(None)
                continue
            pos = p * (n[c] - 1)
            lo, hi = found[(c, int(pos))], found[(c, min(int(pos) + 1, n[c] - 1))]
            out[c].append(float(lo) + (pos - int(pos)) * (float(hi) - float(lo)))
    return out


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when a scan has fewer splits than there are cores (few, small or unsplittable files).

    For plain scans only. At scale a scan has far more splits than cores and the frame is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
