"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that may use them). The token capacity
of every pattern is routed to the source quotas, where the second and third repetition of a token cost
more than the first (a convex cost). What flows from a pattern to a source is then filled with documents
in seeded order: whole repetitions first, then documents until the rest is reached.

Only patterns and sources reach the driver: rows of (pattern, tokens), as many as the configuration of the
mixture has combinations of sources, never documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breaklens.llm import text as T
from breaklens.scale import prefix_aggregate
from breaklens.session import pin

REPEATS = 3  # a token is used this often at most
COSTS = (0, 1, 3)  # of the first, second and third use
SEED = 42


def shared_targets(weights: dict, sizes: dict, total: float, most: float = REPEATS) -> dict:
    """Targets that share `total` by weight, stop at `most` times a source's size, and reshare the excess."""
    targets, free, left = {}, dict(weights), float(total)
    while free:
        unit = left / sum(free.values())
        full = [s for s, w in free.items() if w * unit > most * sizes[s]]
        if not full:
            targets.update({s: w * unit for s, w in free.items()})
            break
        for s in full:
            targets[s] = float(most * sizes[s])
            left -= targets[s]
            del free[s]
    return targets


def min_cost_flow(arcs: list[tuple[int, int, int, int]], start: int, end: int) -> list[int]:
    """Flow on every arc (from, to, capacity, cost) of a cheapest largest flow; costs are not negative.

    Shortest augmenting paths with node potentials; whole bottlenecks are sent at a time.
    """
    heads: dict[int, list[int]] = {start: [], end: []}
    to, room, cost = [], [], []
    for a, b, c, w in arcs:
        for x, y, r, k in ((a, b, c, w), (b, a, 0, -w)):
            heads.setdefault(x, []).append(len(to))
            to.append(y)
            room.append(r)
            cost.append(k)
    potential = dict.fromkeys(heads, 0)
    while True:
        distance, via, queue = {start: 0}, {}, [(0, start)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > distance[x]:
                continue
            for e in heads[x]:
                y = to[e]
                nd = d + cost[e] + potential[x] - potential[y]
                if room[e] and nd < distance.get(y, nd + 1):
                    distance[y], via[y] = nd, e
                    heapq.heappush(queue, (nd, y))
        if end not in distance:
            return [arcs[k][2] - room[2 * k] for k in range(len(arcs))]
        for x, d in distance.items():
            potential[x] += d
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = to[via[x] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount


def route(capacity: dict[tuple, int], quotas: dict, costs: tuple[int, ...] = COSTS) -> dict[tuple, dict]:
    """Tokens that each pattern gives to each of its sources. A pattern's use is at most len(costs) times its tokens."""
    patterns, sources = list(capacity), list(quotas)
    node = {("p", p): 2 + i for i, p in enumerate(patterns)} | {("s", s): 2 + len(patterns) + i for i, s in enumerate(sources)}
    arcs = [(0, node["p", p], capacity[p], c) for p in patterns for c in costs]
    arcs += [(node["s", s], 1, int(round(quotas[s])), 0) for s in sources]
    links = [(p, s) for p in patterns for s in p if s in quotas]
    base = len(arcs)
    arcs += [(node["p", p], node["s", s], len(costs) * capacity[p], 0) for p, s in links]
    flow = min_cost_flow(arcs, 0, 1)
    out: dict[tuple, dict] = {p: {} for p in patterns}
    for (p, s), f in zip(links, flow[base:]):
        out[p][s] = f
    return out


def word_sizes(docs: DataFrame, id_col: str, member_col: str, text_col: str) -> DataFrame:
    """(id, members, size in words) of every row; null texts have size 0."""

    def measure(batches):
        for batch in batches:
            for first, data, offsets in T.blocks(batch.column(2), T.SMALL_BLOCK):
                part = batch.slice(first, len(offsets) - 1)
                size = np.diff(T.word_spans(data, offsets)[2])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size, pa.int64())], names=["_id", "_members", "_size"])

    base = docs.select(F.col(id_col).alias("_id"), F.col(member_col).alias("_members"), F.col(text_col).cast("string").alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    return base.mapInArrow(measure, f"_id {kinds['_id']}, _members {kinds['_members']}, _size bigint")


def _plan(spark: SparkSession, flows: dict[tuple, dict]) -> DataFrame:
    """(_pattern, _source, _from, _to): what every source (spelled out) gets of a pattern, as intervals of its tokens."""
    rows = []
    for p, by_source in flows.items():
        at = 0
        for s, f in by_source.items():
            if f:
                rows.append((list(p), "n" if s is None else f"s{s}", int(at), int(at + f)))
                at += f
    plan = spark.createDataFrame(rows, "_pattern array<string>, _source string, _from bigint, _to bigint")
    return plan.withColumn("_pattern", F.concat_ws("\x01", F.transform("_pattern", _spelled)))


def select_mix(sized: DataFrame, flows: dict[tuple, dict]) -> DataFrame:
    """(_id, _members, _size, source, uses) of the rows of `sized` (_id, _members, _size): how often each source takes them.

    The uses of a pattern's documents lie on a line: all first uses in seeded order, then all second ones, and
    so on. Every source gets an interval as long as its flow, and takes the uses that lie inside. What is then
    missing, less than two documents, is filled from the source's largest pattern with the largest use that
    fits, until none fits, and at last with the smallest one where that brings the sum nearer; one row per source
    and round reaches the driver. Documents without words are not taken; rows that repeat an id are rows of
    their own. Rows that no source takes have a null source and no uses.
    """
    spark = sized.sparkSession
    plan = _plan(spark, flows)
    draw = F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(1 << 40))
    marked = sized.withColumn("_draw", draw).withColumn("_part", F.shiftright("_draw", 28).cast("int"))
    marked = marked.withColumn("_pattern", F.concat_ws("\x01", F.transform("_members", _spelled))).withColumn("_row", F.monotonically_increasing_id())
    marked = pin(marked, "mix-rows")
    order = [F.col("_draw"), F.col("_id"), F.col("_size"), F.col("_row")]
    placed = prefix_aggregate(marked, ["_pattern"], order, "_part", {"_end": ("sum", F.col("_size"))}, group_total={"_total": "_end"})
    uses = placed.where("_size > 0").withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    end = F.col("_turn") * F.col("_total") + F.col("_end")
    inside = uses.withColumn("_stop", end).join(plan, "_pattern").where("_stop - _size >= _from AND _stop <= _to")
    taken = pin(inside.groupBy("_row", "_source").agg(F.count("*").alias("uses")), "mix-uses")

    sizes = marked.where("_size > 0").select("_row", "_pattern", "_size", "_draw")
    used = taken.groupBy("_row").agg(F.sum("uses").alias("_used"))
    spare = sizes.join(used, "_row", "left").select("*", (REPEATS - F.coalesce("_used", F.lit(0))).alias("_left")).where("_left > 0")
    spare = pin(spare.drop("_used"), "mix-spare")
    got = taken.join(sizes, "_row").groupBy("_source").agg(F.sum(F.col("uses") * F.col("_size")).alias("_got"))
    # one row per source; the source fills up from the pattern it has most of
    most = F.max_by("_pattern", F.struct(F.col("_to") - F.col("_from"), "_pattern")).alias("_pattern")
    wanted = plan.groupBy("_source").agg(F.sum(F.col("_to") - F.col("_from")).alias("_wanted"), most).join(got, "_source", "left")
    missing = {r["_source"]: [r["_wanted"] - (r["_got"] or 0), r["_pattern"]] for r in wanted.collect()}
    picks: dict[tuple[int, str], int] = {}
    while chosen := _offers(spare, missing, picks, F.col("_size") <= F.col("_gap"), F.max):
        for source, row, size in chosen:
            missing[source][0] -= size
            picks[row, source] = picks.get((row, source), 0) + 1
    for source, row, _ in _offers(spare, missing, picks, F.col("_size") < 2 * F.col("_gap"), F.min):
        picks[row, source] = picks.get((row, source), 0) + 1
    extra = spark.createDataFrame([(r, s, n) for (r, s), n in picks.items()], "_row bigint, _source string, uses bigint")
    taken = taken.union(extra).groupBy("_row", "_source").agg(F.sum("uses").alias("uses"))
    out = marked.join(taken, "_row", "left")
    return out.select("_row", "_id", "_members", "_size", F.when(F.col("_source") != "n", F.substr("_source", F.lit(2))).alias("source"), F.coalesce("uses", F.lit(0)).alias("uses"))


def _offers(spare: DataFrame, missing: dict, picks: dict, fits: Column, best: Callable) -> list[tuple[str, int, int]]:
    """(source, row, size): for every source that misses words the largest or smallest use that fits, no use twice."""
    spark = spare.sparkSession
    gaps = spark.createDataFrame([(s, p, int(g)) for s, (g, p) in missing.items() if g > 0], "_source string, _pattern string, _gap bigint")
    count: dict[int, int] = {}
    for (row, _), n in picks.items():
        count[row] = count.get(row, 0) + n
    gone = spark.createDataFrame(list(count.items()), "_row bigint, _picked bigint")
    left = spare.join(gone, "_row", "left").where("_left > coalesce(_picked, 0)").join(gaps, "_pattern").where(fits)
    found = left.groupBy("_source").agg(best(F.struct("_size", "_draw", "_row")).alias("b"), F.first("_gap").alias("gap"))
    out, seen = [], set()
    for r in sorted(found.collect(), key=lambda r: (-r["gap"], r["_source"])):  # one row per source
        if r["b"]["_row"] not in seen:
            seen.add(r["b"]["_row"])
            out.append((r["_source"], r["b"]["_row"], r["b"]["_size"]))
    return out


def _spelled(x):
    """A null member must differ from every string."""
    return F.when(x.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), x))


def source_plan(sized: DataFrame) -> tuple[dict, dict]:
    """Sizes and targets of the sources of single-source rows: weights 1, 2, 3 repeating by code point, null last."""
    rows = sized.groupBy(F.col("_members")[0].alias("s")).agg(F.sum("_size").alias("n")).collect()
    sizes = {r["s"]: int(r["n"]) for r in rows}
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: 1 + i % 3 for i, s in enumerate(ranked)}
    return sizes, shared_targets(weights, sizes, sum(sizes.values())) if sizes else {}


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, size, source_size, target, taken for every row of single-source documents.

    Null sources are one source, the last; null and empty texts have size 0 and take nothing.
    """
    one = docs.select(F.col(id_col).alias("_id"), F.array(F.col(source_col).cast("string")).alias("_m"), F.col(text_col).alias("_t"))
    sized = pin(word_sizes(one, "_id", "_m", "_t"), "mix-sizes")
    sizes, targets = source_plan(sized)
    flows = route({(s,): n for s, n in sizes.items()}, targets)
    chosen = select_mix(sized, flows)
    schema = "_spelled string, _source_size bigint, _target double"
    facts = [("n" if s is None else f"s{s}", sizes[s], float(targets[s])) for s in sizes]
    facts = sized.sparkSession.createDataFrame(facts, schema)
    out = chosen.withColumn("_spelled", _spelled(F.col("_members")[0])).join(facts, "_spelled")
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("uses") * F.col("_size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns.

    Rows that repeat an id are taken as often as the most used of them. Documents without words are not taken.
    """
    one = docs.select(F.col(id_col).alias("_id"), F.array(F.col(source_col).cast("string")).alias("_m"), F.col(text_col).alias("_t"))
    sized = pin(word_sizes(one, "_id", "_m", "_t"), "mix-sizes")
    sizes, targets = source_plan(sized)
    flows = route({(s,): n for s, n in sizes.items()}, targets)
    taken = select_mix(sized, flows).where("_size > 0 AND uses > 0").groupBy(F.col("_id").alias("__mix_id"))
    again = docs.join(taken.agg(F.max("uses").alias("__mix_uses")), F.col(id_col).eqNullSafe(F.col("__mix_id")))
    return again.withColumn("__mix_use", F.explode(F.sequence(F.lit(1), F.col("__mix_uses")))).select(*docs.columns)
