"""WARC records and a Merkle fixity audit of their replicas.

Records are hashed, ordered by their offset and summed up into a tree: a node is the hash of up to FANOUT
neighbouring children with their offset ranges. Two replicas with equal roots are equal; else only the
children of differing nodes are compared, level by level, down to the damaged records.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breaklens.scale import prefix_aggregate, value_buckets
from breaklens.session import pin

FANOUT = 64


def record_bytes(url: Column, body: Column, record_id: Column) -> Column:
    """A WARC/1.0 resource record; a null body is empty and a null url is an empty target."""
    payload = F.encode(F.coalesce(body, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), payload, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(_id, record) of every row."""
    record = record_bytes(F.col(url_col), F.col(body_col), F.col(id_col))
    return pages.select(F.col(id_col).alias("_id"), record.alias("record"))


def leaves(records: DataFrame) -> DataFrame:
    """(_id, pos, start, length, digest) of the records in id order: position, byte offset, bytes and SHA-256.

    Null ids come first; equal ids stand in the order of their digests.
    """
    hashed = records.select("_id", F.octet_length("record").cast("bigint").alias("length"), F.sha2("record", 256).alias("digest"))
    hashed = pin(hashed, "warc-records").withColumn("_order", F.coalesce(F.col("_id").cast("double"), F.lit(-sys.float_info.max)))
    buckets = max(8, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = value_buckets(hashed, "_order", buckets)
    order = [F.asc_nulls_first("_id"), F.col("digest"), F.col("length")]
    whole = cut.withColumn("_all", F.lit(0))
    sums = {"_end": ("sum", F.col("length")), "_n": ("sum", F.lit(1).cast("bigint"))}
    run = prefix_aggregate(whole, ["_all"], order, "_bucket", sums)
    return run.select("_id", (F.col("_n") - 1).alias("pos"), (F.col("_end") - F.col("length")).alias("start"), "length", "digest")


def _parents(level: DataFrame) -> DataFrame:
    child = F.struct("pos", F.concat_ws(":", F.col("start"), F.col("length"), F.col("digest")).alias("text"))
    made = level.groupBy(F.floor(F.col("pos") / FANOUT).alias("up")).agg(
        F.sort_array(F.collect_list(child)).alias("children"),  # at most FANOUT
        F.min("start").alias("start"),
        F.sum("length").alias("length"),
    )
    digest = F.sha2(F.concat_ws("\n", F.col("children.text")), 256)
    return made.select(F.col("up").alias("pos"), "start", "length", digest.alias("digest"))


def tree(bottom: DataFrame) -> list[DataFrame]:
    """Levels from the leaves to the root; no records give one empty level."""
    levels = [bottom]
    n = bottom.agg(F.max("pos")).first()[0]
    while n:
        levels.append(pin(_parents(levels[-1]), "warc-level"))
        n //= FANOUT
    return levels


def damaged(one: list[DataFrame], two: list[DataFrame]) -> DataFrame:
    """(pos) of the leaves that differ. Trees of unequal height are compared from the lower one's root on."""
    height = min(len(one), len(two))
    suspects = None
    for level in reversed(range(height)):
        a, b = (t[level].select("pos", F.struct("start", "length", "digest").alias(s)) for t, s in ((one, "a"), (two, "b")))
        if suspects is not None:
            up = F.floor(F.col("pos") / FANOUT)
            a, b = (x.withColumn("up", up).join(suspects.withColumnRenamed("pos", "up"), "up", "left_semi").drop("up") for x in (a, b))
        suspects = a.join(b, "pos", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("pos")
        if level:
            suspects = pin(suspects, "warc-suspects")
            if suspects.isEmpty():
                break
    return suspects


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """(_id, start, length, sha256, intact) of every record of the first replica, and of extra ones of the second."""
    one, two = pin(leaves(first), "warc-leaves"), pin(leaves(second), "warc-leaves")
    bad = damaged(tree(one), tree(two)).select("pos", F.lit(False).alias("_ok"))
    extra = two.join(one, "pos", "left_anti")
    every = one.unionByName(extra)
    out = every.join(bad, "pos", "left")
    return out.select("_id", "start", "length", F.col("digest").alias("sha256"), F.coalesce("_ok", F.lit(True)).alias("intact"))


def with_damage(records: DataFrame, one_in: int = 100) -> DataFrame:
    """A replica with a byte overwritten in about one of `one_in` records, drawn by the id's hash."""
    hit = F.pmod(F.xxhash64("_id"), F.lit(one_in)) == 0
    flipped = F.overlay(F.col("record"), F.encode(F.lit("X"), "UTF-8"), F.lit(6))
    return records.withColumn("record", F.when(hit, flipped).otherwise(F.col("record")))
