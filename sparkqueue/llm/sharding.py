"""Sharding by longest processing time: what must stay together goes to the least-loaded shard.

The heap sees a bounded number of items. A group (equal texts) of at least a fixed small share of a
shard is an item of its own, so there are at most ``shards * fine`` of them; all smaller groups are
pooled by a hash of the group into ``shards * fine`` bundles, which stay together too. Items go to
the heap by falling size, so at the end loads differ by at most the smallest items.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkqueue.llm import common


def longest_first(items: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Item name -> shard: the largest first, ties by name, each to the least-loaded, lowest shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def shard_documents(docs: DataFrame, shards: int = 24, fine: int = 400, chunk_rows: int = 20_000) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each document.

    ``size`` is the text's UTF-8 bytes plus 8 (a null text has none, and its checksum is that of
    no bytes). The law is ``bytes``: loads are near equal. Equal texts share a shard; null texts
    are one group, apart from empty ones. ``slot`` numbers a shard's rows from 0 without a gap.
    Repeated rows each get a slot; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    group = F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.md5(text))
    rows = common.written(
        common.documents_only(docs, "doc_id", "text").select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            group.alias("group"),
            F.pmod(F.xxhash64(group), F.lit(shards * fine)).cast("int").alias("bundle"),
        ),
        "shard-rows",
    )
    whole = rows.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).first()
    threshold = max(1, (whole["size"] or 0) // (shards * fine))
    groups = rows.groupBy("group", "bundle").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    groups = common.written(groups, "shard-groups")
    large = [(r.size, r.group) for r in groups.where(F.col("size") >= threshold).select("size", "group").collect()]
    bundles = [(r.size, f"bundle {r.bundle}") for r in groups.where(F.col("size") < threshold).groupBy("bundle").agg(F.sum("size").alias("size")).collect()]
    common.drop_written(groups)
    found = longest_first([*large, *bundles], shards)

    own = F.broadcast(spark.createDataFrame([(g, found[g]) for _, g in large], "group string, own int"))
    pooled = F.broadcast(spark.createDataFrame([(int(b.split()[1]), found[b]) for _, b in bundles], "bundle int, pooled int"))
    chunks = max(1, -(-whole["n"] // chunk_rows))
    placed = rows.join(own, "group", "left").join(pooled, "bundle", "left").withColumn("shard", F.coalesce("own", "pooled"))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(chunks)).cast("int")).drop("own", "pooled", "bundle")
    # Slots: a shard's rows are numbered chunk by chunk; only the chunks' sizes are summed per shard.
    sizes = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size", "group")
    numbered = placed.withColumn("at", F.row_number().over(within) - 1).join(bases, ["shard", "chunk"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
