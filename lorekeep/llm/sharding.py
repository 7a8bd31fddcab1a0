"""Contiguous shards of nearly equal bytes, by prefix sums over totals of partitions.

All documents, in order of doc_id (nulls first; ties by size and checksum), are cut at equal
targets of the global byte prefix sum; a document belongs to the shard in which its middle byte
lies. The law is `bytes`: two shards differ by less than the largest document's size.

How: one range exchange deals (doc_id, size, checksum), never the text, to ordered partitions of
even row counts; they are written, so their bounds are settled. Their totals, one row a partition,
are summed up in order; each row's global offset is its partition's offset plus a running sum
inside the partition. Slots come from the global row number in the same way.

Defined results: a null text has no bytes (size 16, checksum 0); equal rows are ordered among
themselves and each gets a slot of its own; an empty table gives an empty result; extra columns
are ignored. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import written

#: Bytes that a row costs besides its text.
ROW_BYTES = 16


def byte_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (always null under this law)."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    order = ["doc_id", "size", "text_crc32"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")

    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))

    inside = Window.partitionBy("part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(upto)).withColumn("nth", F.row_number().over(inside)).join(offsets, "part")
    # twice the middle, so that all stays in integers
    middle2 = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")
    shard = F.least(F.lit(shards - 1), F.expr(f"cast((cast(0 as decimal(38,0)) + middle2) * {shards} div (2 * all_bytes) as int)"))
    placed = placed.withColumn("middle2", middle2).withColumn("shard", shard).withColumn("row", F.col("rows_before") + F.col("nth"))
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("row") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
