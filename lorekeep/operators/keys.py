"""Rows of a large table for a list of keys, without moving the rows of other keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.sources.tables import kept

#: Keys up to which a list is broadcast as it is.
FEW = 200_000
#: Bits of the filter for each key, words of 64 bits in one of its rows, and its rows at most: 32 MB.
BITS, WORDS, SLOTS = 16, 512, 1 << 13


def _places(h: Column, slots: int) -> tuple[Column, list[tuple[Column, Column]]]:
    """The slot of a 64-bit hash, and the word and bit there of its two probes."""
    at = lambda n: (F.pmod(F.shiftrightunsigned(h, n), F.lit(WORDS)).cast("int"), F.pmod(F.shiftrightunsigned(h, n + 9), F.lit(64)).cast("int"))
    return F.pmod(h, F.lit(slots)).cast("int"), [at(16), at(40)]


class Keys:
    """The distinct values of a table's only column, written once, with their filter if they are many."""

    def __init__(self, keys: DataFrame):
        self.rows = kept(keys.toDF("_key").where("_key is not null").distinct())
        self.n = self.rows.count()
        self.slots = max(1, min(SLOTS, -(-self.n * BITS // (64 * WORDS))))
        self.bits = self._filter() if self.n > FEW else None

    def _filter(self) -> DataFrame:
        slot, probes = _places(F.xxhash64("_key"), self.slots)
        one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
        each = self.rows.select(slot.alias("slot"), F.explode(F.array(*[F.struct(w.alias("w"), one(b).alias("v")) for w, b in probes])).alias("x")).select("slot", "x.w", "x.v")
        grid = self.rows.sparkSession.range(self.slots * WORDS).select(F.floor(F.col("id") / WORDS).cast("int").alias("slot"), (F.col("id") % WORDS).cast("int").alias("w"), F.lit(0).cast("long").alias("v"))
        words = each.unionByName(grid).groupBy("slot", "w").agg(F.bit_or("v").alias("v"))
        return kept(words.groupBy(F.col("slot").alias("_slot")).agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("_bits")))


def among(rows: DataFrame, key: str, keys: Keys) -> DataFrame:
    """The rows whose key is one of keys.

    Few keys are broadcast. Of more, a Bloom filter is, of 16 bits a key and 32 MB at most; rows
    that it lets pass (some 1.4 % of those that need not, all at worst) meet the keys in a join.
    """
    own = keys.rows.withColumnRenamed("_key", key)
    if keys.bits is None:
        return rows.join(F.broadcast(own), key, "left_semi")
    slot, probes = _places(F.xxhash64(key), keys.slots)
    met = rows.withColumn("_slot", slot).join(F.broadcast(keys.bits), "_slot")
    for w, b in probes:
        met = met.where(F.call_function("getbit", F.get("_bits", w), b) == 1)
    return met.select(rows.columns).join(own, key, "left_semi").select(rows.columns)
