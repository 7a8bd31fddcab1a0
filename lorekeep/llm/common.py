"""What the corpus operators share: words, the shared work folder, bounded key filters, salting."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: blank and 0x09 to 0x0D, nothing else.
SPACES = " \t\n\x0b\x0c\r"
#: Bits of a key filter for each key, bits of one of its rows (a fixed value of Spark's bitmap functions), and its rows at most: 32 MB.
FILTER_BITS, BITMAP_BITS, FILTER_ROWS = 16, 1 << 15, 1 << 13
#: Rows of one key beyond which it may be dealt over several tasks, and how many keys are at most.
HOT_ROWS, HOT_KEYS = 256, 1 << 14


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text in order; null gives an empty array."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(flat, " "), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Only a local master may go without that setting; it then gets a folder in /tmp.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/lorekeep-work"
    return f"{base.rstrip('/')}/lorekeep-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path, seen = f"{work_dir(spark)}/{name}", Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.rows_written = seen.get["rows"]
    return out


def rows_of(df: DataFrame) -> int:
    """The number of rows, which `written` tables know already."""
    known = getattr(df, "rows_written", None)
    return df.count() if known is None else known


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """The whole row as `_row` and only the named columns beside it: names inside it cannot clash with an operator's own."""
    return df.select(F.struct(*[quoted(c) for c in df.columns]).alias("_row"), *[quoted(c).alias(c) for c in columns])


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that `packed` took in, with their columns."""
    return df.select(*[F.col("_row").getField(c).alias(c) for c in columns])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class KeyFilter:
    """Bitmaps (slot, bits) of hashed keys, sized by their number."""

    rows: DataFrame
    slots: int


def _places(h: Column, slots: int) -> tuple[Column, list[Column]]:
    """The slot of a hash and its two bits there."""
    slot = F.pmod(h, F.lit(slots)).cast("int")
    return slot, [F.pmod(F.shiftrightunsigned(h, n), F.lit(BITMAP_BITS)).cast("int") for n in (16, 40)]


def key_filter(keys: DataFrame, hashed: Column) -> KeyFilter:
    """A Bloom filter of the keys' 64-bit hashes: 16 bits a key and two probes, some 1.4 % false hits.

    It has FILTER_ROWS bitmaps of 4 KB at most, so it can always be broadcast. Beyond 16 million
    keys it fills up: more rows pass `maybe_in` than need to (at worst all), and none is ever lost.
    """
    n = rows_of(keys)
    slots = max(1, min(FILTER_ROWS, -(-n * FILTER_BITS // BITMAP_BITS)))
    slot, bits = _places(F.col("h"), slots)
    each = keys.select(hashed.alias("h")).select(slot.alias("slot"), F.explode(F.array(*bits)).alias("bit"))
    return KeyFilter(each.groupBy("slot").agg(F.call_function("bitmap_construct_agg", F.col("bit")).alias("bits")), slots)


def maybe_in(df: DataFrame, hashed: Column, filt: KeyFilter) -> DataFrame:
    """df with a boolean column `_hit`: false means that the row's key is surely not in the filter."""
    df = df.withColumn("_h", hashed)
    slot, bits = _places(F.col("_h"), filt.slots)
    held = F.broadcast(filt.rows.select(F.col("slot").alias("_slot"), F.col("bits").alias("_bits")))
    df = df.withColumn("_slot", slot).join(held, "_slot", "left")
    byte = lambda b: F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(b, 3) + 1, F.lit(1))), 16, 10).cast("int")
    one = [F.getbit(byte(b), F.pmod(b, F.lit(8)).cast("int")) == 1 for b in bits]
    return df.withColumn("_hit", F.coalesce(F.col("_bits").isNotNull() & one[0] & one[1], F.lit(False))).drop("_h", "_slot", "_bits")


def hot_keys(counted: DataFrame, keys: list[str], count: str) -> DataFrame | None:
    """(h, k): hashes of the keys that are dealt over k tasks; None if there are none.

    The HOT_KEYS keys with most rows are looked at, if they have over HOT_ROWS: no other has more
    than 1 / HOT_KEYS of the rows. k grows with a key's rows, so a task gets an even share of it
    however large it is. What reaches the driver is these rows, HOT_KEYS at most.
    """
    hot = counted.where(F.col(count) > HOT_ROWS).select(F.xxhash64(*keys).alias("h"), F.col(count).cast("long").alias("n"))
    top = hot.orderBy(F.col("n").desc(), "h").limit(HOT_KEYS).collect()
    share = max(HOT_ROWS, sum(r.n for r in top) // HOT_KEYS)
    most: dict[int, int] = {}
    for r in top:
        most[r.h] = max(most.get(r.h, 0), -(-r.n // share))
    rows = [(h, k) for h, k in most.items() if k > 1]
    return counted.sparkSession.createDataFrame(rows, "h long, k int") if rows else None


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left join right where right has one row a key: the rows of hot keys are dealt over as many tasks as `hot` says."""
    if hot is None:
        return left.join(right, keys, how)
    hot = F.broadcast(hot.select(F.col("h").alias("_h"), F.col("k").alias("_k")))  # HOT_KEYS rows at most
    h = F.xxhash64(*keys)
    left = left.withColumn("_h", h).join(hot, "_h", "left")
    left = left.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_k")).cast("int"), F.lit(0))).drop("_h", "_k")
    right = right.withColumn("_h", h).join(hot, "_h", "left")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_k", F.lit(1)) - 1))).drop("_h", "_k")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
