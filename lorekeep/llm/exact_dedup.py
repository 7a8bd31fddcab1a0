"""Exact deduplication with a log-structured merge index of text digests.

Texts are equal when identical without any change (null counts as empty). Of equal texts the row
with the largest doc_id stays.

How: (1) each task fills a bounded memtable digest -> (best doc_id, copies) and, whenever it is
full, flushes it as a run sorted by digest, with its own Bloom filter for later look-ups. Copies
that meet in a memtable never leave the task, so a huge group of copies costs one row a flush.
(2) Compaction deals the runs' rows to ranges of digests and merges each range in order, row by row
as they stream by: per digest the best doc_id and the sum of copies. The ranges in a row are one
sorted run, and the digests with more than one copy, the hits, get a filter of their own. (3) Rows
are looked up in the index: only those that the hits' filter lets through meet the hits, and only
their texts move; every such text is compared byte for byte with that of the row that stays. A text
that differs although its digest agrees is grouped again, by a second full digest. `probe` looks up
new digests in runs that were not compacted yet, by the runs' own filters.

Defined results: rows that repeat a doc_id and its text share a verdict (both kept, group_size
counts both; `one_of_each` then leaves one of them); a null doc_id stays only if its whole group
has none; extra columns, whatever their names, are ignored by `exact_duplicates` and kept by
`one_of_each`; an empty table gives an empty result. No cap on group or text sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import hot_keys, key_filter, maybe_in, packed, rows_of, skew_join, unpacked, written

#: Digests that a memtable holds before it is flushed: some 20 MB of a task's memory.
MEMTABLE_ROWS = 100_000
#: Bits of a run's filter for each of its digests, and probes into it: about 1 % false hits.
FILTER_BITS, PROBES = 10, 4

RUN_SCHEMA = "run string, digest binary, best long, copies long, filter binary"


def full_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def bloom_bits(digests: list[bytes], n_bits: int) -> np.ndarray:
    """Positions of the digests' bits: PROBES values read off each digest itself."""
    words = np.frombuffer(b"".join(d.ljust(32, b"\0")[:32] for d in digests), dtype="<u8").reshape(-1, 4)
    return (words[:, :PROBES] % np.uint64(n_bits)).astype(np.int64)


def bloom(digests: list[bytes]) -> bytes:
    bits = np.zeros(max(64, -(-len(digests) * FILTER_BITS // 8) * 8), np.uint8)
    if digests:
        bits[bloom_bits(digests, len(bits)).ravel()] = 1
    return np.packbits(bits).tobytes()


def bloom_has(filt: bytes, digests: list[bytes]) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(filt, np.uint8))
    return bits[bloom_bits(digests, len(bits))].all(axis=1) if digests else np.zeros(0, bool)


def flusher(rows: int):
    """Memtable and flush: sorted runs of (digest, best doc_id, copies); a run's first row carries its filter."""

    def flush(mem: dict[bytes, list], name: str) -> pa.RecordBatch:
        keys = sorted(mem)
        filters = [bloom(keys), *[None] * (len(keys) - 1)]
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(keys)), pa.array(keys, pa.binary()), pa.array([mem[k][0] for k in keys], pa.int64()), pa.array([mem[k][1] for k in keys], pa.int64()), pa.array(filters, pa.binary())],
            names=["run", "digest", "best", "copies", "filter"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        mem: dict[bytes, list] = {}
        for b in batches:
            for d, i in zip(b.column("digest").to_pylist(), b.column("doc_id").to_pylist(), strict=True):
                held = mem.get(d)
                if held is None:
                    if len(mem) >= rows:
                        yield flush(mem, f"{task:06d}-{n:04d}")
                        mem, n = {}, n + 1
                    mem[d] = [i, 1]
                else:
                    held[1] += 1
                    if i is not None and (held[0] is None or i > held[0]):
                        held[0] = i
        if mem:
            yield flush(mem, f"{task:06d}-{n:04d}")

    return run


def build_runs(keys: DataFrame, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Level 0 of the index over keys (doc_id, digest), as a written table."""
    return written(keys.select("doc_id", "digest").mapInArrow(flusher(memtable_rows), RUN_SCHEMA), "runs")


def merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of all runs, sorted by digest: equal neighbours become one row. Holds one digest between batches."""
    held: list | None = None

    def closed(rows: list[list]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["digest", "best", "copies"])

    for b in batches:
        done = []
        for d, i, n in zip(*(b.column(c).to_pylist() for c in ("digest", "best", "copies")), strict=True):
            if held is not None and held[0] == d:
                held[2] += n
                if i is not None and (held[1] is None or i > held[1]):
                    held[1] = i
            else:
                if held is not None:
                    done.append(held)
                held = [d, i, n]
        yield closed(done)
    if held is not None:
        yield closed([held])


def compact(runs: DataFrame) -> DataFrame:
    """One sorted run of all, in ranges of digests: per digest the best doc_id and all copies."""
    ranges = runs.select("digest", "best", "copies").repartitionByRange("digest").sortWithinPartitions("digest")
    return written(ranges.mapInArrow(merger, "digest binary, best long, copies long"), "level1")


#: New digests that are tried against a run's filter at once.
PROBE_BLOCK = 4096


def probe(runs: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys (digest) that runs already hold: (digest, best, copies).

    For incremental use, before new runs are compacted. Each run's filter is tried before the run
    itself is read, in blocks of some PROBE_BLOCK new keys, so runs without a hit cost their filter alone.
    """
    news = written(keys.select("digest").distinct(), "new")
    n = max(1, -(-rows_of(news) // PROBE_BLOCK))
    blocks = news.groupBy(F.pmod(F.xxhash64("digest"), F.lit(n)).alias("block")).agg(F.collect_list("digest").alias("digests"))
    filters = runs.where("filter is not null").select("run", "filter")

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for run, filt, digests in zip(b.column("run").to_pylist(), b.column("filter").to_pylist(), b.column("digests").to_pylist(), strict=True):
                hit = [d for d, ok in zip(digests, bloom_has(filt, digests), strict=True) if ok]
                yield pa.RecordBatch.from_arrays([pa.array([run] * len(hit), pa.string()), pa.array(hit, pa.binary())], names=["run", "digest"])

    per_run = filters.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    likely = per_run.join(blocks, "block").select("run", "filter", "digests").mapInArrow(tried, "run string, digest binary")
    hits = runs.join(likely, ["run", "digest"])
    return hits.groupBy("digest").agg(F.max("best").alias("best"), F.sum("copies").alias("copies"))


def _split(docs: DataFrame, digest) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows surely without a twin, the others, of these the rows that stay, the digests with copies)."""
    docs = docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("_digest", digest(F.col("_text")))
    runs = build_runs(docs.select(F.col("_id").alias("doc_id"), F.col("_digest").alias("digest")))
    index = compact(runs)
    hits = index.where("copies > 1").select(F.col("digest").alias("_digest"), F.col("best").alias("_best"), "copies")
    hits = written(hits, "hits")
    seen = maybe_in(docs, F.xxhash64("_digest"), key_filter(hits, F.xxhash64("_digest"))).withColumnRenamed("_hit", "_maybe")
    single = seen.where("not _maybe")
    some = seen.where("_maybe")
    # the rows that stay, one a digest: found by a filter on (digest, doc_id), so no other text moves
    pair = F.xxhash64("_digest", "_best")
    stay = maybe_in(some, F.xxhash64("_digest", "_id"), key_filter(hits, pair)).where("_hit").drop("_hit")
    best = hits.select(F.col("_digest").alias("_d"), "_best")
    stay = stay.join(best, (F.col("_digest") == F.col("_d")) & F.col("_id").eqNullSafe(F.col("_best"))).drop("_d").dropDuplicates(["_digest"])
    return single, some, stay, hits


def _verified(some: DataFrame, stay: DataFrame, hits: DataFrame) -> DataFrame:
    """(_id, _digest, _sha, _best, state): 0 without a twin, 1 equal to the row that stays, 2 different; written, without texts."""
    stays = stay.select("_digest", "_best", F.col("_text").alias("_stays"))
    met = skew_join(some.withColumn("_sha", full_digest(F.col("_text"))), stays, ["_digest"], F.struct("_id", "_text"), hot_keys(hits, ["_digest"], "copies"), "left")
    same = F.col("_stays").cast("binary") == F.col("_text").cast("binary")
    state = F.when(F.col("_stays").isNull(), 0).when(same, 1).otherwise(2)
    return written(met.select("_id", "_digest", "_sha", "_best", state.alias("_state")), "verified")


def exact_duplicates(docs: DataFrame, digest=full_digest) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    single, some, stay, hits = _split(docs.select("doc_id", "text"), digest)
    met = _verified(some, stay, hits)
    if met.where("_state = 2").isEmpty():
        sizes = met.where("_state = 1").groupBy("_digest").agg(F.count("*").alias("n"))
        grouped = skew_join(met.where("_state = 1"), sizes, ["_digest"], F.col("_id"), hot_keys(hits, ["_digest"], "copies"))
    else:  # digests that deceive: their rows are grouped by a full digest together with the weak one
        exact = met.where("_state > 0").groupBy("_digest", "_sha").agg(F.max("_id").alias("_best"), F.count("*").alias("n"))
        keys = ["_digest", "_sha"]
        grouped = skew_join(met.where("_state > 0").drop("_best"), exact, keys, F.col("_id"), hot_keys(exact, keys, "n"))
    lone = met.where("_state = 0").select("_id", "_sha").unionByName(single.select("_id", full_digest(F.col("_text")).alias("_sha")))
    lone = lone.select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_sha")
    grouped = grouped.select("_id", F.col("_best").alias("keep_id"), F.col("n").alias("group_size"), F.col("_id").eqNullSafe(F.col("_best")).alias("kept"), "_sha")
    return lone.unionByName(grouped).select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("_sha")).alias("text_sha256"))


def one_of_each(docs: DataFrame, digest=full_digest) -> DataFrame:
    """docs without all but one row of each distinct text, with all their columns."""
    single, some, stay, hits = _split(packed(docs, "doc_id", "text"), digest)
    met = _verified(some, stay, hits)
    if met.where("_state = 2").isEmpty():
        # what stays of the hits is `stay`; rows that the filter let through without a twin stay too
        alone = written(met.where("_state = 0").select("_digest").distinct(), "alone")
        lone = maybe_in(some, F.xxhash64("_digest"), key_filter(alone, F.xxhash64("_digest"))).where("_hit")
        kept = lone.join(alone, "_digest", "left_semi").select("_row").unionByName(stay.select("_row"))
    else:  # of rows of one weak and one full digest the best, hot groups first within parts of them
        some = some.withColumn("_sha", full_digest(F.col("_text"))).withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(64)))
        for group in (["_digest", "_sha", "_part"], ["_digest", "_sha"]):
            best = F.max_by(F.struct("_row", "_id", "_part"), F.coalesce("_id", F.lit(-(1 << 63))))
            some = some.groupBy(*group).agg(best.alias("_best")).select(*[g for g in group if g != "_part"], "_best.*")
        kept = some.select("_row")
    return unpacked(single.select("_row").unionByName(kept), docs.columns)


def documents_index(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The compacted index of docs: digest, best, copies."""
    return compact(build_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), full_digest(F.col("text")).alias("digest"))))
