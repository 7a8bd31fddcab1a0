"""Near-duplicate detection by HyperMinHash: compressed registers, banding, estimation, exact check.

A document's set holds its distinct k-word shingles, of the text with A-Z lower-cased; a text of
fewer words is one shingle; without words it has none and is linked with nothing. Two documents
are linked if 100 * |A and B| >= percent * |A or B|, decided on the full sets. A document's
component is the smallest doc_id that links reach from it.

How: (1) each text becomes a sketch of 128 registers. One hash deals the shingles to buckets; a
bucket keeps the leading-zero count (6 bits) and 10 mantissa bits of its least value. Buckets that
stay empty (short texts) are filled by a hash of their own over all shingles, so every register
agrees with probability J. (2) Texts with one set are one class from here on. (3) Registers are
banded by 4; 32 bands find a pair at J = 0.75 with probability 1 - (1 - 0.75^4)^32 = 0.999995.
(4) In each bucket every class meets the bucket's smallest one; pairs whose collision-corrected
estimate is possible are checked on the full sets. (5) After components, members of buckets that
still hold several components meet in blocks, so no link is lost, but nobody meets a member of
its own component.

Defined results: null text counts as empty; rows that repeat a doc_id get the same component; a
null doc_id takes part in no group (component_id null, kept true); extra columns are ignored; an
empty table gives an empty result. There is no cap on groups, candidates or text lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import tokens as tk
from lorekeep.llm.common import hot_keys, key_filter, maybe_in, packed, rows_of, skew_join, unpacked, written

REGISTERS, ROWS, BANDS = 128, 4, 32
MANTISSA = 10
#: Standard deviations by which an estimate may fall short of the threshold before a pair is dropped.
SLACK = 5.0
#: Members of one side of a block of comparisons.
BLOCK = 512

SKETCH_SCHEMA = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"


def registers(doc: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents that have shingles, their registers as uint16 [documents, REGISTERS])."""
    starts = tk.group_starts(doc)
    owners = doc[starts]
    n, k = len(owners), REGISTERS
    row = np.repeat(np.arange(n), np.diff(np.r_[starts, len(doc)]))
    empty = np.uint64((1 << 64) - 1)
    h = tk.mix(s ^ tk.seed(0))
    least = np.full(n * k, empty, np.uint64)
    np.minimum.at(least, row * k + (h & np.uint64(k - 1)).astype(np.int64), h >> np.uint64(7))
    least = least.reshape(n, k)
    thin = (least == empty).any(axis=1)
    if thin.any():
        of = thin[row]
        rest, rest_row = s[of], row[of]
        at = tk.group_starts(rest_row)
        who = rest_row[at]
        for b in range(k):
            lacks = least[who, b] == empty
            if lacks.any():
                v = np.minimum.reduceat(tk.mix(rest ^ tk.seed(b + 1)) >> np.uint64(7), at)
                least[who[lacks], b] = v[lacks]
    # leading bit by float exponent; clearing the bit below it keeps rounding from carrying over
    _, e = np.frexp((least & ~(least >> np.uint64(1))).astype(np.float64))
    top = np.maximum(e.astype(np.int64) - 1, 0)
    shift = top - MANTISSA
    low = np.where(shift >= 0, least >> np.maximum(shift, 0).astype(np.uint64), least << np.maximum(-shift, 0).astype(np.uint64))
    zeros = np.where(least == 0, 57, 56 - top)
    return owners, ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | (low & np.uint64((1 << MANTISSA) - 1))).astype(np.uint16)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, doc, shingle) of runs of rows."""
    for i, j, data, off in tk.chunks(batch.column("text")):
        yield i, j, *tk.shingles(data, off, k)


def sketcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, doc, s in _sets(batch, k):
                m = j - i
                n = np.bincount(doc, minlength=m).astype(np.int64) if len(doc) else np.zeros(m, np.int64)
                h1, h2 = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
                offs = np.zeros(m + 1, np.int32)
                flat = np.zeros(0, np.int64)
                if len(doc):
                    at = tk.group_starts(doc)
                    owners, regs = registers(doc, s)
                    h1[owners] = np.add.reduceat(tk.mix(s ^ tk.seed(501)), at)
                    h2[owners] = np.add.reduceat(tk.mix(s ^ tk.seed(502)), at)
                    flat = np.ascontiguousarray(regs).view(np.int64).ravel()
                    np.cumsum((n > 0) * BANDS, out=offs[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, m), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))],
                    names=["doc_id", "n_shingles", "h1", "h2", "bands"],
                )

    return run


def set_maker(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, doc, s in _sets(batch, k):
                offs = np.zeros(j - i + 1, np.int32)
                np.cumsum(np.bincount(doc, minlength=j - i), out=offs[1:])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(offs), pa.array(s.view(np.int64)))], names=["cid", "shingles"])

    return run


def estimate(same: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from agreeing registers, less those that agree by chance.

    Chance agreement of two buckets follows the HyperMinHash collision bound
    0.1699 * 2^-mantissa * 4 r / (1 + r)^2 with r the ratio of the set sizes.
    """
    r = n / np.maximum(m, 1)
    chance = 0.169919487159739 * 2.0**-MANTISSA * 4 * r / (1 + r) ** 2 * REGISTERS
    return (same - chance) / REGISTERS


def least_estimate(percent: int) -> float:
    j = percent / 100
    return j - SLACK * (j * (1 - j) / REGISTERS) ** 0.5


def _lists(col: pa.Array, width: int | None = None) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width) if width else flat


def estimator(percent: int):
    floor = least_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.ascontiguousarray(_lists(b.column(c), BANDS)).view(np.uint16).reshape(-1, REGISTERS) for c in ("bands_a", "bands_b"))
            n, m = (b.column(c).to_numpy() for c in ("n_a", "n_b"))
            ok = estimate((x == y).sum(axis=1), n, m) >= floor
            ok &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def checker(percent: int):
    """Pairs whose full sets are similar enough; each row holds both sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = []
            for c in ("set_a", "set_b"):
                col = b.column(c)
                sides.append((col.flatten().to_numpy(zero_copy_only=False), col.offsets.to_numpy() - (col.offsets[0].as_py() if len(col) else 0)))
            ok = np.zeros(b.num_rows, bool)
            (fa, oa), (fb, ob) = sides
            for i in range(b.num_rows):
                x, y = fa[oa[i] : oa[i + 1]], fb[ob[i] : ob[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(cid, shingles) of the documents in ids (cid), written; other texts stay where they are."""
    ids = written(ids, "ids")
    some = maybe_in(docs, F.xxhash64("doc_id"), key_filter(ids, F.xxhash64("cid"))).where("_hit").select("doc_id", "text")
    sets = some.join(ids.withColumnRenamed("cid", "doc_id").hint("merge"), "doc_id", "left_semi").mapInArrow(set_maker(k), "cid long, shingles array<long>")
    return written(sets.where(F.size("shingles") > 0), "sets")


def similar_pairs(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are links, by estimate and then by their full sets."""
    # joined by merging at every size, so that what moves grows in step with the input
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bands").alias(f"bands_{x}")).hint("merge")
    pairs = written(pairs, "pairs")
    hot = hot_keys(pairs.groupBy("a").count(), ["a"], "count")
    both = skew_join(pairs, side("a"), ["a"], F.col("b"), hot).join(side("b"), "b")
    likely = written(both.mapInArrow(estimator(percent), "a long, b long"), "likely")
    sets = full_sets(docs, likely.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), k)
    a = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("set_b"))
    full = skew_join(likely, a.hint("merge"), ["a"], F.col("b"), hot).join(b.hint("merge"), "b").select("a", "b", "set_a", "set_b")
    return written(full.mapInArrow(checker(percent), "a long, b long").distinct(), "links")


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(v, comp) for every end of a link (a, b): comp is the smallest id that it reaches, or, after so many rounds, some id that it reaches.

    Minimum labels travel along links and onto the labels' own roots, then every label is
    replaced by its label's label; the rounds are logarithmic in the longest path. All is done
    by joins and minima, each round written as a table.
    """
    edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).where("u <> v").distinct(), "edges")
    degree = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"), F.count("*").alias("n"))
    label = written(degree.select("v", F.least("v", "m").alias("p"), "n"), "labels")
    hot = hot_keys(label, ["v"], "n")
    label = label.select("v", "p")
    done = 0
    while True:
        to = edges.select(F.col("u").alias("v"), F.col("v").alias("of"))
        near = skew_join(to, label, ["v"], F.col("of"), hot).groupBy(F.col("of").alias("v")).agg(F.min("p").alias("m"))
        own = label.join(near, "v").select("v", "p", F.least("p", "m").alias("m"))
        roots = own.groupBy(F.col("p").alias("v")).agg(F.min("m").alias("r"))
        new = written(own.join(roots, "v", "left").select("v", F.col("p").alias("was"), F.least("m", F.coalesce("r", "m")).alias("p")), "near")
        # then every label is replaced by its own label
        up = new.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        popular = hot_keys(new.groupBy("p").count(), ["p"], "count")
        jumped = skew_join(new, up, ["p"], F.col("v"), popular, "left").select("v", "was", F.least("p", F.coalesce("pp", "p")).alias("p"))
        label = written(jumped, "labels")
        done += 1
        if done == rounds or label.where("p <> was").isEmpty():
            return label.select("v", F.col("p").alias("comp"))
        label = label.select("v", "p")


def _blocks(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows (band, key, cid, comp, kind, x, y), one a member and pair of blocks to compare, of buckets with several components.

    The bucket's largest component needs no comparing with itself: its blocks (A) meet those of
    the others (B) only, and the B blocks meet each other.
    """
    bucket = ["band", "key"]
    sizes = rows.groupBy(*bucket, "comp").agg(F.count("*").alias("c"))
    tops = sizes.groupBy(*bucket).agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"))
    tops = tops.select(*bucket, F.col("top.comp").alias("main"), F.greatest(F.lit(1), F.ceil(F.col("top.c") / BLOCK)).cast("int").alias("na"), F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("top.c")) / BLOCK)).cast("int").alias("nb"))
    rows = skew_join(rows, tops, bucket, F.col("cid"), hot)
    is_a = F.col("comp") == F.col("main")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("cid"), F.when(is_a, F.col("na")).otherwise(F.col("nb"))).cast("int"))
    all_b = F.sequence(F.lit(0), F.col("nb") - 1)
    all_a = F.sequence(F.lit(0), F.col("na") - 1)
    a_side = F.transform(all_b, lambda j: F.struct(F.lit("ab").alias("kind"), F.col("mine").alias("x"), j.alias("y")))
    b_side = F.concat(
        F.transform(all_a, lambda i: F.struct(F.lit("ab").alias("kind"), i.alias("x"), F.col("mine").alias("y"))),
        F.transform(all_b, lambda j: F.struct(F.lit("bb").alias("kind"), F.least(F.col("mine"), j).alias("x"), F.greatest(F.col("mine"), j).alias("y"))),
    )
    return rows.withColumn("at", F.explode(F.when(is_a, a_side).otherwise(b_side))).select(*bucket, "cid", "comp", "at.kind", "at.x", "at.y")


def block_comparer(percent: int):
    """Links between different components of one pair of blocks: by estimate, then on the full sets.

    One link is enough to join two components, so pairs of components that are joined already
    are passed over.
    """
    floor = least_estimate(percent)

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        band = t.column("band")[0].as_py()
        cid, comp, n = (t.column(c).to_numpy() for c in ("cid", "comp", "n_shingles"))
        regs = np.ascontiguousarray(_lists(t.column("bands").combine_chunks(), BANDS))
        r16 = regs.view(np.uint16).reshape(-1, REGISTERS)
        sets = t.column("shingles").combine_chunks()
        flat, off = sets.values.to_numpy(zero_copy_only=False), sets.offsets.to_numpy()
        comp, found = comp.copy(), []
        for i in range(len(cid) - 1):
            lo, hi = np.minimum(n[i + 1 :], n[i]), np.maximum(n[i + 1 :], n[i])
            ok = (comp[i + 1 :] != comp[i]) & (100 * lo >= percent * hi)
            ok &= ~(regs[i + 1 :, :band] == regs[i, :band]).any(axis=1)  # only in the pair's first common band
            near = np.flatnonzero(ok) + i + 1
            near = near[estimate((r16[near] == r16[i]).sum(axis=1), n[near], np.full(len(near), n[i])) >= floor]
            x = flat[off[i] : off[i + 1]]
            for j in near:
                if comp[j] != comp[i]:
                    both = len(np.intersect1d(x, flat[off[j] : off[j + 1]], assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        found.append((min(cid[i], cid[j]), max(cid[i], cid[j])))
                        comp[comp == comp[j]] = comp[i]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (it is its component's smallest doc_id)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = written(docs.mapInArrow(sketcher(k), SKETCH_SCHEMA), "sketches")
    able = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = able.groupBy("h1", "h2").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("cid"), F.min("n_shingles").alias("n_shingles"), F.count("*").alias("copies"))
    classes = written(classes, "classes")

    banded = classes.select("cid", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.count("*").alias("m"), F.min("cid").alias("center")).where("m > 1")
    shared = written(shared, "buckets")
    at = F.xxhash64("band", "key")
    banded = maybe_in(banded, at, key_filter(shared, at)).where("_hit").drop("_hit")
    crowded = hot_keys(shared, ["band", "key"], "m")
    members = written(skew_join(banded, shared, ["band", "key"], F.col("cid"), crowded), "members")
    stars = members.where("cid <> center").select(F.col("center").alias("a"), F.col("cid").alias("b")).distinct()
    links = similar_pairs(stars, docs, classes, k, percent)
    comps = components(links, rounds=1)  # stars, so one round joins nearly all that the links join

    # buckets of three or more that still hold several components: their other pairs
    named = members.where("m > 2").join(comps.withColumnRenamed("v", "cid"), "cid", "left")
    named = named.select("band", "key", "cid", F.coalesce("comp", "cid").alias("comp"))
    split = named.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band", "key")
    named = written(skew_join(named, split, ["band", "key"], F.col("cid"), crowded), "split")
    all_links = links
    if rows_of(named):
        sets = full_sets(docs, named.select("cid").distinct(), k).hint("merge")
        full = _blocks(named, crowded).join(classes.select("cid", "n_shingles", "bands").hint("merge"), "cid").join(sets, "cid")
        pairs = full.groupBy("band", "key", "kind", "x", "y").applyInArrow(block_comparer(percent), "a long, b long")
        all_links = links.union(written(pairs.distinct(), "more"))
    comps = components(all_links)

    moved = classes.join(comps.withColumnRenamed("v", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    moved = moved.where("copies > 1 or comp <> cid").select("h1", "h2", "comp")
    copied = hot_keys(classes, ["h1", "h2"], "copies")
    named = skew_join(sketches.select("doc_id", "n_shingles", "h1", "h2"), moved, ["h1", "h2"], F.col("doc_id"), copied, "left")
    comp = F.when(F.col("n_shingles") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id"))
    comp = F.when(F.col("doc_id").isNotNull(), comp)
    return named.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs whose document is kept, with all their columns; null doc_ids stay."""
    gone = near_duplicates(docs, k, percent).where("not kept").select("doc_id").distinct()
    gone = written(gone, "gone")
    rows = packed(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    seen = maybe_in(rows, F.xxhash64("doc_id"), key_filter(gone, F.xxhash64("doc_id")))
    rest = seen.where("_hit").join(gone, "doc_id", "left_anti")
    return unpacked(seen.where("not _hit").select("_row").unionByName(rest.select("_row")), docs.columns)
