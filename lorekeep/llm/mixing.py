"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Size of a document: its words. Sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1 and
so on, and share `share` (150 %) of all words by weight; a target stops at twice its source's
words and the excess goes to the others by weight until none is above.

How: (1) the targets come in closed form: sources sorted by cap over weight fill up one after
another, and one level serves all that are below their caps. (2) The total is cut into blocks of
equal tokens, `blocks` of them or so many more that a shard holds BLOCKS_PER_SHARD, and
Sainte-Lague gives each source as many as its target earns: the highest of the quotients
target / (2 k + 1). (3) The same rule deals a source's blocks to groups of its shards and then to
the shards by their words (a shard takes twice its words at most), so each shard has an integer
quota and is worked on by itself; what a target is more or less than its blocks goes to the
source's largest shard. Shards have some ROWS_PER_SHARD rows however large a source is, and a
source has about as many groups as a group has shards, so no step orders more than the square root
of the shards. (4) In a shard the documents, in seeded order, form blocks of equal tokens; blocks
are taken in another seeded order. A quota above the shard's words takes every document once and
the rest from a second pass. The pass ends with the last document that fits; then the largest
unused document that fits, and the one that leaves the least difference, close the gap, so a source
misses its target by little. Documents are taken whole, 0, 1 or 2 times.

Defined results: null text has size 0; a source without words has target 0; rows that repeat a
doc_id, text and source are counted together before anything moves and dealt out again at the end,
in one block; a null doc_id is an id of its own; ties (equal quotients, equal sizes) go to the
first source or shard and the smaller seeded mark; the mark is md5 of seed, doc_id and text digest,
so reruns agree; an empty table gives an empty result; texts of any length are one document; extra
columns, whatever their names, are kept by `mixed` and ignored by `mix_plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import key_filter, maybe_in, packed, unpacked, words, written

BLOCKS = 20_000
ROWS_PER_SHARD = 2_000
BLOCKS_PER_SHARD = 16
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, share: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, n_docs, sid, target from rows (source, size, m copies); one row a source."""
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n_docs"))
    ranked = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", 2.0 * F.col("source_size"))
    every = Window.partitionBy()
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    filled = ranked.withColumn("asked", share * F.sum("source_size").over(every))
    # level if this source and all after it are below their caps
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("asked") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = filled.withColumn("level", level).withColumn("below", F.col("level") * F.col("weight") <= F.col("cap"))
    best = F.min(F.when(F.col("below"), F.struct(F.col("cap") / F.col("weight"), "sid", "level"))).over(every)["level"]
    target = F.least(F.col("cap"), F.coalesce(best * F.col("weight"), F.col("cap")))
    return filled.select("source", "source_size", "n_docs", "sid", target.alias("target"))


def apportion(parties: DataFrame, key: list[str], seats: Column, weight: str, within: list[str], most: str | None = None) -> DataFrame:
    """parties with `quota`: `seats` units dealt by Sainte-Lague inside each `within` group; `most` bounds a party's units.

    A party gets a unit for each of its quotients weight / (2 k + 1) among the highest. Its fair
    share, rounded, is never far from that: the rounded shares miss the seats by half the parties
    at most, so only the few quotients around a party's own share are listed and ranked, and the
    highest of them (or the lowest, if too many units are out) settle the rest. Ties go to the
    smaller key.
    """
    every = Window.partitionBy(*within)
    p = parties.withColumn("_seats", seats).withColumn("_total", F.sum(weight).over(every)).withColumn("_n", F.count("*").over(every))
    fair = F.when(F.col("_total") > 0, F.col(weight) / F.col("_total") * F.col("_seats")).otherwise(F.lit(0.0))
    p = p.withColumn("_fair", fair).withColumn("_round", F.floor(F.col("_fair") + 0.5))
    p = p.withColumn("_base", F.least(F.col("_round"), F.col(most)) if most else F.col("_round"))
    p = p.withColumn("_gap", F.when(F.col("_total") > 0, F.col("_seats") - F.sum("_base").over(every)).otherwise(F.lit(0)))
    reach = F.ceil(F.col("_fair") * F.col("_n") / F.greatest(F.col("_seats"), F.lit(1))) + 2 + F.sum(F.col("_round") - F.col("_base")).over(every)
    p = p.withColumn("_reach", F.least(F.abs("_gap"), reach))
    room = F.col(most) if most else F.lit(1 << 62)
    each = p.withColumn("_k", F.explode_outer(F.when(F.col("_reach") > 0, F.sequence(F.lit(0), F.col("_reach").cast("int") - 1))))
    more = F.col("_base") + F.col("_k")
    less = F.col("_base") - 1 - F.col("_k")
    able = F.when(F.col("_gap") > 0, more < room).otherwise(less >= 0) & F.col("_k").isNotNull()
    q = F.when(F.col("_gap") > 0, -F.col(weight) / (2 * more + 1)).otherwise(F.col(weight) / (2 * less + 1))
    each = each.withColumn("_q", F.when(able, q))
    # units are added to the smaller key first and taken from the larger one
    order = [F.col("_q").asc_nulls_last(), *[F.when(F.col("_gap") > 0, F.col(c)).asc_nulls_last() for c in key], *[F.col(c).desc() for c in key]]
    place = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
    each = each.withColumn("_won", (F.col("_q").isNotNull() & (place <= F.abs("_gap"))).cast("long"))
    dealt = each.groupBy(*parties.columns, "_base", "_gap").agg(F.sum("_won").alias("_won"))
    return dealt.select(*parties.columns, (F.col("_base") + F.signum(F.col("_gap").cast("double")).cast("long") * F.col("_won")).alias("quota"))


def _mark(seed: int) -> Column:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text))))


def quotas(sizes: DataFrame, share: float, blocks: int, rows_per_shard: int) -> tuple[DataFrame, DataFrame]:
    """(a row a source, a row a shard), written, from rows (source, mark, size, m): what each is due."""
    targets = source_targets(sizes, share)
    every = Window.partitionBy()
    total = F.sum("target").over(every)
    per_shard = F.sum("source_size").over(every) / F.sum("n_docs").over(every) * rows_per_shard
    block = F.greatest(F.lit(1.0), F.least(total / blocks, per_shard / BLOCKS_PER_SHARD))
    targets = targets.withColumn("block", block).withColumn("units", F.round(total / F.col("block")).cast("long"))
    targets = apportion(targets, ["sid"], F.col("units"), "target", [])
    shards = F.ceil(F.col("n_docs") / rows_per_shard).cast("int")
    targets = written(targets.withColumn("n_shards", shards).withColumn("n_groups", F.ceil(F.sqrt(shards)).cast("int")), "targets")

    parts = dealt(sizes, targets).groupBy("sid", "group", "shard").agg(F.sum(F.col("size") * F.col("m")).alias("words"))
    info = targets.select("sid", "block", "target", F.col("quota").alias("source_quota"))
    parts = parts.join(info, "sid").withColumn("most", F.ceil(2 * F.col("words") / F.col("block"))).withColumn("words", F.col("words").cast("double"))
    parts = written(parts, "parts")
    groups = parts.groupBy("sid", "group", "source_quota").agg(F.sum("words").alias("words"), F.sum("most").alias("most"))
    groups = apportion(groups, ["group"], F.col("source_quota"), "words", ["sid"], "most").select("sid", "group", F.col("quota").alias("group_quota"))
    parts = apportion(parts.join(groups, ["sid", "group"]), ["shard"], F.col("group_quota"), "words", ["sid", "group"], "most")
    largest = parts.groupBy("sid").agg(F.max(F.struct("words", "shard"))["shard"].alias("largest"))
    rest = F.when(F.col("shard") == F.col("largest"), F.col("target") - F.col("source_quota") * F.col("block")).otherwise(F.lit(0.0))
    due = F.least(F.greatest(F.col("quota") * F.col("block") + rest, F.lit(0.0)), 2 * F.col("words"))
    return targets, written(parts.join(largest, "sid").select("sid", "shard", "words", "quota", due.alias("due")), "shards")


def dealt(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """sizes with sid, block, shard and group of shards. How many sources there are is up to the data, so Spark decides how to join."""
    t = targets.select(F.col("source").alias("_s"), "sid", "block", "n_shards", "n_groups")
    rows = sizes.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    shard = F.pmod(F.xxhash64("mark"), F.col("n_shards")).cast("int")
    return rows.withColumn("shard", shard).withColumn("group", F.col("shard") % F.col("n_groups"))


def _planned(docs: DataFrame, share: float, seed: int, blocks: int, rows_per_shard: int) -> tuple[DataFrame, DataFrame]:
    """(source, doc_id, mark, size, m rows, copies of all of them), written, and the sources' targets; no texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words(F.col("text").cast("string"))).cast("long").alias("size"), _mark(seed).alias("mark"))
    sizes = rows.groupBy("source", "mark").agg(F.min("doc_id").alias("doc_id"), F.min("size").alias("size"), F.count("*").alias("m"))
    sizes = written(sizes, "sizes")
    targets, shards = quotas(sizes, share, blocks, rows_per_shard)
    p = dealt(sizes, targets).join(shards.select("sid", "shard", "words", "due"), ["sid", "shard"])
    group = Window.partitionBy("sid", "shard")
    p = p.withColumn("all", F.col("size") * F.col("m"))
    stream = group.orderBy("mark").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("block_no", F.floor((F.sum("all").over(stream) - F.col("all") / 2) / F.col("block")))
    p = p.withColumn("block_mark", F.md5(F.concat_ws("|", F.lit(f"{seed} block"), "source", "shard", "block_no")))
    full = F.when(F.col("words") > 0, F.floor(F.col("due") / F.col("words"))).otherwise(F.lit(0))
    p = p.withColumn("full", full).withColumn("rest", F.col("due") - F.col("full") * F.col("words"))
    taking = group.orderBy("block_mark", "block_no", "mark").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.coalesce(F.sum("all").over(taking), F.lit(0))
    fit = F.when((F.col("full") >= 2) | (left < 0), 0).when(F.col("size") == 0, F.col("m")).otherwise(F.least(F.col("m"), F.floor(left / F.col("size"))))
    p = p.withColumn("fit", fit)
    for reach in (1, 2):  # first the largest that fits, then the one that leaves the least difference
        p = p.withColumn("gap", F.col("rest") - F.sum(F.col("fit") * F.col("size")).over(group))
        fits = (F.col("fit") < F.col("m")) & (F.col("full") < 2) & (F.col("size") > 0) & (F.col("size") < reach * F.col("gap"))
        p = p.withColumn("fits", fits).withColumn("pick", F.min(F.when(F.col("fits"), F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "mark"))).over(group))
        p = p.withColumn("fit", F.col("fit") + (F.col("fits") & (F.col("pick.mark") == F.col("mark"))).cast("int"))
    return written(p.select("source", "sid", "doc_id", "mark", "size", "m", (F.col("full") * F.col("m") + F.col("fit")).alias("copies")), "plan"), targets


#: Rows that one array stands for when counted rows are listed again.
LISTED = 1 << 12


def mix_plan(docs: DataFrame, share: float = 1.5, seed: int = 17, blocks: int = BLOCKS, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, copies."""
    plan, targets = _planned(docs, share, seed, blocks, rows_per_shard)
    each, more = F.floor(F.col("copies") / F.col("m")), F.col("copies") % F.col("m")
    kinds = F.filter(F.array(F.struct(more.alias("rows"), (each + 1).alias("n")), F.struct((F.col("m") - more).alias("rows"), each.alias("n"))), lambda x: x["rows"] > 0)
    rows = plan.join(targets.select("sid", "source_size", "target"), "sid").withColumn("kind", F.explode(kinds))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), ((F.col("kind.rows") - 1) / LISTED).cast("int"))))
    rows = rows.withColumn("one", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(LISTED), F.col("kind.rows") - F.col("part") * LISTED).cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("kind.n")).cast("long").alias("taken"), F.col("kind.n").cast("int").alias("copies"))


def mixed(docs: DataFrame, share: float = 1.5, seed: int = 17, blocks: int = BLOCKS, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """The mix itself: each row of docs as often as the plan takes it, with all its columns."""
    plan, _ = _planned(docs, share, seed, blocks, rows_per_shard)
    rows = packed(docs, "doc_id", "text", "source").withColumn("mark", _mark(seed)).withColumn("src", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))).select("_row", "mark", "src")
    src = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    copies = plan.where("copies <> m").select("mark", src.alias("src"), "copies", "m")
    # rows of one mark are equal in doc_id, text and source; only those that repeat must be told apart
    many = written(plan.where("m > 1").select("mark", src.alias("src")), "many")
    seen = maybe_in(rows, F.xxhash64("mark", "src"), key_filter(many, F.xxhash64("mark", "src")))
    lone = seen.where("not _hit").select("_row", "mark", "src").withColumn("nth", F.lit(1).cast("long"))
    some = seen.where("_hit").select("_row", "mark", "src").withColumn("pid", F.spark_partition_id())
    some = written(some, "repeats")
    per = some.groupBy("mark", "src", "pid").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("mark", "src").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("mark", "src", "pid").orderBy(F.lit(0)))
    some = some.withColumn("in", inside).join(per, ["mark", "src", "pid"]).select("_row", "mark", "src", (F.col("before") + F.col("in")).alias("nth"))
    met = lone.unionByName(some).join(copies, ["mark", "src"], "left")
    n = F.when(F.col("copies").isNull(), F.lit(1)).otherwise(F.floor(F.col("copies") / F.col("m")) + (F.col("nth") <= F.col("copies") % F.col("m")).cast("int")).cast("int")
    met = met.withColumn("n", n).where("n > 0").withColumn("one", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return unpacked(met, docs.columns)
