"""Curation of edges: override rules and their report, and global numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.sources.tables import kept

#: Rows of a range that are numbered in one task; more ranges than asked for are not made.
RANGE_ROWS = 20_000


def invalid_rules(rules: list[dict], predicates: set[str]) -> list[str]:
    """What is wrong with override rules (action, subject, predicate, object, note), one line each."""
    bad = []
    for i, r in enumerate(rules):
        what = f"rule {i} ({r.get('action')} {r.get('subject')} {r.get('predicate')} {r.get('object')})"
        if r.get("action") not in ("add", "drop"):
            bad.append(f"{what}: unknown action")
        if r.get("predicate") not in predicates:
            bad.append(f"{what}: unknown predicate")
        if not r.get("subject"):
            bad.append(f"{what}: no subject")
        if r.get("action") == "add" and not r.get("object"):
            bad.append(f"{what}: an added edge needs an object")
        if not r.get("note"):
            bad.append(f"{what}: no note says why")
    return bad


def apply_overrides(edges: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, report): edges (s, p, o) without the dropped ones (o null in a rule: any object), with the added ones.

    The report has each rule with `matches`; a drop without any is stale. An added edge that is
    there already stays single.
    """
    drops = rules.where("action = 'drop'")
    exact = drops.where("o is not null").select("s", "p", "o").distinct()
    wild = drops.where("o is null").select("s", "p").distinct()
    left = edges.join(F.broadcast(exact), ["s", "p", "o"], "left_anti").join(F.broadcast(wild), ["s", "p"], "left_anti").select(edges.columns)
    added = rules.where("action = 'add'").select("s", "p", "o").distinct()
    new = added.join(left.join(F.broadcast(added), ["s", "p", "o"], "left_semi").select("s", "p", "o"), ["s", "p", "o"], "left_anti")
    named = rules.select(F.col("s").alias("es"), F.col("p").alias("ep")).distinct()
    e = edges.select(F.col("s").alias("es"), F.col("p").alias("ep"), F.col("o").alias("eo")).join(F.broadcast(named), ["es", "ep"], "left_semi")  # rules are written by hand
    met = rules.join(e, (F.col("s") == F.col("es")) & (F.col("p") == F.col("ep")) & (F.col("o").isNull() | (F.col("o") == F.col("eo"))), "left")
    report = met.groupBy("action", "s", "p", "o").agg(F.when(F.first("action") == "add", F.lit(1)).otherwise(F.count("es")).alias("matches"))
    return left.unionByName(new, allowMissingColumns=True), report


def numbered(rows: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """rows with n, their number from 0 in order of a key.

    Rows are dealt into ranges of the key, `buckets` at most, sorted there and written once; the
    ranges' sizes are summed up, so no task sees more than a range and no row is compared with
    bounds one by one. A poor sample makes uneven ranges, never other numbers.
    """
    ranges = max(1, min(buckets, -(-rows.count() // RANGE_ROWS)))
    placed = kept(rows.repartitionByRange(ranges, key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    cut = placed.withColumn("_b", F.shiftright("_at", 33))  # the range, and below it the place there
    sizes = cut.groupBy("_b").agg(F.count("*").alias("_c"))
    start = kept(sizes.withColumn("_from", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c"))
    return cut.join(F.broadcast(start), "_b").withColumn("n", F.col("_from") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_b", "_at", "_from")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, n): the distinct values of a small dictionary (predicates, fields), numbered by their first appearance in `order`."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_at"))
    return first.select(key, (F.row_number().over(Window.orderBy("_at", key)) - 1).alias("n"))
