"""Quality rules: base counts, then a hashed n-gram likelihood ratio against a trusted target.

Words are [^\\x20\\x09-\\x0D]+ of the whole text. Base counts: n_words, word_chars (code points in
words), n_symbols (characters of [#*$%&|<>]), n_dup_lines (lines with a word that equal an earlier
line), n_repeat_words (words in 3-word windows found twice or more). base_failed: fewer than 50
words, or more than half of them repeated.

Method: every word and every pair of neighbouring words is hashed to one of 65536 buckets. The
multinomial of the raw corpus (add-one smoothing) and that of the trusted documents (smoothed with
the raw corpus, which counts as PRIOR n-grams a bucket, at most twice the target itself: few trusted rows say little), both
over all rows, give each bucket log p(target) - log p(raw), rounded to 1/1000. A document's score is
the sum over its n-grams divided by their number; it is kept if the score reaches the threshold, a
fixed number of nats per n-gram, so the verdict on a document depends on nothing but its text and
the two multinomials, and integer sums make reruns agree.

All is done with DataFrame functions. Per-document work stays in one row (no shuffle of texts);
only bucket counts move. Words are hashed once; pairs and windows hash their hashes. Repeated windows
are found, where any hash occurs twice, by sorting 64-bit numbers (hash and position); neighbours with equal hashes are compared as strings, and a document in which a hash
deceives, or that has over two million words, is sorted by the windows' strings instead.

Defined results: a null text has no words, fails the base rules and is not kept; without trusted
rows every score is 0 and the base rules decide; repeated rows are judged alike; repeated trusted
ids count once; a null doc_id is never trusted; texts of any length are one row; extra columns,
whatever their names, are ignored by `quality` and kept by `keep_good`; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import SPACES, key_filter, maybe_in, packed, unpacked, words, written

BUCKETS = 1 << 16
#: N-grams that the raw corpus counts for in the target's multinomial: so many a bucket, and so many times the target's own at most.
PRIOR, PRIOR_SHARE = 4, 2
#: Nats per n-gram below which a document is rejected.
THRESHOLD = -0.15
SCALE = 1000
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
POSITION_BITS = 21


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each computed once a row.

    A one-row generator keeps Catalyst from folding them into later expressions, where a lambda
    would compute an array anew for each element, or into filters pushed below.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _repeat_words() -> list[tuple[str, str]]:
    """Steps (column, SQL) from `w` (words) and `wh` (their hashes) to `n_repeat_words`."""
    mask = (1 << POSITION_BITS) - 1
    keyed = f"transform(h3, (x, i) -> (x & {~mask}L) | i)"
    near = lambda a, x, same: f"filter({a}, ({x}, j) -> (j > 0 AND {same(f'{a}[greatest(j - 1, 0)]', x)}) OR (j < size({a}) - 1 AND {same(x, f'{a}[least(j + 1, size({a}) - 1)]')}))"
    by_hash = lambda x, y: f"shiftright({x}, {POSITION_BITS}) = shiftright({y}, {POSITION_BITS})"
    at = lambda x: f"cast({x} & {mask}L as int)"
    differ = " OR ".join(f"w[{at('rep[j]')} + {k}] <> w[{at('rep[j - 1]')} + {k}]" for k in range(3))
    by_text = lambda x, y: f"{x}.a = {y}.a AND {x}.b = {y}.b AND {x}.c = {y}.c"
    return [
        ("h3", "CASE WHEN size(w) > 3 THEN transform(sequence(0, size(w) - 3), i -> xxhash64(wh[i], wh[i + 1], wh[i + 2])) ELSE array(cast(null as bigint)) END"),
        ("win", f"CASE WHEN size(w) <= {mask} AND size(array_distinct(h3)) < size(h3) THEN sort_array({keyed}) ELSE array(cast(null as bigint)) END"),
        ("rep", f"CASE WHEN size(win) > 1 THEN {near('win', 'x', by_hash)} ELSE array(cast(null as bigint)) END"),
        ("odd", f"size(w) > {mask} OR (size(rep) > 1 AND exists(sequence(1, size(rep) - 1), j -> {by_hash('rep[j]', 'rep[j - 1]')} AND ({differ})))"),
        ("strs", "CASE WHEN odd AND size(w) > 3 THEN sort_array(transform(sequence(0, size(w) - 3), i -> named_struct('a', w[i], 'b', w[i + 1], 'c', w[i + 2], 'i', i))) END"),
        ("pos", f"CASE WHEN odd THEN sort_array(transform({near('strs', 'x', by_text)}, x -> x.i)) WHEN size(rep) > 1 THEN sort_array(transform(rep, x -> {at('x')})) ELSE array(cast(null as int)) END"),
        ("n_repeat_words", "cast(CASE WHEN size(pos) < 2 THEN 0 ELSE 3 + aggregate(sequence(1, size(pos) - 1), 0, (s, j) -> s + least(3, pos[j] - pos[j - 1])) END as bigint)"),
    ]


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with its words `w`, their hashes `wh` and the base columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    df = staged(docs, w=words(F.col("text").cast("string")), _lines=lines)
    df = df.withColumns({
        "n_words": F.size("w").cast("long"),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })
    df = staged(df, wh=F.expr(WORD_HASHES))
    for name, sql in _repeat_words():
        df = staged(df, **{name: F.expr(sql)})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("_lines", "h3", "win", "rep", "odd", "strs", "pos")


WORD_HASHES = "transform(w, x -> xxhash64(x))"
GRAMS = f"concat(transform(wh, x -> cast(pmod(x, {BUCKETS}) as int)), CASE WHEN size(wh) > 1 THEN transform(sequence(1, size(wh) - 1), i -> cast(pmod(xxhash64(wh[i - 1], wh[i]), {BUCKETS}) as int)) ELSE array(cast(null as int)) END)"


def with_grams(df: DataFrame) -> DataFrame:
    """df with `grams`, the buckets of its words (hashes `wh`) and of its neighbouring words."""
    return staged(df, grams=F.expr(GRAMS))


def log_ratios(docs: DataFrame, trusted: DataFrame | None) -> list[int]:
    """Per bucket log p(target) - log p(raw) in 1/SCALE; all 0 without trusted documents.

    What reaches the driver is one row a bucket, BUCKETS at most.
    """
    if trusted is None:
        return [0] * BUCKETS
    ids = trusted.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    ids = written(ids, "trusted")
    # a filter of fixed size lets texts lie where they are; only those that may be trusted meet the ids
    seen = maybe_in(rows, F.xxhash64("_id"), key_filter(ids, F.xxhash64("_id")))
    met = seen.where("_hit").drop("_hit").join(ids.withColumn("_good", F.lit(1)).hint("merge"), "_id", "left")  # one plan at every size
    rows = seen.where("not _hit").drop("_hit").withColumn("_good", F.lit(None).cast("int")).unionByName(met)
    rows = staged(rows, w=words(F.col("text").cast("string")))
    rows = with_grams(staged(rows, wh=F.expr(WORD_HASHES)))
    each = rows.select(F.coalesce("_good", F.lit(0)).alias("good"), F.explode_outer("grams").alias("g")).where("g is not null")
    counts = each.groupBy("g").agg(F.count("*").alias("n"), F.sum("good").alias("good")).collect()
    raw, good = [1] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r.g] += r.n
        good[r.g] += r.good
    return ratios(raw, good)


def ratios(raw: list[int], good: list[int]) -> list[int]:
    """Log ratios from the buckets' counts, raw ones with one added."""
    all_raw, all_good = sum(raw), sum(good)
    prior = min(PRIOR * len(raw), PRIOR_SHARE * all_good)
    if not all_good:
        return [0] * len(raw)
    return [round(SCALE * (math.log((g + prior * r / all_raw) / (all_good + prior)) - math.log(r / all_raw))) for g, r in zip(good, raw, strict=True)]


def score(found: list[int]) -> Column:
    """Mean log ratio of the n-grams in `grams`, 0 without any."""
    table = F.lit(np.array(found, dtype=np.int32))  # one literal, not BUCKETS expressions
    real = F.size("w") + F.greatest(F.size("w") - 1, F.lit(0))
    total = F.aggregate("grams", F.lit(0).cast("long"), lambda s, g: s + F.when(g.isNull(), 0).otherwise(F.get(table, g)))
    return F.when(real > 0, total / (SCALE * real)).otherwise(F.lit(0.0))


def judged(docs: DataFrame, trusted: DataFrame | None, threshold: float) -> DataFrame:
    found = log_ratios(docs, trusted)
    df = with_grams(base_counts(docs))
    df = staged(df, score=score(found)).drop("grams", "w", "wh")
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def quality(docs: DataFrame, trusted: DataFrame | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, score, kept; one row per row of docs."""
    df = judged(docs.select("doc_id", "text"), trusted, threshold)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def keep_good(docs: DataFrame, trusted: DataFrame | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    return unpacked(judged(packed(docs, "doc_id", "text"), trusted, threshold).where("kept"), docs.columns)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled as good."""
    return labels.where("quality = 1").select("doc_id")
