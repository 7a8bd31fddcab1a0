"""Substring deduplication by hashing lines, and, if asked, the sentences and stretches in them.

A unit is a line. Units are normalised (A-Z lower-cased, white space collapsed) and hashed to 128
bits, two independent hashes of 64. All units are grouped by digest over the whole corpus; the
occurrence that ranks first (least doc_id, then position) is kept, all others are repeats and go.
The spans removed are given as byte offsets into the original text.

With `sentences` a line is cut further, after each word that ends in . ! or ?, so that a passage
pasted into another line is found by the units inside it. Neighbouring repeats of a document form a
run, and only runs of at least `min_words` words go (1 by default: all).

With `stretches`, passages that share no whole unit are found too: of every WINDOW neighbouring
stretches of STRETCH words, over lines and sentences, the one of least hash is taken as well (all of
them if several are least), and removed like a unit if an earlier place has it and does not overlap
it. What is taken depends on the words only, so any WINDOW + STRETCH - 1 words (39) that two places
share hold a stretch taken at both, and of a longer shared run WINDOW - 1 words at either end stay at
most. Words are what white space parts, so a script without spaces has no stretches.

How: texts never move for the search. One pass hashes units and counts digests (a row a unit, no
text); digests that repeat make a filter of bounded size; a second pass lets only such units through
and joins them with the first occurrence, hot digests dealt over several tasks.

Defined results: null and empty texts have no units; rows that repeat a doc_id and its text are one
occurrence and are treated alike; a null doc_id ranks before all others; of equal ranks (one doc_id
with several texts) the smaller text hash comes first; texts of any length are read whole, those
over a megabyte in pieces; extra columns, whatever their names, are ignored by `repeated_spans` and
kept by `without_repeats`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm import tokens as tk
from lorekeep.llm.common import hot_keys, key_filter, maybe_in, packed, skew_join, unpacked, written

#: Words of a stretch, and how many neighbouring stretches give at least one.
STRETCH, WINDOW = 20, 20
#: nth is null for a stretch; word is the number of the first word in its document.
UNIT_SCHEMA = "doc_id long, doc_hash long, nth long, word long, start long, end long, n_words long, h1 long, h2 long"

ENDS_SENTENCE = np.zeros(256, bool)
ENDS_SENTENCE[[ord(c) for c in ".!?"]] = True
NEWLINE = np.arange(256) == 10


def taken(h: np.ndarray, g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, h1, h2) of the stretches taken from words of hashes h and g."""
    n = len(h) - STRETCH - WINDOW + 2
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    up, down = tk.powers(len(h))

    def over(x: np.ndarray) -> np.ndarray:
        sums = np.r_[np.uint64(0), np.cumsum(x * up)]
        return tk.mix((sums[STRETCH:] - sums[:-STRETCH]) * down[: len(h) - STRETCH + 1] ^ tk.seed(701))

    v = over(h)
    least = v[:n].copy()
    for k in range(1, WINDOW):
        np.minimum(least, v[k : k + n], out=least)
    whole = doc[:n] == doc[STRETCH + WINDOW - 2 :]
    some = np.zeros(len(v), bool)
    for k in range(WINDOW):
        some[k : k + n] |= whole & (v[k : k + n] == least)
    at = np.flatnonzero(some)
    return at, v[at], over(g)[at]


def units_of(w: tk.Words, sentences: bool) -> dict[str, np.ndarray]:
    """The units of some texts: doc, nth in it, first word in it, start and end byte in it, n_words, h1, h2."""
    lines = np.r_[0, np.cumsum(w.data == 10)]
    new = np.r_[True, w.doc[1:] != w.doc[:-1]]
    new[1:] |= lines[w.start[1:]] != lines[w.end[:-1]]
    if sentences:
        new[1:] |= ENDS_SENTENCE[w.data[w.end[:-1] - 1]]
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(w.doc)])
    up, _ = tk.powers(int(n.max()))
    place = up[np.arange(len(w.doc)) - np.repeat(first, n)]
    opens = tk.group_starts(w.doc[first])
    nth = np.arange(len(first)) - np.repeat(opens, np.diff(np.r_[opens, len(first)]))
    h1 = tk.mix(np.add.reduceat(w.hashes() * place, first))
    h2 = tk.mix(np.add.reduceat(w.second_hashes() * place, first) ^ n.astype(np.uint64))
    return places(w, first, n) | {"nth": nth, "h1": h1, "h2": h2}


def stretches_of(w: tk.Words) -> dict[str, np.ndarray]:
    """The stretches taken of some texts, as units_of has them, with nth -1."""
    at, h1, h2 = taken(w.hashes(), w.second_hashes(), w.doc)
    return places(w, at, np.full(len(at), STRETCH)) | {"nth": np.full(len(at), -1), "h1": h1, "h2": h2}


def places(w: tk.Words, first: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    doc = w.doc[first]
    word = first - (np.cumsum(w.count) - w.count)[doc]
    return {"doc": doc, "word": word, "start": w.start[first] - w.off[doc], "end": w.end[first + n - 1] - w.off[doc], "n_words": n}


def pieces_of(data: np.ndarray, sentences: bool, stretches: bool) -> Iterator[dict[str, np.ndarray]]:
    """The same of one long text, piece by piece: units in pieces of whole lines, stretches in pieces that overlap."""
    nth = word = at = 0
    while at < len(data):
        end = min(len(data), at + tk.CHUNK_BYTES)
        cuts = np.flatnonzero(NEWLINE[data[at:end]])
        if end < len(data):  # up to the last line that ends here, or else the whole line
            more = len(data) if len(cuts) else next((k + int(np.argmax(x)) + 1 for k in range(end, len(data), tk.CHUNK_BYTES) if (x := NEWLINE[data[k : k + tk.CHUNK_BYTES]]).any()), len(data))
            end = at + int(cuts[-1]) + 1 if len(cuts) else more
        w = tk.Words(data[at:end], np.array([0, end - at]), tk.SPACE, lower=True)
        if len(w.doc):
            u = units_of(w, sentences)
            for key, by in (("nth", nth), ("word", word), ("start", at), ("end", at)):
                u[key] = u[key] + by
            yield u
            nth, word = int(u["nth"][-1]) + 1, word + len(w.doc)
        at = end
    word, seen = 0, -1
    for at, w in tk.long_text(data, tk.SPACE, True, STRETCH + WINDOW - 2) if stretches else ():
        u = stretches_of(w)
        for key, by in (("word", word), ("start", at), ("end", at)):
            u[key] = u[key] + by
        fresh = ~np.isin(u["word"], seen)
        yield {k: v[fresh] for k, v in u.items()}
        seen, word = u["word"], word + max(0, len(w.doc) - (STRETCH + WINDOW - 2))


def unit_maker(sentences: bool, stretches: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in tk.chunks(batch.column("text")):
                if j - i == 1 and len(data) > tk.CHUNK_BYTES:
                    found = pieces_of(data, sentences, stretches)
                else:
                    w = tk.Words(data, off, tk.SPACE, lower=True)
                    found = [units_of(w, sentences), *([stretches_of(w)] if stretches else [])] if len(w.doc) else []
                for u in found:
                    rows = pa.array(u["doc"] + i)
                    longs = [pa.array(u[c].astype(np.int64)) for c in ("word", "start", "end", "n_words")]
                    hashes = [pa.array(u[c].view(np.int64)) for c in ("h1", "h2")]
                    nth = pa.array(u["nth"].astype(np.int64), mask=u["nth"] < 0)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("doc_hash").take(rows), nth, *longs, *hashes], names=[c.split(" ")[0] for c in UNIT_SCHEMA.split(", ")])

    return run


def units(docs: DataFrame, sentences: bool = False, stretches: bool = False) -> DataFrame:
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("doc_hash"), text.alias("text"))
    return rows.mapInArrow(unit_maker(sentences, stretches), UNIT_SCHEMA)


def _spans(docs: DataFrame, min_words: int, sentences: bool, stretches: bool) -> DataFrame:
    """(doc_id, doc_hash, spans, n_units_removed, words_removed) of the documents that lose something; written."""
    key = ["h1", "h2"]
    rank = F.struct("doc_id", "doc_hash", "start", "end")
    groups = units(docs, sentences, stretches).groupBy(*key).agg(F.count("*").alias("n"), F.min(rank).alias("first")).where("n > 1")
    groups = written(groups, "repeats")
    at = F.xxhash64(*key)
    some = maybe_in(units(docs, sentences, stretches), at, key_filter(groups, at)).where("_hit").drop("_hit")
    met = skew_join(some, groups.select(*key, "first"), key, F.struct("doc_id", "start"), hot_keys(groups, key, "n"))
    apart = ~F.struct("doc_id", "doc_hash").eqNullSafe(F.struct("first.doc_id", "first.doc_hash")) | (F.col("start") >= F.col("first.end"))
    again = met.where(apart).drop("first").distinct()
    one = Window.partitionBy("doc_id", "doc_hash")
    of_units = again.where("nth is not null").withColumn("run", F.col("nth") - F.row_number().over(one.orderBy("nth")))
    extent = [F.min("word").alias("word"), F.max(F.col("word") + F.col("n_words")).alias("to"), F.min("start").alias("start"), F.max("end").alias("end")]
    runs = of_units.groupBy("doc_id", "doc_hash", "run").agg(*extent, F.sum("n_words").alias("words"), F.count("*").alias("units")).where(F.col("words") >= min_words).drop("run")
    if stretches:
        more = again.where("nth is null and n_words >= %d" % min_words).select("doc_id", "doc_hash", "word", (F.col("word") + F.col("n_words")).alias("to"), "start", "end", F.lit(1).cast("long").alias("units"))
        both = runs.drop("words").unionByName(more)
        before = F.max("to").over(one.orderBy("word").rowsBetween(Window.unboundedPreceding, -1))
        both = both.withColumn("apart", F.coalesce(F.col("word") > before, F.lit(True)).cast("int"))
        both = both.withColumn("run", F.sum("apart").over(one.orderBy("word").rowsBetween(Window.unboundedPreceding, 0)))
        whole = both.groupBy("doc_id", "doc_hash", "run").agg(F.min("word").alias("word"), F.max("to").alias("to"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("units").alias("units"))
        runs = whole.withColumn("words", (F.col("to") - F.col("word")).cast("long"))
    spans = F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")
    return written(runs.groupBy("doc_id", "doc_hash").agg(spans, F.sum("units").alias("n_units_removed"), F.sum("words").alias("words_removed")), "spans")


def repeated_spans(docs: DataFrame, min_words: int = 1, sentences: bool = False, stretches: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_units_removed (units and stretches), words_removed, bytes_removed, spans (start, end in bytes)."""
    found = _spans(docs, min_words, sentences, stretches).withColumnsRenamed({"doc_id": "_d", "doc_hash": "_h"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("doc_hash"))
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("doc_hash") == F.col("_h")), "left")
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return both.select("doc_id", F.coalesce("n_units_removed", F.lit(0)).alias("n_units_removed"), F.coalesce("words_removed", F.lit(0)).alias("words_removed"), F.coalesce(gone, F.lit(0)).alias("bytes_removed"), F.coalesce("spans", none).alias("spans"))


def without_repeats(docs: DataFrame, min_words: int = 1, sentences: bool = False, stretches: bool = False) -> DataFrame:
    """docs with the spans cut out of their texts; all columns stay."""
    found = _spans(docs, min_words, sentences, stretches).select(F.col("doc_id").alias("_d"), F.col("doc_hash").alias("_dh"), F.col("spans").alias("_spans"))
    rows = packed(docs, "doc_id", "text").select("_row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("_hash", F.xxhash64("text"))
    seen = maybe_in(rows, F.xxhash64("_hash"), key_filter(found, F.xxhash64("_dh")))
    some = seen.where("_hit")
    met = some.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_dh")), "left")
    raw = F.col("text").cast("binary")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.col("_spans.end"))
    begins = F.concat(F.col("_spans.start"), F.array(F.octet_length(raw).cast("long")))
    parts = F.transform(F.zip_with(ends, begins, lambda e, b: F.struct(e.alias("e"), b.alias("b"))), lambda x: F.substring(raw, (x["e"] + 1).cast("int"), (x["b"] - x["e"]).cast("int")).cast("string"))
    cut = met.withColumn("_row", F.when(F.col("_spans").isNull(), F.col("_row")).otherwise(F.col("_row").withField("text", F.array_join(parts, ""))))
    return unpacked(seen.where("not _hit").select("_row").unionByName(cut.select("_row")), docs.columns)
