"""Licence scan: sparse TF-IDF cosine to licence templates, then inheritance along directories.

A document is a file with a path. What is compared with the templates: each line of its whole text,
each run of neighbouring lines that mostly hold template terms (a header that wraps), and, in a
licence file (name LICENSE, COPYING and the like), the text as a whole. Terms are runs of letters
and digits, A-Z lower-cased, without the stop words; a term weighs tf * (1 + ln(N / df)) with df
counted over all documents. The licence is the template with the highest cosine, if it reaches the
threshold. A file without a licence of its own takes that of the nearest directory above it that
holds a licence file with one.

How: one pass counts df of the templates' terms. With these weights a second pass bounds each
part's cosine to each template, taking every other term at the least weight there is (1); only
parts that can reach the threshold leave their task, so the texts stay where they are and few short
rows move. A last pass counts df of the other terms of those parts alone. Inheritance joins
directories, not files: the distinct directories with their ancestors against the directories that
have a licence, then files with their own directory's answer. Only DataFrame functions are used.

Defined results: a null text has no lines; a null or empty path is the root directory; equal
cosines go to the licence that comes first by name; several licence files of a directory count by
cosine, then name; repeated rows are scanned alike, and each counts in N and df; a null doc_id is
kept; texts and lines of any length are compared whole; extra columns, whatever their names, are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import key_filter, maybe_in, written

THRESHOLD = 0.6
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|unlicense|notice)([._-].*)?$"
#: A line belongs to a run if so large a share of its terms are template terms.
RUN_SHARE = 1 / 3

#: Notices by which the licences are declared, and (-text) the texts of the short licences.
TEMPLATES = {
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "MIT-short": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License. Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-3-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS "
        "AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER "
        "IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}
#: Words that say nothing about a licence.
STOP = "a an and any as at be by for from in is it of on or the this that to with without you your not may use are s".split()


def term_list(text: Column) -> Column:
    """The terms of a text in order, with repeats."""
    parts = F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda x: (x != "") & ~x.isin(STOP))


def notice_terms(text: str) -> Counter:
    """term_list of a notice, counted; the notices are ASCII."""
    return Counter(x for x in re.findall(r"[a-z0-9]+", text.lower()) if x not in STOP)


def document_counts(files: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """(number of files, df of each term of a small vocabulary): one row a term reaches the driver."""
    has = files.select(F.array_distinct(F.filter(term_list(F.col("text")), lambda x: x.isin(vocabulary))).alias("terms"))
    rows = has.select(F.explode(F.concat("terms", F.array(F.lit("")))).alias("term")).groupBy("term").count().collect()  # "": every file
    df = {r["term"]: r["count"] for r in rows}
    return df.pop("", 0), df


def own_licences(files: DataFrame, threshold: float) -> DataFrame:
    """(row, name, licence, cosine): the best template of each file that reaches the threshold.

    files has row (a key), name (the file's own name) and text (not null).
    """
    spark = files.sparkSession
    notices = {name: notice_terms(text) for name, text in TEMPLATES.items()}
    vocabulary = sorted({t for c in notices.values() for t in c})
    n, df = document_counts(files, vocabulary)
    idf = lambda d: 1 + math.log(max(n, 1) / max(d, 1))
    weight = {t: idf(df.get(t, 0)) for t in vocabulary}
    rows = []
    for name, c in notices.items():
        norm = math.sqrt(sum((k * weight[t]) ** 2 for t, k in c.items()))
        rows += [(name, t, k * weight[t] / norm) for t, k in c.items()]

    known = F.create_map(*[F.lit(x) for t in vocabulary for x in (t, weight[t])])
    of_template = {name: F.create_map(*[F.lit(x) for m, t, w in rows if m == name for x in (t, w)]) for name in notices}

    once = lambda df, **c: df.select("*", F.inline_outer(F.array(F.struct(*[v.alias(k) for k, v in c.items()]))))
    in_vocabulary = lambda c: F.filter(c, lambda x: x.isin(vocabulary))

    def bounded(parts: DataFrame) -> DataFrame:
        """The parts (list, hits: its template terms) whose cosine can reach the threshold: other terms weigh 1 at least, and come once each."""
        tf = F.transform(F.array_distinct("hits"), lambda t: F.struct(t.alias("t"), (F.size(F.filter("hits", lambda x: x == t)) * F.element_at(known, t)).alias("w")))
        parts = once(parts, tf=tf, others=F.size(F.array_distinct("list")) - F.size(F.array_distinct("hits")))
        parts = once(parts, own=F.aggregate("tf", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
        parts = parts.where(F.col("own") >= threshold**2 * (F.col("own") + F.col("others")))
        dot = lambda m: F.aggregate("tf", F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.element_at(m, x["t"]), F.lit(0.0)))
        parts = once(parts, best=F.greatest(*[dot(m) for m in of_template.values()]))
        return parts.where(F.col("best") >= (threshold - 1e-6) * F.sqrt(F.col("own") + F.col("others"))).select("row", "part", "list")

    is_file = F.coalesce(F.col("name"), F.lit("")).rlike(LICENCE_FILE)
    lines = files.select("row", F.posexplode(F.split("text", "\n")).alias("line", "part"))
    lines = once(lines, list=term_list(F.col("part"))).drop("part")
    lines = written(once(lines, hits=in_vocabulary("list")).where(F.size("hits") > 0), "lines")  # few of all, so the texts are split once
    alone = bounded(lines.select("row", F.col("line").alias("part"), "list", "hits"))
    # neighbouring lines of mostly template terms; their numbers are negative
    dense = lines.where(F.size("hits") >= RUN_SHARE * F.size("list"))
    dense = dense.withColumn("run", F.col("line") - F.row_number().over(Window.partitionBy("row").orderBy("line")))
    joined = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line", c))), lambda x: x[c])).alias(c)
    runs = dense.groupBy("row", "run").agg(F.min("line").alias("line"), joined("list"), joined("hits"), F.count("*").alias("lines"))
    runs = bounded(runs.where("lines > 1").select("row", (-1 - F.col("line")).alias("part"), "list", "hits"))
    whole = once(files.where(is_file & F.col("text").contains("\n")).select("row", F.lit(1 << 30).alias("part"), "text"), list=term_list(F.col("text")))
    whole = once(whole, hits=in_vocabulary("list")).where(F.size("hits") > 0)
    parts = written(alone.unionByName(runs).unionByName(bounded(whole)), "parts")

    each = parts.select("row", "part", F.explode("list").alias("term")).groupBy("row", "part", "term").agg(F.count("*").alias("tf"))
    strange = written(each.where(~F.col("term").isin(vocabulary)).select("term").distinct(), "strange")
    terms = files.select(F.explode(F.array_distinct(term_list(F.col("text")))).alias("term"))
    terms = maybe_in(terms, F.xxhash64("term"), key_filter(strange, F.xxhash64("term"))).where("_hit").groupBy("term").agg(F.count("*").alias("df"))
    of_known = spark.createDataFrame([(t, w) for t, w in weight.items()], "term string, idf double")
    idfs = terms.join(strange, "term", "left_semi").select("term", (1 + F.log(F.lit(float(max(n, 1))) / F.col("df"))).alias("idf")).unionByName(of_known)
    weighed = each.join(idfs, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = weighed.groupBy("row", "part").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    templates = F.broadcast(spark.createDataFrame(rows, "template string, term string, tw double"))  # the fixed templates
    dots = weighed.join(templates, "term").groupBy("row", "part", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norm, ["row", "part"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= threshold)
    scored = scored.withColumn("licence", F.regexp_replace("template", "-(short|text)$", ""))
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "licence", "part")).alias("b")
    return scored.groupBy("row").agg(best).select("row", "b.licence", (-F.col("b.c")).alias("cosine"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def licences(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, licence, cosine, origin (own, inherited, none), inherited_from; files has doc_id, path, text."""
    path = F.coalesce(F.col("path"), F.lit(""))
    files = files.select("doc_id", path.alias("path"), F.col("text").cast("string").alias("text")).withColumn("name", F.regexp_extract("path", "[^/]*$", 0))
    files = files.withColumn("row", F.sha2(F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("path"), F.coalesce("text", F.lit("-"))), 256))
    own = own_licences(files.select("row", "name", F.coalesce("text", F.lit("")).alias("text")), threshold)
    rows = written(files.select("row", "doc_id", "path", "name"), "files").join(written(own, "own"), "row", "left")
    rows = rows.withColumn("dir", directory(F.col("path")))
    of_dir = rows.where(F.col("name").rlike(LICENCE_FILE) & F.col("licence").isNotNull()).groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"))
    of_dir = of_dir.select(F.col("dir").alias("above"), F.col("b.licence").alias("dir_licence"), (-F.col("b.c")).alias("dir_cosine"))
    # each directory's ancestors, itself first
    steps = F.split("dir", "/")
    depth = F.size(steps)
    above = F.transform(F.sequence(F.lit(0), depth - 1), lambda i: F.struct(i.alias("up"), F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.size(F.split("dir", "/")) - i), "/").alias("above")))
    dirs = rows.select("dir").distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.up", "a.above")
    root = rows.select("dir").distinct().where("dir <> ''").select("dir", F.size(F.split("dir", "/")).alias("up"), F.lit("").alias("above"))
    dirs = dirs.unionByName(root).dropDuplicates(["dir", "above"])
    near = dirs.join(of_dir, "above").groupBy("dir").agg(F.min(F.struct("up", "above", "dir_licence", "dir_cosine")).alias("n"))
    both = rows.join(near, "dir", "left")
    mine = F.col("licence").isNotNull()
    taken = ~mine & F.col("n").isNotNull()
    return both.select(
        "doc_id", "path", F.coalesce("licence", "n.dir_licence").alias("licence"), F.coalesce("cosine", "n.dir_cosine").alias("cosine"),
        F.when(mine, "own").when(taken, "inherited").otherwise("none").alias("origin"), F.when(taken, F.col("n.above")).alias("inherited_from"),
    )


def laid_out(docs: DataFrame) -> DataFrame:
    """documents as files: /source/lang/<doc_id div 1000>/<doc_id>.txt, every 50th the LICENSE of its directory, every 1000th that of its language."""
    top = F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")))
    inner = F.concat_ws("/", top, F.floor(F.col("doc_id") / 1000).cast("string"))
    path = F.when(F.col("doc_id") % 1000 == 0, F.concat(top, F.lit("/LICENSE"))).when(F.col("doc_id") % 50 == 0, F.concat(inner, F.lit("/LICENSE"))).otherwise(F.concat(inner, F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), F.col("text"))
