"""Title channel, rank fusion, diversifying, and packing of context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TITLE_COVERAGE = 0.6


def title_coverage(questions: DataFrame, names: DataFrame, least: float = TITLE_COVERAGE, pages: int | None = 4, among: DataFrame | None = None) -> DataFrame:
    """(qid, page_id, coverage, hits, aliases, rank): pages that a question names.

    questions (qid, terms); names (page_id, terms): a row for the title and each alias. The share
    of a name's terms that the question holds counts, the best name of a page wins; then more
    hits, then more names, then the smaller page_id. With `among` (qid, page_id), the pages that a
    recall step let through, only these are looked at; without, all that share a term with a question.
    """
    n_names = names.groupBy("page_id").agg((F.count("*") - 1).alias("aliases"))
    order = [F.col("aliases").desc(), F.col("page_id")]
    by = [F.col("coverage").desc(), F.col("hits").desc(), *order]
    asked = questions.select("qid", F.explode("terms").alias("term")).distinct()
    named = names.where(F.size("terms") > 0).select("page_id", F.array_sort(F.array_distinct("terms")).alias("name"))
    if among is not None:  # a bounded number of pages a question, so common words of titles make no more rows than that
        words = named.select("page_id", "name", F.size("name").alias("size"), F.explode("name").alias("term"))
        met = words.join(among, "page_id").join(asked, ["qid", "term"]).groupBy("qid", "page_id", "name", "size").agg(F.count("*").alias("hits"))
        best = met.groupBy("qid", "page_id").agg(F.max(F.struct((F.col("hits") / F.col("size")).alias("coverage"), "hits")).alias("b"))
        best = best.select("qid", "page_id", "b.coverage", "b.hits").where(F.col("coverage") >= least).join(n_names, "page_id")
    else:
        # equal sets of terms are compared once: sets of questions with sets of names, then told to who has them
        sets = asked.groupBy("qid").agg(F.array_sort(F.collect_set("term")).alias("q"))
        words = named.select("name").distinct().select("name", F.size("name").alias("size"), F.explode("name").alias("term"))
        met = words.join(sets.select("q").distinct().select("q", F.explode("q").alias("term")), "term").groupBy("q", "name", "size").agg(F.count("*").alias("hits"))
        met = met.select("q", "name", (F.col("hits") / F.col("size")).alias("coverage"), "hits").where(F.col("coverage") >= least)
        held = named.distinct().join(n_names, "page_id")
        if pages:  # no other page of a name can be among a question's first: these come before it, by this name or a better one
            held = held.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy(*order))).where(F.col("nth") <= pages).drop("nth")
        first = met.join(held, "name").groupBy("q", "page_id", "aliases").agg(F.max(F.struct("coverage", "hits")).alias("b")).select("q", "page_id", "aliases", "b.coverage", "b.hits")
        if pages:
            first = first.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*by))).where(F.col("rank") <= pages).drop("rank")
        best = sets.join(first, "q").select("qid", "page_id", "coverage", "hits", "aliases")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*by)))
    return best.where(F.col("rank") <= pages) if pages else best


def lead_chunks(chunks: DataFrame, per_page: int, kinds: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """chunks with slot (1..per_page) inside each page (or `by`): infobox, summary, body, then by ordinal."""
    kind_rank = F.when(F.col("kind") == "infobox", 0).when(F.col("kind") == "summary", 1).otherwise(2)
    rows = chunks.where(F.col("kind").isin(kinds)) if kinds else chunks
    slot = F.row_number().over(Window.partitionBy(*(by or ["page_id"])).orderBy(kind_rank, "ordinal", "chunk_id"))
    return rows.withColumn("slot", slot).where(F.col("slot") <= per_page)


def round_robin(rows: DataFrame, by: list[str], slot: str, rank: str, limit: int | None = None) -> DataFrame:
    """rows with `position`: every party's first, then every party's second, and so on."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(slot, rank))
    rows = rows.withColumn("position", n)
    return rows.where(F.col("position") <= limit) if limit else rows


def rrf(rankings: DataFrame, channels: list[tuple[str, float, int]], id_col: str = "chunk_id") -> DataFrame:
    """(qid, id, score, rank and each channel's rank): weighted reciprocal rank fusion.

    rankings (qid, channel, id, rank); channels (name, weight, k) in order: equal scores are in
    order of first appearance, by channel and then rank. Channels of weight 0 are left out.
    """
    live = [(i, n, w, k) for i, (n, w, k) in enumerate(channels) if w > 0]
    pick = lambda f: F.coalesce(*[F.when(F.col("channel") == n, f(i, w, k)) for i, n, w, k in live])
    rows = rankings.where(F.col("channel").isin([n for _, n, _, _ in live])).withColumn("part", pick(lambda i, w, k: F.lit(float(w)) / (k + F.col("rank")))).withColumn("c", pick(lambda i, w, k: F.lit(i)))
    fused = rows.groupBy("qid", id_col).agg(F.round(F.sum("part"), 9).alias("score"), F.min(F.struct("c", "rank")).alias("first"), *[F.max(F.when(F.col("channel") == n, F.col("rank"))).alias(f"{n}_rank") for _, n, _, _ in live])
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "first", id_col)
    return fused.withColumn("rank", F.row_number().over(order)).drop("first")


def diversified(hits: DataFrame, per_page: int, top_k: int) -> DataFrame:
    """At most per_page hits of a page, then the first top_k; `position` counts from 1."""
    nth = F.row_number().over(Window.partitionBy("qid", "page_id").orderBy("rank"))
    some = hits.withColumn("nth", nth).where(F.col("nth") <= per_page).drop("nth")
    return some.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("position") <= top_k)


def packed(hits: DataFrame, budget: int, blocks: Column | None = None) -> DataFrame:
    """(qid, used, context_tokens): greedy packing in order of position.

    hits (qid, position, tokens, label, text). A hit that does not fit is skipped, unless it is the first;
    packing ends when nothing is left. `used` lists (position, tokens) in order. blocks: tokens
    already taken by a question's fact lines.
    """
    rows = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("position", "tokens"))).alias("rows"), F.max(blocks if blocks is not None else F.lit(0)).alias("taken"))
    start = F.struct((F.lit(budget) - F.col("taken")).cast("int").alias("left"), F.array().cast("array<struct<position:int,tokens:int>>").alias("used"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["left"] > 0) & ((x["tokens"] <= acc["left"]) | (F.size(acc["used"]) == 0))
        item = F.struct(x["position"].cast("int").alias("position"), x["tokens"].cast("int").alias("tokens"))
        return F.struct(F.when(fits, acc["left"] - x["tokens"].cast("int")).otherwise(acc["left"]).alias("left"), F.when(fits, F.concat(acc["used"], F.array(item))).otherwise(acc["used"]).alias("used"))

    out = rows.select("qid", F.aggregate("rows", start, step)["used"].alias("used"))
    return out.withColumn("context_tokens", F.aggregate("used", F.lit(0), lambda s, x: s + x["tokens"]))


def context_text(hits: DataFrame, used: DataFrame) -> DataFrame:
    """(qid, context): the used hits as numbered excerpts."""
    each = used.select("qid", F.posexplode("used").alias("n", "u")).select("qid", (F.col("n") + 1).alias("n"), F.col("u.position").alias("position"))
    lines = each.join(hits, ["qid", "position"]).select("qid", F.struct("n", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "label", F.lit("\n"), "text").alias("line")).alias("x"))
    return lines.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n\n").alias("context"))


def sources(hits: DataFrame) -> DataFrame:
    """(qid, url, first_position, sections): distinct pages of the hits in order."""
    return hits.groupBy("qid", "url").agg(F.min("position").alias("first_position"), F.transform(F.array_sort(F.collect_list(F.struct("position", "section"))), lambda x: x["section"]).alias("sections"))
