"""Sections to overlapping, token-bounded passages, and page cleaning that needs no parser."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import token_estimate

CHARS_PER_TOKEN = 2.6
#: Unicode's spaces (category Zs).
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
SENTENCE = r"(?<=[.!?؟])\s+(?=[A-Z؀-ۿ])"
#: Sections that are bibliography or navigation.
SKIPPED_SECTIONS = [
    "references", "notes", "note", "sources", "bibliography", "see also", "see-also", "external links", "external link",
    "further reading", "footnotes", "related articles", "gallery", "links",
]


@dataclass(frozen=True)
class ChunkSizes:
    target: int = 380
    most: int = 620
    overlap: int = 60
    least: int = 25

    def chars(self, tokens: int) -> int:
        return int(tokens * CHARS_PER_TOKEN)


def paragraphs(text: Column, pattern: str = r"\n\s*\n") -> Column:
    """The pieces of a text without the spaces around them; empty ones go."""
    # not F.trim itself: transform would hand it a piece's index as the characters to trim
    return F.filter(F.transform(F.split(text, pattern), lambda p: F.trim(p, F.lit(SPACES))), lambda p: p != "")


def split_long(block: Column, max_chars: int) -> Column:
    """A block as pieces of at most max_chars: whole sentences joined greedily, a longer one cut hard."""
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(s) / max_chars).cast("int") - 1)), lambda i: F.substr(s, i * max_chars + 1, F.lit(max_chars)))
    parts = F.flatten(F.transform(F.split(block, SENTENCE), cut))

    def step(acc: Column, s: Column) -> Column:
        both = F.when(acc["open"] == "", s).otherwise(F.concat_ws(" ", acc["open"], s))
        fits = F.length(both) <= max_chars
        return F.struct(F.when(fits | (acc["open"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), F.when(fits, both).otherwise(s).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    out = F.aggregate(parts, start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    return F.when(F.length(block) <= max_chars, F.array(block)).otherwise(out)


def pack(blocks: Column, sizes: ChunkSizes, joint: str = "\n\n") -> Column:
    """Greedy passages from blocks: full at the target, each begins with the last characters of the one before."""
    target, keep = sizes.chars(sizes.target), sizes.chars(sizes.overlap)

    def step(acc: Column, b: Column) -> Column:
        joined = F.when(acc["open"] == "", b).otherwise(F.concat(acc["open"], F.lit(joint), b))
        full = (acc["open"] != "") & (acc["fresh"] > 0) & (F.length(joined) > target)
        end = F.substr(acc["open"], F.length(acc["open"]) - keep + 1, F.lit(keep))
        space = F.instr(end, " ")
        tail = F.when(F.length(acc["open"]) <= keep, F.lit("")).when(space > 0, F.substr(end, space + 1, F.lit(keep))).otherwise(end)
        after = F.when(tail == "", b).otherwise(F.concat(tail, F.lit(joint), b))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, after).otherwise(joined).alias("open"),
            F.when(full, F.lit(1)).otherwise(acc["fresh"] + 1).alias("fresh"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("fresh"))
    return F.aggregate(blocks, start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))


def chunk_sections(sections: DataFrame, sizes: ChunkSizes = ChunkSizes(), pattern: str = r"\n\s*\n") -> DataFrame:
    """(page_id, section, section_no, kind, ordinal, text, tokens) from rows (page_id, section_no, section, kind, text).

    Passages below the least size go; the ordinal counts those that stay, in order of sections.
    """
    blocks = F.flatten(F.transform(paragraphs(F.col("text"), pattern), lambda p: split_long(p, sizes.chars(sizes.most))))
    rows = sections.withColumn("pieces", F.when(F.col("kind") == "infobox", F.array("text")).otherwise(pack(blocks, sizes)))
    rows = rows.select("page_id", "section_no", "section", "kind", F.posexplode("pieces").alias("piece", "piece_text"))
    rows = rows.withColumn("tokens", token_estimate(F.col("piece_text"))).where(F.col("tokens") >= sizes.least)
    ordinal = F.row_number().over(Window.partitionBy("page_id").orderBy("section_no", "piece")) - 1
    return rows.select("page_id", "section", "section_no", "kind", ordinal.alias("ordinal"), F.col("piece_text").alias("text"), "tokens")


def context_header(title: Column, section: Column) -> Column:
    return F.when(section == "Summary", title).otherwise(F.concat_ws(" — ", title, section))


def embed_text(title: Column, section: Column, text: Column) -> Column:
    return F.concat(context_header(title, section), F.lit("\n"), text)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.sum("tokens").cast("long").alias("tokens"), F.round(F.avg("tokens"), 6).alias("mean"), F.max("tokens").alias("most"))


def is_navigation(title: Column, wikitext: Column) -> Column:
    head = F.lower(F.substring(wikitext, 1, 4000))
    return title.contains("(disambiguation)") | head.rlike(r"\{\{(disambiguation|disambig|dab)")


def section_paths(levels: Column) -> Column:
    """For headings (level, name) in order, each one's ancestor path, by a stack popped while its level is not below."""

    def step(acc: Column, h: Column) -> Column:
        stack = F.concat(F.filter(acc["stack"], lambda x: x["level"] < h["level"]), F.array(h))
        return F.struct(stack.alias("stack"), F.concat(acc["paths"], F.array(F.transform(stack, lambda x: x["name"]))).alias("paths"))

    start = F.struct(F.array().cast("array<struct<level:int,name:string>>").alias("stack"), F.array().cast("array<array<string>>").alias("paths"))
    return F.aggregate(levels, start, step)["paths"]


def kept_section(path: Column) -> Column:
    return ~F.arrays_overlap(F.transform(path, lambda p: F.lower(F.trim(p))), F.array(*[F.lit(s) for s in SKIPPED_SECTIONS]))


def scrubbed_html(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags go, blanks collapse."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


def infobox_text(title: Column, pairs: Column) -> Column:
    lines = F.transform(pairs, lambda x: F.concat(F.lit("- "), x["k"], F.lit(": "), x["v"]))
    return F.concat(F.lit("Key facts about "), title, F.lit(":\n"), F.array_join(lines, "\n"))
