"""Raw pages to index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.wikitext import clean_pages
from lorekeep.operators import chunking as ck


def build_index(raw: DataFrame, aliases: DataFrame, sizes: ck.ChunkSizes = ck.ChunkSizes(), noise: list[str] | None = None) -> dict[str, DataFrame]:
    """pages and chunks; a page is the infobox's passage, then the summary's, then its sections'. Navigation pages and pages without passages are left out."""
    clean = clean_pages(raw.where(~ck.is_navigation(F.col("title"), F.col("wikitext"))))
    box = F.filter("infobox", lambda x: ~F.lower(x["k"]).isin(noise or []))
    parts = F.concat(
        F.when(F.size(box) > 0, F.array(F.struct(F.lit("infobox").alias("kind"), F.lit("Key facts").alias("section"), ck.infobox_text(F.col("title"), box).alias("text")))).otherwise(F.array().cast("array<struct<kind:string,section:string,text:string>>")),
        F.array(F.struct(F.lit("summary").alias("kind"), F.lit("Summary").alias("section"), F.col("summary").alias("text"))),
        F.transform("sections", lambda x: F.struct(F.lit("body").alias("kind"), F.array_join(x["path"], " > ").alias("section"), x["text"].alias("text"))),
    )
    rows = clean.select("page_id", F.posexplode(parts).alias("section_no", "s")).select("page_id", "section_no", "s.kind", "s.section", "s.text")
    chunks = ck.chunk_sections(rows, sizes)
    al = aliases.select(F.col("target").alias("title"), "aliases")
    pages = clean.select("page_id", "ns", "title", "url", "categories").join(al, "title", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    pages = pages.join(chunks.select("page_id").distinct(), "page_id", "left_semi")
    full = chunks.join(pages.select("page_id", "ns", "title", "url", F.array_join("aliases", " ").alias("aliases")), "page_id")
    # stable ids without a global sort: page and ordinal, room for 16 million passages a page
    full = full.withColumn("chunk_id", F.shiftleft(F.col("page_id"), 24) + F.col("ordinal"))
    return {"pages": pages, "chunks": full}

