"""Cleaning, chunking, index upkeep and small text functions over the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.operators import chunking as ck
from lorekeep.operators import index
from lorekeep.sources.tables import parquet


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ck.chunk_stats(token_estimate(spark, sf_dir))


def context_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = parquet(spark, sf_dir, "documents")
    section = F.when(F.col("lang") == "en", "Summary").otherwise(F.col("lang"))
    return d.select("doc_id", ck.context_header(F.col("source"), section).alias("header"), F.md5(ck.embed_text(F.col("source"), section, F.col("text"))).alias("embed_md5"))


def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = parquet(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(ck.paragraphs(F.col("text"), "\n")).alias("nth", "paragraph")).select("doc_id", "nth", F.length("paragraph").alias("chars"), F.md5("paragraph").alias("md5"))


SIZES = ck.ChunkSizes(100, 160, 20, 5)


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines packed into passages."""
    d = parquet(spark, sf_dir, "documents")
    blocks = ck.pack(ck.paragraphs(F.col("text"), "\n"), SIZES, "\n")
    return d.select("doc_id", F.posexplode(blocks).alias("nth", "t")).select("doc_id", "nth", F.length("t").alias("chars"), F.md5("t").alias("md5"))


CHUNK_PACK_SQL = """WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS b FROM documents),
r(doc_id, i, open, fresh, done) AS (
  SELECT doc_id, 0, '', 0, []::VARCHAR[] FROM p
  UNION ALL
  SELECT doc_id, i, CASE WHEN isfull THEN CASE WHEN tail = '' THEN x ELSE tail || chr(10) || x END ELSE joined END,
    CASE WHEN isfull THEN 1 ELSE fresh + 1 END, CASE WHEN isfull THEN list_append(done, open) ELSE done END
  FROM (SELECT *, open <> '' AND fresh > 0 AND length(joined) > 260 AS isfull,
      CASE WHEN length(open) <= 52 THEN '' WHEN instr(right(open, 52), ' ') > 0 THEN substr(right(open, 52), instr(right(open, 52), ' ') + 1) ELSE right(open, 52) END AS tail
    FROM (SELECT r.doc_id, r.i + 1 AS i, r.open, r.fresh, r.done, p.b[r.i + 1] AS x, CASE WHEN r.open = '' THEN p.b[r.i + 1] ELSE r.open || chr(10) || p.b[r.i + 1] END AS joined
      FROM r JOIN p USING (doc_id) WHERE r.i < len(p.b)))),
l AS (SELECT r.doc_id, CASE WHEN open = '' THEN done ELSE list_append(done, open) END AS c FROM r JOIN p ON p.doc_id = r.doc_id AND r.i = len(p.b))
SELECT doc_id, nth, length(t) AS chars, md5(t) AS md5 FROM (SELECT doc_id, unnest(c) AS t, generate_subscripts(c, 1) - 1 AS nth FROM l)"""


def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full chunker with sentence splitting; its look-behind is beyond the oracle's regex."""
    d = parquet(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.lit(0).alias("section_no"), F.lit("Summary").alias("section"), F.lit("summary").alias("kind"), "text")
    return ck.chunk_sections(d, pattern="\n")


def html_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "pages").select("page_id", F.md5(ck.scrubbed_html(F.col("html"))).alias("md5"))


def nav_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parquet(spark, sf_dir, "pages").withColumn("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    nav = ck.is_navigation(F.col("title"), F.col("html")) | F.lower(F.substring("html", 1, 4000)).contains('lang="fr"')
    return p.where(~nav).select("page_id", "title")


def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with their ancestor paths; h1 and p stand in for levels."""
    p = parquet(spark, sf_dir, "pages")
    tags = F.regexp_extract_all("html", F.lit(r"<(h1|article|p|b)>"), F.lit(1))
    level = lambda t: F.when(t == "article", 1).when(t == "h1", 2).when(t == "p", 3).otherwise(4)
    paths = ck.section_paths(F.transform(tags, lambda t: F.struct(level(t).alias("level"), t.alias("name"))))
    return p.select("page_id", F.posexplode(paths).alias("nth", "path")).select("page_id", "nth", F.array_join("path", " > ").alias("path"))


SECTION_SQL = r"""WITH RECURSIVE t AS (SELECT page_id, regexp_extract_all(html, '<(h1|article|p|b)>', 1) AS x FROM pages),
r(page_id, nth, levels, names) AS (
  SELECT page_id, 0, []::INT[], []::VARCHAR[] FROM t
  UNION ALL
  SELECT page_id, nth + 1, list_append(list_filter(levels, lambda y: y < l), l),
    list_append(names[1:len(list_filter(levels, lambda y: y < l))], x) FROM (
    SELECT r.*, t.x[nth + 1] AS x, CASE t.x[nth + 1] WHEN 'article' THEN 1 WHEN 'h1' THEN 2 WHEN 'p' THEN 3 ELSE 4 END AS l FROM r JOIN t USING (page_id) WHERE nth < len(t.x)))
SELECT page_id, nth - 1 AS nth, array_to_string(names, ' > ') AS path FROM r WHERE nth > 0"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parquet(spark, sf_dir, "pages")
    raw = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a href="/([^"]*)"'), F.lit(1))).alias("href"))
    return raw.where(tx.is_content_link(F.col("href"))).select("page_id", tx.page_title(F.col("href")).alias("target"))


TITLE_SQL = "replace(upper(left(trim(split_part(trim(replace({0}, '_', ' ')), '#', 1)), 1)), 'ẞ', 'SS') || substr(trim(split_part(trim(replace({0}, '_', ' ')), '#', 1)), 2)"
LINKS_SQL = rf"""links AS (SELECT page_id, {TITLE_SQL.format("href")} AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS href FROM pages) WHERE NOT contains(href, ':') OR length(split_part(href, ':', 1)) > 3)"""


def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).groupBy("page_id", "target").agg(F.count("*").alias("n"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the first word of their titles; of equal ones the smallest page wins."""
    p = parquet(spark, sf_dir, "pages").select("page_id", tx.page_title(F.split(F.regexp_extract("html", "<title>([^<]*)</title>", 1), " ")[0]).alias("title"))
    return p.groupBy("title").agg(F.min("page_id").alias("to_page"))


def resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets to pages: directly, else by one redirect (here: the target without a last comma or full stop)."""
    t = _titles(spark, sf_dir)
    redirects = _links(spark, sf_dir).select(F.col("target").alias("alias"), F.regexp_replace("target", "[.,]$", "").alias("real")).where("alias <> real").distinct()
    direct = _links(spark, sf_dir).join(t.withColumnRenamed("title", "target"), "target", "left")
    hop = direct.join(redirects.withColumnRenamed("alias", "target"), "target", "left").join(t.select(F.col("title").alias("real"), F.col("to_page").alias("by_hop")), "real", "left")
    return hop.select("page_id", "target", F.coalesce("to_page", "by_hop").alias("to_page")).distinct()


RESOLVE = rf"""{LINKS_SQL}, titles AS (SELECT {TITLE_SQL.format("split_part(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ', 1)")} AS title, min(page_id) AS to_page FROM pages GROUP BY 1),
resolved AS (SELECT DISTINCT page_id, target, coalesce(a.to_page, b.to_page) AS to_page FROM links LEFT JOIN titles a ON a.title = target LEFT JOIN titles b ON b.title = regexp_replace(target, '[.,]$', '') AND target <> b.title)"""


def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolve_links(spark, sf_dir).where("to_page is not null and to_page <> page_id")
    return r.groupBy(F.col("page_id").alias("s"), F.col("to_page").alias("o")).agg(F.count("*").alias("n"))


def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "part").select("p_partkey", tx.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


def label_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.label_search(parquet(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "R#0000000", 10, "c_custkey")


def explorer_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.explorer_search(parquet(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "R'e", 60, "p_partkey")


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = parquet(spark, sf_dir, "events").select("event_type", tx.json_column(F.col("props"), "k int").alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").cast("long").alias("k"), F.count("*").alias("n"), F.max(F.to_json("p")).alias("largest"))


def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.missing_vectors(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "embeddings"), "doc_id", "vec_id").select("doc_id")


def orphan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = parquet(spark, sf_dir, "documents").where("doc_id % 3 <> 0")
    return index.orphans(parquet(spark, sf_dir, "embeddings"), kept, "doc_id", "vec_id").select("vec_id", "label")


def delete_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = parquet(spark, sf_dir, "documents").select(F.col("source").alias("page_id"), F.col("doc_id").alias("chunk_id"))
    gone = d.where("page_id in ('src1', 'src2')").select("page_id").distinct()
    v = parquet(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    out = index.delete_pages({"chunks": d, "vectors": v}, gone)
    return out["chunks"].groupBy().agg(F.count("*").alias("n")).select(F.lit("chunks").alias("name"), "n").unionByName(out["vectors"].groupBy().agg(F.count("*").alias("n")).select(F.lit("vectors").alias("name"), "n"))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's latest order replaces their row; customers without orders keep theirs."""
    o = index.latest(parquet(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    new = o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"))
    old = parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit(-1).cast("long").alias("value"))
    return index.upsert(old, new, ["key"])


def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "embeddings")
    have = d.join(e.select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("v")), "doc_id", "left")
    return have.agg(F.count("*").alias("chunks"), F.count("v").alias("vectors"), F.countDistinct("source").alias("pages"), F.round(100.0 * F.count("v") / F.count("*"), 4).alias("percent"), (F.count("v") >= F.count("*")).alias("ok"))


def raw_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_pages"))


def aliases_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirects with exactly one target, inverted: customers' names by nation, those with a single order."""
    o = parquet(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("links")).where(F.size("links") <= 3)
    return o.select(F.col("o_custkey").alias("alias"), (F.col("o_custkey") % 10).alias("target")).groupBy("target").agg(F.array_join(F.array_sort(F.collect_list("alias")), ",").alias("aliases"))


def infobox_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parquet(spark, sf_dir, "part")
    pairs = F.array(F.struct(F.lit("Brand").alias("k"), F.col("p_brand").alias("v")), F.struct(F.lit("Type").alias("k"), F.col("p_type").alias("v")), F.struct(F.lit("Size").alias("k"), F.col("p_size").cast("string").alias("v")))
    return p.select("p_partkey", ck.infobox_text(F.col("p_name"), pairs).alias("text"))


def html_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "pages").select("page_id", F.md5(tx.html_safe(F.col("html"))).alias("md5"))


def recent_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest event of each user and type."""
    e = parquet(spark, sf_dir, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return e.withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_type", "event_id")


SUM_TOK = "greatest(1, floor(length(text) / 2.6)::INT)"
SECTION = "CASE WHEN lang = 'en' THEN source ELSE source || ' — ' || lang END"
SLUG = "trim(regexp_replace(regexp_replace(lower({0}), '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-')"
SCRUB = r"""trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"""

QUERIES = {
    "token_estimate": (token_estimate, f"SELECT doc_id, {SUM_TOK} AS tokens FROM documents"),
    "chunk_stats": (chunk_stats, f"SELECT count(*) AS chunks, sum({SUM_TOK})::BIGINT AS tokens, round(avg({SUM_TOK}), 6) AS mean, max({SUM_TOK}) AS most FROM documents"),
    "context_header": (context_header, f"SELECT doc_id, {SECTION} AS header, md5({SECTION} || chr(10) || text) AS embed_md5 FROM documents"),
    "paragraph_split": (paragraph_split, "WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS b FROM documents) SELECT doc_id, nth, length(t) AS chars, md5(t) AS md5 FROM (SELECT doc_id, unnest(b) AS t, generate_subscripts(b, 1) - 1 AS nth FROM p)"),
    "chunk_pack": (chunk_pack, CHUNK_PACK_SQL),
    "chunk_sentences": (chunk_sentences, None),
    "html_scrub": (html_scrub, f"SELECT page_id, md5({SCRUB}) AS md5 FROM pages"),
    "nav_filter": (nav_filter, r"""SELECT page_id, title FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, lower(left(html, 4000)) AS h FROM pages) WHERE NOT (contains(title, '(disambiguation)') OR regexp_matches(h, '\{\{(disambiguation|disambig|dab)') OR contains(h, 'lang="fr"'))"""),
    "section_split": (section_split, SECTION_SQL),
    "link_extract": (link_extract, f"WITH {LINKS_SQL} SELECT page_id, target, count(*) AS n FROM links GROUP BY ALL"),
    "resolve_links": (resolve_links, f"WITH {RESOLVE} SELECT * FROM resolved"),
    "link_graph": (link_graph, f"WITH {RESOLVE} SELECT page_id AS s, to_page AS o, count(*) AS n FROM resolved WHERE to_page IS NOT NULL AND to_page <> page_id GROUP BY ALL"),
    "slug": (slug, f"SELECT p_partkey, {SLUG.format("concat_ws(' ', p_name, p_type)")} AS slug FROM part"),
    "label_search": (label_search, "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%r#0000000%' ORDER BY length(c_name), c_custkey LIMIT 10"),
    "explorer_search": (explorer_search, "SELECT p_partkey, p_name, instr(replace(strip_accents(lower(p_name)), '''', ''), 're') AS place FROM part WHERE instr(replace(strip_accents(lower(p_name)), '''', ''), 're') > 0 ORDER BY place, length(p_name), p_partkey LIMIT 60"),
    "json_props": (json_props, "SELECT event_type, sum((props->>'k')::INT)::BIGINT AS k, count(*) AS n, max('{\"k\":' || (props->>'k') || '}') AS largest FROM events GROUP BY event_type"),
    "missing_vectors": (missing_vectors, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"),
    "orphan_vectors": (orphan_vectors, "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)"),
    "delete_page": (delete_page, "SELECT 'chunks' AS name, count(*) AS n FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2'))"),
    "upsert_latest": (upsert_latest, "SELECT c_custkey AS key, coalesce(arg_max(o_orderkey, (o_orderdate, o_orderkey)), -1) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "index_status": (index_status, "SELECT count(*) AS chunks, count(vec_id) AS vectors, count(DISTINCT source) AS pages, round(100.0 * count(vec_id) / count(*), 4) AS percent, count(vec_id) >= count(*) AS ok FROM documents LEFT JOIN embeddings ON vec_id = doc_id"),
    "raw_counts": (raw_counts, "SELECT lang, count(*) AS n_pages FROM documents GROUP BY lang"),
    "aliases_of": (aliases_of, "SELECT target, string_agg(alias, ',' ORDER BY alias) AS aliases FROM (SELECT o_custkey AS alias, o_custkey % 10 AS target FROM orders GROUP BY o_custkey HAVING count(*) <= 3) GROUP BY target"),
    "infobox_render": (infobox_render, "SELECT p_partkey, 'Key facts about ' || p_name || ':' || chr(10) || '- Brand: ' || p_brand || chr(10) || '- Type: ' || p_type || chr(10) || '- Size: ' || p_size AS text FROM part"),
    "html_embed": (html_embed, r"SELECT page_id, md5(replace(html, '</', '<\/')) AS md5 FROM pages"),
    "recent_kinds": (recent_kinds, "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL"),
}
