"""Wikitext pages made of the `part` table, cleaned, chunked and read into a graph by the library; each query with its SQL.

The tables hold no wikitext, so each part becomes a page with infobox, references, templates, lists,
tables and sections whose clean form is known, and every fourth part a redirect as well.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.config import Settings
from lorekeep.functions.wikitext import clean_pages
from lorekeep.operators import chunking as ck
from lorekeep.operators import extract as ex
from lorekeep.operators import index, vectors
from lorekeep.plans import answer, build
from lorekeep.sources import store, tables, wiki
from lorekeep.sources.tables import parquet, shared_dir, stored

ONTOLOGY = ex.Ontology(
    {"Book": ("infobox book",), "Maker": ("infobox maker",)},
    (
        ex.Predicate("authored_by", "was written by", ("author",), inverse="authored", range_classes=("Maker",), priority=0),
        ex.Predicate("authored", "wrote", ("works",), inverse="authored_by", range_classes=("Book",), priority=0),
        ex.Predicate("made_in", "was made in", ("place",), domain=("Book",), priority=2),
        ex.Predicate("lived_in", "lived in", ("place",), priority=2),
        ex.Predicate("published_on", "was published on", ("published",), range="date"),
    ),
    noise=("image",),
)

#: A page's wikitext: {n} name, {k} key, {b} brand, {t} type, {m} maker's number, {d} day, {y} year.
BOOK = """{{{{Infobox book|image=[[Maker 1]]|name={n}|author=[[maker_{m}]]|place=[[Maker 2]] and [[Nowhere]]|series=[[Maker 3]]|published=May {d}, {y} CE|pages=-|topic=?|size= |3=x}}}}
<!-- hidden -->'''{n}''' is a {t}<ref name="a">Source  ''{k}'' of [[Maker {m}|{b}]]</ref> of [[Maker {m}|{b}]]<ref name="b"/>.
{{{{quote box|title=T{k}|quote=said {k}|source=S|author=A}}}}
[[File:x.jpg|thumb|A [[link]] here]][[Media:y.ogg|sound]]<noinclude>kept</noinclude>
* one
*
# two
[[Category:Old]]
== History ==
{{{{Main|Old page|Older page}}}}{{{{see also|Old page}}}}
Text {{{{small|size {d}}}}} {{{{unknown|short}}}}and {{{{unknown|x=the longest of all of its parameters, number {k}}}}}.
{{| class="t"
| cell
|}}
=== Deeper ===
More of [[{b}]].{{{{reflist}}}}
== References ==
Gone
=== Under them ===
Gone too
== Empty ==
"""
MAKER = """{{{{Infobox maker|works=[[{n}]], [[{n}]]|place=[[Maker {m}]]}}}}Maker number {k}, who made many things in the year {y} AH and in many other years as well, as is told of them.
== Life ==
They lived long."""
MARKS = ("n", "k", "b", "t", "m", "d", "y")


def _filled(template: str, **columns: Column) -> Column:
    """The template with its marks replaced by columns, as one concatenation."""
    text = template.format(**{m: f"\0{m}\0" for m in MARKS})
    return F.concat(*[columns[p] if i % 2 else F.lit(p) for i, p in enumerate(text.split("\0"))])


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book a part, ten makers, a category and a page that only leads on."""
    p = parquet(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("long")  # a page is a hundred times its row: the rows are dealt out before
    s = lambda c: c.cast("string")
    name = F.concat_ws(" ", F.initcap("p_name"), s(k))
    book = _filled(BOOK, n=name, k=s(k), b=F.col("p_brand"), t=F.col("p_type"), m=s(k % 10), d=s(1 + k % 28), y=s(1900 + k % 100))
    rest = [F.lit(None).cast("long").alias("revid"), F.lit(None).cast("string").alias("timestamp")]
    books = tables.dealt(p, "p_partkey").select(k.alias("pageid"), F.lit(0).alias("ns"), name.alias("title"), F.concat(F.lit("http://w/"), s(k)).alias("url"), *rest, F.array(F.concat(F.lit("Category:"), F.col("p_type")), F.lit("category : Books")).alias("categories"), book.alias("wikitext"))
    first = p.where("p_partkey < 10").select(k.alias("k"), name.alias("n"))
    n = F.col("k")
    maker = _filled(MAKER, n=F.col("n"), k=s(n), b=F.lit(""), t=F.lit(""), m=s(n), d=F.lit(""), y=s(300 + n))
    makers = first.select((1_000_000_000 + n).alias("pageid"), F.lit(0).alias("ns"), F.concat(F.lit("Maker "), s(n)).alias("title"), F.concat(F.lit("http://m/"), s(n)).alias("url"), *rest, F.array().cast("array<string>").alias("categories"), maker.alias("wikitext"))
    fixed = spark.createDataFrame([(2_000_000_000, 14, "Category:Books", "http://c", None, None, ["Category:Works", "Category:Books"], ""), (2_000_000_001, 0, "Book (disambiguation)", "http://d", None, None, [], "{{disambig}} [[Maker 1]]")], tables.RAW_PAGE)
    return books.unionByName(makers).unionByName(fixed)


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth book is also known by its number; one redirect leads nowhere."""
    p = parquet(spark, sf_dir, "part").where("p_partkey % 4 = 0")
    k = F.col("p_partkey").cast("string")
    return p.select(F.concat(F.lit("Number "), k).alias("alias"), F.concat_ws(" ", F.initcap("p_name"), k).alias("target")).unionByName(spark.createDataFrame([("Lost", "Nowhere")], "alias string, target string"))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, f"clean pages of {sf_dir}", lambda: {"pages": clean_pages(raw_pages(spark, sf_dir).where("pageid < 1000000000"))})["pages"]


def clean_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, references, files, quotations, lists and links of the leads."""
    return cleaned(spark, sf_dir).select("page_id", "summary", F.array_join("citations", " / ").alias("citations"), F.array_join("categories", ",").alias("categories"))


def clean_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their paths; bibliography goes with all below it, empty ones go."""
    rows = cleaned(spark, sf_dir).select("page_id", F.array_join("pointers", ",").alias("pointers"), F.posexplode("sections").alias("nth", "x"))
    return rows.select("page_id", "nth", F.array_join("x.path", " > ").alias("path"), "x.level", "x.text", "pointers")


def clean_infobox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).select("page_id", ck.infobox_text(F.col("title"), F.col("infobox")).alias("text"))


def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from raw pages to passages: kinds, ordinals, sections and sizes; aliases by redirects."""
    made = build.build_index(raw_pages(spark, sf_dir).where("pageid < 1000000000 or ns = 0 and pageid = 2000000001"), tables.aliases(redirects(spark, sf_dir)), noise=["image"])
    return made["chunks"].select("page_id", "ordinal", "kind", "section", F.length("text").alias("chars"), "aliases")


def _graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return stored(spark, f"extracted graph of {sf_dir}", lambda: ex.extract(raw_pages(spark, sf_dir), redirects(spark, sf_dir), ONTOLOGY))


def extracted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges with ranges and domains, dates, taxonomy."""
    return _graph(spark, sf_dir)["edges"].select("s", "p", "o", "src", "field")


def extracted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)["nodes"].select("id", "kind", "label", F.array_join("aliases", ",").alias("aliases"))


def extracted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)["links"]


def extracted_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)["classes"].groupBy("class").agg(F.count("*").alias("n"))


def extracted_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)["unmapped"]


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lorekeep-{uuid.uuid4().hex}"


def raw_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages to JSON lines by name space and back, a missing name space passed over; written again only if forced."""
    folder = _folder(spark)
    raw = raw_pages(spark, sf_dir)
    tables.write_raw(raw, folder)
    tables.write_raw(raw.where("ns = 14"), folder)  # what is there stays
    return tables.raw_counts(tables.read_raw(spark, folder))


def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as JSON lines, scanned, loaded into a store that is reset first, counted, and its notes read back."""
    folder = _folder(spark)
    held = store.GraphStore(spark, f"{folder}/store")
    empty = held.counts()["edges"] + int(held.is_populated)
    ex.write_graph(_graph(spark, sf_dir), folder)
    held.load(store.read_graph(spark, folder))
    held.set_meta("note", "first")
    held.set_meta("note", "second")
    rows = [*held.counts().items(), ("before", empty), ("populated", int(held.is_populated)), ("notes", int(held.get_meta("note") == "second" and held.get_meta("none", "-") == "-"))]
    held.drop("links")
    return spark.createDataFrame([*rows, ("links dropped", held.counts()["links"])], "name string, n long")


def wiki_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as a wiki that lists seven titles at a time, is busy at times and once cut off; fetched by the client."""
    rows = {f"Nation {r.n_nationkey}": r for r in parquet(spark, sf_dir, "nation").collect()}  # 25 rows
    titles, calls = sorted(rows), []

    def transport(q: dict) -> tuple[int, dict, dict]:
        calls.append(q)
        if len(calls) == 2:
            raise OSError("cut off")
        if len(calls) % 5 == 0:
            return 429, {"Retry-After": "1"}, {}
        if len(calls) % 7 == 0:
            return 200, {}, {"error": {"code": "maxlag"}}
        if q.get("list") == "allpages":
            at = int(q.get("apcontinue", 0))
            more = {"continue": {"apcontinue": str(at + 7)}} if at + 7 < len(titles) else {}
            return 200, {}, {"query": {"allpages": [{"title": t} for t in titles[at : at + 7]]}} | more
        if q.get("generator") == "allpages":
            links = lambda i: [{"title": f"Nation {i}"}] + ([{"title": "Other"}] if i % 3 == 0 else [])
            return 200, {}, {"query": {"pages": [{"title": f"N{i}", "links": links(i)} for i in range(len(titles))]}}
        pages = []
        for t in q["titles"].split("|"):
            r = rows[t]
            text = "" if r.n_nationkey % 10 == 9 else f"{r.n_name} in region {r.n_regionkey}"
            pages.append({"pageid": r.n_nationkey, "ns": 0, "title": t, "revisions": [{"revid": 7, "slots": {"main": {"content": text}}}], "categories": [{"title": "Category:Nations"}]})
        return 200, {}, {"query": {"pages": [*pages, {"title": "Missing", "missing": True}]}}

    folder = _folder(spark)
    client = wiki.WikiClient(transport, "http://w", Settings(titles_per_request=10), sleep=lambda s: None)
    store.fetch_all(client, spark, folder, [0])
    store.fetch_all(client, spark, folder, [0])  # nothing is fetched twice
    pages = tables.read_raw(spark, folder).select("pageid", "title", "url", "wikitext", F.array_join("categories", ",").alias("categories"))
    known = tables.aliases(store.read_redirects(spark, folder)).select(F.col("target").alias("title"), F.array_join("aliases", ",").alias("aliases"))
    return pages.join(known, "title", "left")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's message of each question's prompt."""
    b = parquet(spark, sf_dir, "benchmark").select("item_id", "text")
    made = F.udf(lambda q: answer.messages(q, "[1] x\ny")[1]["content"])
    return b.select("item_id", F.md5(made("text")).alias("md5"))


def sub_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read from a model's reply: numbers, bullets, fences, talk and repeats go, short lines too."""
    b = parquet(spark, sf_dir, "benchmark").select("item_id", F.slice(F.split(F.translate("text", "\n", " "), " "), 1, 4).alias("w")).where("size(w) = 4")
    q = F.array_join("w", " ")
    reply = F.concat(F.lit("Sure, here:\n```text\n1. Who "), q, F.lit("?\n2) - What "), q, F.lit("?\n* Who "), q, F.lit("?\ntoo short\n```"), F.when(F.col("item_id") % 5 == 0, F.lit("\nSINGLE")).otherwise(F.lit("")))
    read = F.udf(lambda r: answer.sub_questions(r), "array<string>")
    return b.select("item_id", F.array_join(read(reply), " / ").alias("parts"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answering with an injected model, through the façade: sources, pieces and figures; questions without hits get the fixed text."""
    rows = parquet(spark, sf_dir, "region").collect()  # 5 rows

    def find(question: str, top_k, parts) -> answer.Retrieval:
        hits = [{"url": f"u/{k}", "position": i, "section": "S"} for i, k in enumerate(question.split()[-1] * 2, 1)] if not question.endswith("0") else []
        return answer.Retrieval(f"ctx {question}", hits, 5)

    def chat(model: str, messages: list[dict], **options):
        yield from (f"{model} ", messages[-1]["content"].split("Question: ")[1].split("\n")[0])

    api = answer.Api(answer.Engine(find, chat))
    got = [(r.r_regionkey, api.ask(f"what of {r.r_regionkey}", profile="quality"), len(list(api.ask_stream(f"what of {r.r_regionkey}")))) for r in rows]
    return spark.createDataFrame([(int(k), a["text"], a["model"], len(a["sources"]), n) for k, a, n in got], "region int, text string, model string, sources int, events int")


def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of an injected embedder, of unit length, for the documents that have none yet."""
    d = parquet(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("embed_text"))
    todo = index.missing_vectors(d, d.where("chunk_id % 3 = 0").select("chunk_id"))
    out = vectors.embedded(todo, by_length)
    return out.select("chunk_id", F.round(F.col("embedding")[0].cast("double"), 4).alias("a"), F.round(F.col("embedding")[1].cast("double"), 4).alias("b"))


def by_length(texts: list[str]) -> list[list[float]]:
    """An embedder that sees a text's length only, without the prefix that documents get."""
    return [[float(len(t) - len(vectors.DOCUMENT_PREFIX)), 300.0] for t in texts]


def prune_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that only lead on go with their passages and vectors; vectors without a passage go as well."""
    d = parquet(spark, sf_dir, "documents")
    pages = d.select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 7 == 0, F.lit("X (disambiguation)")).otherwise("source").alias("title"))
    chunks = d.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("page_id"))
    out = index.prune({"pages": pages, "chunks": chunks, "vectors": parquet(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))})
    one = lambda n: out[n].groupBy().agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return one("pages").unionByName(one("chunks")).unionByName(one("vectors"))


# -- the SQL forms ---------------------------------------------------------------------------------
B = """b AS (SELECT p_partkey::BIGINT AS k, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') || ' ' || p_partkey AS n,
  p_brand AS b, p_type AS t, p_partkey % 10 AS m, 1 + p_partkey % 28 AS d, 1900 + p_partkey % 100 AS y FROM part)"""
BOX = """'Key facts about ' || n || ':' || chr(10){0} || '- Name: ' || n || chr(10) || '- Author: maker_' || m || chr(10) || '- Place: Maker 2 and Nowhere' || chr(10) || '- Series: Maker 3' || chr(10) || '- Published: May ' || d || ', ' || y || ' CE'"""
LEAD = """n || ' is a ' || t || ' of ' || b || '.' || chr(10) || chr(10) || 'T' || k || ': "said ' || k || '" — S' || chr(10) || chr(10) || 'kept' || chr(10) || '- one' || chr(10) || '- two'"""
HISTORY = "'Text size ' || d || ' and the longest of all of its parameters, number ' || k || '.'"
E = """e AS (SELECT 'page:' || k AS s, 'authored_by' AS p, 'page:' || (1000000000 + m) AS o, 'infobox' AS src, 'author' AS field FROM b
  UNION ALL SELECT 'page:' || k, 'made_in', 'page:1000000002', 'infobox', 'place' FROM b
  UNION ALL SELECT 'page:' || k, 'published_on', 'date:ce:' || y || '-05-' || lpad(d::VARCHAR, 2, '0'), 'infobox', 'published' FROM b
  UNION ALL SELECT 'page:' || k, 'instance_of', unnest(['cat:' || t, 'cat:Books']), 'category', NULL FROM b
  UNION ALL SELECT 'page:' || (1000000000 + k), 'authored', 'page:' || k, 'infobox', 'works' FROM b WHERE k < 10
  UNION ALL SELECT 'cat:Books', 'subclass_of', 'cat:Works', 'category', NULL)"""
N = """nd AS (SELECT 'page:' || k AS id, 'entity' AS kind, n AS label, CASE WHEN k % 4 = 0 THEN 'Number ' || k ELSE '' END AS aliases FROM b
  UNION ALL SELECT 'page:' || (1000000000 + k), 'entity', 'Maker ' || k, '' FROM b WHERE k < 10
  UNION ALL SELECT 'cat:' || c, 'class', c, '' FROM (SELECT DISTINCT t AS c FROM b UNION SELECT 'Books' UNION SELECT 'Works')
  UNION ALL SELECT DISTINCT 'date:ce:' || y || '-05-' || lpad(d::VARCHAR, 2, '0'), 'date', 'May ' || d || ', ' || y || ' CE', '' FROM b)"""
L = """l AS (SELECT 'page:' || k AS s, 'page:' || (1000000000 + x) AS o, count(*) AS n FROM (SELECT k, unnest([m, m, m, 1, 2, 3]) AS x FROM b) GROUP BY ALL
  UNION ALL SELECT 'page:' || (1000000000 + k), 'page:' || k, 2 FROM b WHERE k < 10)"""
STORE = f"""WITH {B}, {E}, {N}, {L} SELECT 'nodes' AS name, count(*) AS n FROM nd UNION ALL SELECT 'node_classes', (SELECT count(*) FROM b) + (SELECT count(*) FROM b WHERE k < 10)
UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'links', count(*) FROM l UNION ALL SELECT 'typed_edges', count(*) FROM e WHERE p NOT IN ('instance_of', 'subclass_of')
UNION ALL SELECT 'before', 0 UNION ALL SELECT 'populated', 1 UNION ALL SELECT 'notes', 1 UNION ALL SELECT 'links dropped', 0"""
FLAT = "string_split(replace(text, chr(10), ' '), ' ')"
FOUR = f"array_to_string({FLAT}[1:4], ' ')"

QUERIES = {
    "clean_summary": (clean_summary, f"WITH {B} SELECT k AS page_id, {LEAD} AS summary, 'Source ' || k || ' of ' || b AS citations, t || ',Books' AS categories FROM b"),
    "clean_sections": (clean_sections, f"WITH {B} SELECT k AS page_id, 0 AS nth, 'History' AS path, 2 AS level, {HISTORY} AS text, 'Old page,Older page' AS pointers FROM b UNION ALL SELECT k, 1, 'History > Deeper', 3, 'More of ' || b || '.', 'Old page,Older page' FROM b"),
    "clean_infobox": (clean_infobox, f"WITH {B} SELECT k AS page_id, {BOX.format(" || '- Image: Maker 1' || chr(10)")} AS text FROM b"),
    "index_pages": (index_pages, f"WITH {B}, c AS (SELECT k, 0 AS z, 'infobox' AS kind, 'Key facts' AS section, {BOX.format('')} AS x FROM b UNION ALL SELECT k, 1, 'summary', 'Summary', {LEAD} FROM b UNION ALL SELECT k, 2, 'body', 'History', {HISTORY} FROM b UNION ALL SELECT k, 3, 'body', 'History > Deeper', 'More of ' || b || '.' FROM b) SELECT k AS page_id, row_number() OVER (PARTITION BY k ORDER BY z) - 1 AS ordinal, kind, section, length(x) AS chars, CASE WHEN k % 4 = 0 THEN 'Number ' || k ELSE '' END AS aliases FROM c WHERE floor(length(x) / 2.6) >= 25"),
    "extracted_edges": (extracted_edges, f"WITH {B}, {E} SELECT * FROM e"),
    "extracted_nodes": (extracted_nodes, f"WITH {B}, {N} SELECT * FROM nd"),
    "extracted_links": (extracted_links, f"WITH {B}, {L} SELECT * FROM l"),
    "extracted_classes": (extracted_classes, f"WITH {B} SELECT 'Book' AS class, count(*) AS n FROM b UNION ALL SELECT 'Maker', count(*) FROM b WHERE k < 10"),
    "extracted_unmapped": (extracted_unmapped, "SELECT 'infobox book' AS template, 'series' AS field_name, count(*) AS pages, count(*) AS links FROM part"),
    "raw_round_trip": (raw_round_trip, "SELECT 0 AS ns, count(*) + 11 AS n_pages FROM part UNION ALL SELECT 14, 1"),
    "store_round_trip": (store_round_trip, STORE),
    "wiki_source": (wiki_source, "SELECT n_nationkey::BIGINT AS pageid, 'Nation ' || n_nationkey AS title, 'http://w/Nation_' || n_nationkey AS url, n_name || ' in region ' || n_regionkey AS wikitext, 'Category:Nations' AS categories, CASE WHEN n_nationkey % 3 <> 0 THEN 'N' || n_nationkey END AS aliases FROM nation WHERE n_nationkey % 10 <> 9"),
    "prompts": (prompts, "SELECT item_id, md5('Excerpts:' || chr(10) || chr(10) || '[1] x' || chr(10) || 'y' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Answer from these excerpts only, with their numbers as citations.') AS md5 FROM benchmark"),
    "sub_questions": (sub_questions, f"SELECT item_id, CASE WHEN item_id % 5 = 0 THEN '' ELSE 'Who ' || {FOUR} || '? / What ' || {FOUR} || '?' END AS parts FROM benchmark WHERE len({FLAT}) >= 4"),
    "answers": (answers, f"SELECT r_regionkey AS region, CASE WHEN r_regionkey % 10 = 0 THEN '{answer.NO_CONTEXT}' ELSE 'large what of ' || r_regionkey END AS text, CASE WHEN r_regionkey % 10 <> 0 THEN 'large' END AS model, CASE WHEN r_regionkey % 10 = 0 THEN 0 ELSE 1 END AS sources, CASE WHEN r_regionkey % 10 = 0 THEN 3 ELSE 4 END AS events FROM region"),
    "embed_documents": (embed_documents, "SELECT doc_id AS chunk_id, round(length(text) / sqrt(length(text)::DOUBLE * length(text) + 90000), 4) AS a, round(300 / sqrt(length(text)::DOUBLE * length(text) + 90000), 4) AS b FROM documents WHERE doc_id % 3 <> 0"),
    "prune_index": (prune_index, "SELECT 'pages' AS name, count(*) AS n FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT 'chunks', count(*) FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0)"),
}
