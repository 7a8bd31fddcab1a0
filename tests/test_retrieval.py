"""The index against SQLite's own full-text search, fusion, packing, and the pipeline end to end."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from lorekeep.config import Settings
from lorekeep.operators import fusion, index, vectors
from lorekeep.plans import build, retrieve

ROWS = [
    (1, "Al-Kafi", "", "kafi usul", "The book of hadith compiled in Baghdad over twenty years"),
    (2, "Nahj", "Life", "", "A book of sermons, and hadith of the imam. Hadith again."),
    (3, "Other", "Summary", "rareword", "Nothing to see but a kafi cup"),
    (4, "More", "", "", "al kafi is named here"),
    *[(i, f"Filler {i}", "", "", "words that nobody asks for " * i) for i in range(5, 12)],
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(ROWS, "chunk_id long, title string, section string, aliases string, text string")


def fts(query: str) -> list[tuple[int, float]]:
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(title, section, aliases, text, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("insert into f(rowid, title, section, aliases, text) values (?,?,?,?,?)", ROWS)
    return [(r, round(s, 6)) for r, s in db.execute("select rowid, bm25(f, 6.0, 2.0, 4.0, 1.0) s from f where f match ? order by s, rowid", (query,))]


def test_bm25_equals_fts5(spark, chunks):
    q = spark.createDataFrame([(1, ["hadith", "book", "rareword"])], "qid long, terms array<string>")
    got = index.bm25(q, chunks, ["title", "section", "aliases", "text"], 30, index.WEIGHTS).orderBy("rank").collect()
    want = fts('"hadith" OR "book" OR "rareword"')
    assert [r.chunk_id for r in got] == [i for i, _ in want]
    assert [r.score for r in got] == pytest.approx([s for _, s in want], abs=2e-6)


def test_phrase_equals_fts5(spark, chunks):
    cols = ["title", "section", "aliases", "text"]
    q = spark.createDataFrame([(1, ["al", "kafi"])], "qid long, phrase array<string>")
    got = index.phrase_bm25(q, index.postings(chunks, cols), index.lengths(chunks, cols), 30, index.WEIGHTS).orderBy("rank").collect()
    want = fts('"al kafi"')
    assert [(r.chunk_id, r.score) for r in got] == [(i, pytest.approx(s, abs=2e-6)) for i, s in want]


def test_rrf_order_and_double_finds(spark):
    rows = [(1, "a", 10, 1), (1, "a", 11, 2), (1, "b", 11, 1), (1, "b", 12, 2), (1, "off", 13, 1)]
    r = spark.createDataFrame(rows, "qid long, channel string, chunk_id long, rank int")
    got = fusion.rrf(r, [("a", 1.0, 60), ("b", 1.0, 60), ("off", 0.0, 60)]).orderBy("rank").collect()
    assert [x.chunk_id for x in got] == [11, 10, 12] and got[0].a_rank == 2 and got[0].b_rank == 1


def test_packing_skips_but_keeps_the_first(spark):
    hits = spark.createDataFrame([(1, 1, 50), (1, 2, 500), (1, 3, 40), (2, 1, 900), (2, 2, 1)], "qid long, position int, tokens int")
    got = {r.qid: ([u.position for u in r.used], r.context_tokens) for r in fusion.packed(hits, 100).collect()}
    assert got == {1: ([1, 3], 90), 2: ([1], 900)}


def test_knn_blocks_agree_with_brute_force(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(50)], "vec_id long, embedding array<float>").repartition(4)
    got = vectors.knn(v, [(0, [0.0, 0.0, 1.0]), (1, [6.0, 2.0, 1.0])], 3).orderBy("qid", "rank").collect()
    assert [r.vec_id for r in got] == [0, 21, 42, 20, 41, 6] or [r.distance for r in got][:3] == [0.0, 0.0, 0.0]


def test_maintenance(spark):
    pages = spark.createDataFrame([(1, "A"), (2, "B (disambiguation)")], "page_id long, title string")
    ch = spark.createDataFrame([(10, 1), (20, 2)], "chunk_id long, page_id long")
    vec = spark.createDataFrame([(10,), (20,), (99,)], "chunk_id long")
    out = index.prune({"pages": pages, "chunks": ch, "vectors": vec})
    assert {n: [r["page_id" if n == "pages" else "chunk_id"] for r in t.collect()] for n, t in out.items()} == {"pages": [1], "chunks": [10], "vectors": [10]}
    assert [r.chunk_id for r in index.missing_vectors(ch, vec.where("chunk_id = 10")).collect()] == [20]
    up = index.upsert(ch, spark.createDataFrame([(10, 7)], "chunk_id long, page_id long"), ["chunk_id"])
    assert sorted(tuple(r) for r in up.collect()) == [(10, 7), (20, 2)]


RAW = [
    (1, 0, "Al-Kafi", "u1", ["Category:Books"], "{{Infobox book|author=[[Kulayni]]}}'''Al-Kafi''' is a collection of hadith that was compiled with care over twenty years in Baghdad.\n== Content ==\nIt has three parts, the usul, the furu and the rawda, and many chapters on law and belief."),
    (2, 0, "Kulayni", "u2", [], "{{Infobox scholar|works=[[Al-Kafi]]|born=864 CE|teachers=[[Qummi]]}}Kulayni was a collector of hadith who lived in Rayy and in Baghdad, and died there after a long life."),
    (3, 0, "Qummi", "u3", [], "Qummi taught many of the people of his city, which was a place of learning at that time and later."),
    (4, 0, "Kafi (disambiguation)", "u4", [], "{{disambig}} nothing"),
    (5, 14, "Category:Books", "u5", ["Category:Works"], ""),
]
SCHEMA = "pageid long, ns int, title string, url string, categories array<string>, wikitext string"


@pytest.fixture(scope="module")
def built(spark):
    from lorekeep.operators import extract as ex

    raw = spark.createDataFrame(RAW, SCHEMA)
    onto = ex.Ontology(
        {"Book": ("infobox book",), "Scholar": ("infobox scholar",)},
        (ex.Predicate("authored_by", "was written by", ("author",), inverse="authored", range_classes=("Scholar",), priority=0), ex.Predicate("authored", "wrote", ("works",), inverse="authored_by", range_classes=("Book",), priority=0), ex.Predicate("taught_by", "was taught by", ("teachers",), priority=0), ex.Predicate("born_on", "was born on", ("born",), range="date")),
    )
    assert onto.problems() == []
    redirects = spark.createDataFrame([("The Sufficient", "Al-Kafi"), ("X", "Nowhere")], "alias string, target string")
    tables = {n: t.cache() for n, t in ex.extract(raw, redirects, onto).items()}
    return raw, redirects, tables


def test_extraction(built):
    _, _, t = built
    edges = {(r.s, r.p, r.o) for r in t["edges"].collect()}
    assert edges == {("page:1", "authored_by", "page:2"), ("page:2", "authored", "page:1"), ("page:2", "taught_by", "page:3"), ("page:2", "born_on", "date:ce:0864"), ("page:1", "instance_of", "cat:Books"), ("cat:Books", "subclass_of", "cat:Works")}
    assert {r.id for r in t["nodes"].collect()} == {"page:1", "page:2", "page:3", "cat:Books", "cat:Works", "date:ce:0864"}
    assert {(r.s, r.o, r.n) for r in t["links"].collect()} == {("page:1", "page:2", 1), ("page:2", "page:1", 1), ("page:2", "page:3", 1)}
    assert t["nodes"].where("id = 'page:1'").first().aliases == ["The Sufficient"]


def test_pipeline_finds_by_text_title_and_graph(spark, built):
    from lorekeep.sources.tables import aliases

    raw, redirects, t = built
    made = build.build_index(raw, aliases(redirects), noise=["image"])
    assert made["pages"].count() == 3
    made = {n: x.cache() for n, x in made.items()}
    nodes = t["nodes"].withColumn("classes", F.array().cast("array<string>"))
    edges = t["edges"].withColumn("eid", F.xxhash64("s", "p", "o"))
    ix = retrieve.Index(made["chunks"], made["pages"], None, nodes, edges, t["predicates"])
    q = spark.createDataFrame([(1, "Who wrote the Sufficient?"), (2, "place of learning")], "qid long, question string")
    hits = retrieve.retrieve(q, ix, Settings()).cache()
    by = {}
    for r in hits.orderBy("qid", "position").collect():
        by.setdefault(r.qid, []).append(r)
    assert by[1][0].page_id == 1 and any(r.graph_rank for r in by[1]) and {2, 3} <= {r.page_id for r in by[1]}
    assert by[2][0].page_id == 3
    ctx = retrieve.contexts(hits).where("qid = 1").first()
    assert ctx.context.startswith("[1] Al-Kafi") and ctx.context_tokens > 0
    parts = spark.createDataFrame([(1, 0, "Kulayni hadith collector"), (1, 1, "Qummi place of learning")], "qid long, part int, question string")
    assert {2, 3} <= {r.page_id for r in retrieve.merged_parts(parts, ix).collect()}
    plain = retrieve.retrieve(q, retrieve.Index(made["chunks"], made["pages"]), Settings())
    off = retrieve.retrieve(q, ix, Settings(weight_graph=0.0))
    key = lambda d: [(r.qid, r.position, r.chunk_id) for r in d.orderBy("qid", "position").collect()]
    assert key(plain) == key(off)
