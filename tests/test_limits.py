"""Findings on odd rows and larger tables, each by a small case that failed before."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lorekeep.queries import catalogue


def against_sql(spark, folder, name, tables):
    """The query's rows and its SQL's over the tables in folder."""
    build, sql = catalogue()[name]
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    df = build(spark, str(folder))
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in names]
    return got, sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["paragraph_split", "chunk_pack"])
def test_lines_keep_the_digits_of_their_number(spark, tmp_path, name):
    text = "0 nought 0\n1219 one 1\n \u00a022 two 2\u3000 \n\t3 three\n\n5 five 5"
    spark.createDataFrame([(1, text), (2, "0"), (3, None), (4, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = against_sql(spark, tmp_path, name, ["documents"])
    assert got == want and got
    if name == "paragraph_split":
        assert hashlib.md5(b"1219 one 1").hexdigest() in {r[2] for r in got}


def test_pages_made_of_a_small_table_are_dealt_over_tasks(spark, tmp_path):
    from lorekeep.queries import wiki

    p = spark.range(25_000).selectExpr("id as p_partkey", "concat('bolt ', id % 7) as p_name", "'Brand#1' as p_brand", "'LARGE' as p_type")
    p.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    books = wiki.raw_pages(spark, str(tmp_path)).where("pageid < 1000000000")
    sizes = sorted(r["count"] for r in books.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 3 and sizes[-1] < 2 * sizes[0] and sum(sizes) == 25_000


def test_extraction_parses_a_page_once(spark):
    from lorekeep.operators import extract as ex
    from lorekeep.queries import wiki
    from lorekeep.sources import tables

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    text = "{{Infobox book|author=[[maker_1]]|published=May 1, 1900 CE|series=[[Maker 1]]}} [[Maker 1]]"
    raw = spark.createDataFrame([(i, 0, t, "u", None, None, ["Category:Books"], text) for i, t in ((1, "Book"), (2, "Maker 1"))], tables.RAW_PAGE).withColumn("wikitext", counted("wikitext"))
    made = ex.extract(raw, spark.createDataFrame([], "alias string, target string"), wiki.ONTOLOGY)
    rows = {n: df.count() for n, df in made.items()}
    assert rows["edges"] == 4 and rows["links"] == 1 and rows["unmapped"] == 1
    assert read.value <= 2 * 3


@pytest.mark.parametrize("pages", [2, None])
def test_title_coverage_of_equal_names_and_aliases(spark, pages):
    import random

    from lorekeep.operators import fusion

    r = random.Random(3)
    some = lambda most: r.sample("abcdef", r.randrange(most + 1))
    names = [(i % 60, some(3)) for i in range(150)]
    questions = [(i, some(5)) for i in range(40)]
    want = []
    for q, terms in questions:
        best = {}
        for p, name in names:
            if name and (hits := len(set(name) & set(terms))) / len(name) >= 0.6:
                best[p] = max(best.get(p, (0, 0)), (hits / len(name), hits))
        order = sorted(best, key=lambda p: (-best[p][0], -best[p][1], -sum(x == p for x, _ in names), p))
        want += [(q, p, *best[p], n) for n, p in enumerate(order[:pages], 1)]
    q = spark.createDataFrame(questions, "qid int, terms array<string>")
    got = fusion.title_coverage(q, spark.createDataFrame(names, "page_id int, terms array<string>"), pages=pages)
    assert sorted((x.qid, x.page_id, x.coverage, x.hits, x["rank"]) for x in got.collect()) == sorted(want)


def test_equal_names_are_not_paired_with_all_equal_questions(spark):
    from lorekeep.operators import fusion

    many = spark.range(20_000)
    q = many.selectExpr("id as qid", "array('alpha', 'beta', 'gamma') as terms").where("qid < 5000")
    got = fusion.title_coverage(q, many.selectExpr("id as page_id", "array('alpha', 'beta') as terms"), pages=1)
    assert [tuple(r) for r in got.groupBy("page_id", "coverage", "hits").count().collect()] == [(0, 1.0, 2, 5000)]


@pytest.mark.parametrize("few", [0, 1000])
def test_rows_for_keys_by_filter_and_by_list(spark, monkeypatch, few):
    from lorekeep.operators import keys

    monkeypatch.setattr(keys, "FEW", few)
    rows = spark.range(20_000).selectExpr("concat('n:', id) as s", "id as o")
    asked = spark.range(900).selectExpr("if(id = 0, null, concat('n:', id * 50)) as anchor")
    got = keys.among(rows.unionByName(rows.limit(60)), "s", keys.Keys(asked.unionByName(asked)))
    assert got.columns == ["s", "o"] and sorted(r.o for r in got.collect()) == sorted([*range(50, 20_000, 50), 50])
    assert not keys.among(rows, "s", keys.Keys(asked.where("false"))).count()


def test_walk_moves_edges_of_its_nodes_only(spark):
    from lorekeep.operators import graph

    nodes = spark.range(4000).selectExpr("concat('n', id) as id", "'entity' as kind", "concat('l', id) as label", "id as page_id")
    edges = spark.range(4000).selectExpr("concat('n', id) as s", "'to' as p", "concat('n', (id + 1) % 4000) as o", "id as eid")
    preds = spark.createDataFrame([("to", "leads to", None, 1)], "p string, label string, inverse string, priority int")
    asked = []

    def near(anchors):
        out = graph.adjacency(nodes, edges, preds, anchors=anchors)
        asked.append(out.count())
        return out

    seeds = spark.createDataFrame([(1, "n7"), (2, "n9")], "qid int, anchor string")
    got = graph.walk(near, seeds, lambda ids: graph.degrees(nodes, edges, ids), preds, [], [])
    whole = graph.walk(graph.adjacency(nodes, edges, preds), seeds, graph.degrees(nodes, edges), preds, [], [])
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and asked == [4, 6]


def test_postings_of_asked_terms_only(spark):
    from lorekeep.operators import index

    docs = spark.createDataFrame([(1, "a b a c"), (2, "c d"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([("a",), ("d",), ("a",)], "term string")
    got = index.postings(docs, ["text"], "doc_id", asked).collect()
    assert sorted((r.doc_id, r.term, r.positions) for r in got) == [(1, "a", [0, 2]), (2, "d", [1])]


def test_numbers_over_several_ranges_without_a_list_of_bounds(spark, monkeypatch):
    from lorekeep.operators import curate

    monkeypatch.setattr(curate, "RANGE_ROWS", 100, raising=False)
    rows = spark.range(1000).selectExpr("concat('n:', id * 7919 % 1000) as id", "id as was").repartition(5).cache()
    made = curate.numbered(rows.unionByName(spark.sql("select cast(null as string) as id, -1L as was")), "id", 8)
    assert "lambda" not in made._jdf.queryExecution().toString()
    got = {r.n: (r.id, r.was) for r in made.collect()}
    want = sorted((f"n:{i * 7919 % 1000}", i) for i in range(1000))
    assert made.columns == ["id", "was", "n"] and [got[n] for n in range(1001)] == [(None, -1), *want]
    assert not curate.numbered(rows.where("false"), "id").count()


def test_pairs_of_the_lines_are_distinct_and_in_order(spark, tmp_path):
    from lorekeep.queries import graph

    lines = spark.range(3000).selectExpr("id * 31 % 700 as l_orderkey", "id * 17 % 90 as l_partkey", "id % 4 as l_suppkey")
    lines.unionByName(lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name, (a, b) in {"contains": ("l_orderkey", "l_partkey"), "supplied_by": ("l_partkey", "l_suppkey")}.items():
        pairs = graph._pairs(spark, str(tmp_path))[name]
        each = [[tuple(r[1:]) for r in rows] for rows in _by_file(pairs.select(F.input_file_name(), a, b))]
        assert all(rows == sorted(rows) for rows in each)
        assert sorted(sum(each, [])) == sorted({(r[a], r[b]) for r in lines.collect()})


def test_chains_look_among_all_edges_four_times(spark, monkeypatch):
    from lorekeep.operators import graph as g
    from lorekeep.queries import graph

    looked = []
    for name in ("adjacency", "degrees"):
        real = getattr(g, name)
        monkeypatch.setattr(g, name, lambda *a, _real=real, _name=name, **k: looked.append(_name) or _real(*a, **k))
    rows = graph.graph_context(spark, "/root/testdata/sf0.001")
    assert rows.count() and looked.count("adjacency") <= 2 and looked.count("degrees") <= 2


def test_expanded_paths_show_the_prominence_they_were_ordered_by(spark):
    from lorekeep.operators import graph

    paths = spark.createDataFrame([(1, "s", 1, "a", 1.0, ["A"], 1), (1, "s", 1, "b", 1.0, ["B"], 2), (1, "s", 1, "c", 1.0, ["C"], 3)], "qid int, seed string, depth int, node string, score double, labels array<string>, trail int")
    known = spark.createDataFrame([("a", 1), ("b", 5)], "id string, prominence long")
    got = graph.expand(paths, 3, known, shown=True).orderBy("position").collect()
    assert [(r.node, r.prominence) for r in got] == [("b", 5), ("a", 1), ("c", None)]
    assert "prominence" not in graph.expand(paths, 3, known).columns


def test_index_of_a_batch_keeps_its_terms_and_all_lengths(spark):
    from lorekeep.operators import index

    docs = spark.createDataFrame([(1, "a b a c"), (2, "c d"), (3, None), (4, "x y z a")], "doc_id long, text string")
    asked = spark.createDataFrame([("a",), ("d",), ("a",)], "term string")
    made = index.counted(docs, ["text"], "doc_id", asked)
    assert sorted((r.doc_id, r.term, r.f, r.d) for r in made["postings"].collect()) == [(1, "a", 2, 4), (2, "d", 1, 2), (4, "a", 1, 4)]
    assert tuple(made["stats"].first()) == (4, 2.5)
    q = spark.createDataFrame([(1, ["a", "d"]), (2, ["d"])], "qid int, terms array<string>")
    whole = index.bm25_of(index.counted(docs, ["text"], "doc_id"), q, 5, {"text": 1.0}, "doc_id")
    assert sorted(map(tuple, index.bm25_of(made, q, 5, {"text": 1.0}, "doc_id").collect())) == sorted(map(tuple, whole.collect()))


@pytest.fixture
def star(spark, tmp_path):
    """A folder of small star tables, in which most lines state the pairs of another."""
    rows = lambda n, *cols: spark.range(n).selectExpr(*cols)
    tables = {
        "region": rows(2, "id as r_regionkey", "concat('R', id) as r_name"),
        "nation": rows(5, "id as n_nationkey", "concat('N', id) as n_name", "id % 2 as n_regionkey"),
        "customer": rows(90, "id as c_custkey", "concat('C', id) as c_name", "id % 5 as c_nationkey"),
        "supplier": rows(7, "id as s_suppkey", "concat('S', id) as s_name", "id % 5 as s_nationkey"),
        "part": rows(50, "id as p_partkey", "concat('P', id % 9) as p_name", "concat('T', id % 3) as p_type"),
        "orders": rows(300, "id as o_orderkey", "id * 7 % 90 as o_custkey", "timestamp'2001-01-01' + make_interval(0, 0, 0, int(id % 40)) as o_orderdate"),
        "lineitem": rows(2400, "id * 31 % 300 as l_orderkey", "id * 31 % 300 * 11 % 50 + id % 2 as l_partkey", "id % 4 as l_suppkey").where("l_partkey < 50"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return tmp_path, list(tables)


@pytest.mark.parametrize("name", ["context_facts", "facts", "neighbour_pages", "compare_pair", "degrees", "prominence"])
def test_one_look_among_the_edges_makes_no_table_of_all_pairs(spark, star, monkeypatch, name):
    from lorekeep.queries import graph

    monkeypatch.setattr(graph, "_pairs", lambda *a: pytest.fail("the pairs of all lines were made"))
    got, want = against_sql(spark, star[0], name, star[1])
    assert got == want and got


def test_edges_around_anchors_count_once_and_move_their_own_nodes_only(spark, monkeypatch):
    from lorekeep.operators import graph

    looked, real = [], graph.among
    monkeypatch.setattr(graph, "among", lambda rows, key, keys: looked.append((key, keys.n)) or real(rows, key, keys))
    nodes = spark.range(4000).selectExpr("concat('n', id) as id", "'entity' as kind", "concat('l', id) as label", "id as page_id")
    once = spark.range(4000).selectExpr("concat('n', id) as s", "'to' as p", "concat('n', (id + 1) % 4000) as o")
    lines = spark.range(8000).selectExpr("concat('n', id % 4000) as s", "'by' as p", "concat('n', (id + 2) % 4000) as o")
    preds = spark.createDataFrame([("to", "leads to", None, 1)], "p string, label string, inverse string, priority int")
    asked = spark.createDataFrame([("n7",), ("n900",)], "anchor string")
    got = graph.adjacency(nodes, once, preds, anchors=asked, eid=F.xxhash64("s", "p", "o"), repeated=lines)
    want = {(f"n{i}", d, p, f"n{i + k}", f"l{i + k}") for i in (7, 900) for d, p, k in (("out", "to", 1), ("in", "to", -1), ("out", "by", 2), ("in", "by", -2))}
    assert sorted((r.anchor, r.dir, r.p, r.other, r.other_label) for r in got.collect()) == sorted(want)
    assert ("other", 8) in looked


def test_classes_of_all_nodes_move_rows_once(spark):
    from lorekeep.operators import graph

    rows = spark.createDataFrame([("a", "X"), ("a", None), ("b", None), ("a", "W"), ("a", "X"), ("c", "X"), ("b", None)], "node string, class string")
    made = graph.classes_of(rows)
    some = graph.classes_of(rows.where("class is not null"), rows.select(F.col("node").alias("id")))
    assert sorted((r.id, r.classes) for r in made.collect()) == sorted((r.id, r.classes) for r in some.collect()) == [("a", ["W", "X"]), ("b", []), ("c", ["X"])]
    assert made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    assert not graph.classes_of(rows.where("false")).count()


def _by_file(rows):
    found = {}
    for r in rows.collect():
        found.setdefault(r[0], []).append(r)
    return found.values()
