"""Scalar functions, cleaning and chunking."""

from pyspark.sql import functions as F

from lorekeep.functions import dates, narrate
from lorekeep.functions import text as tx
from lorekeep.functions import wikitext as wt
from lorekeep.operators import chunking as ck


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first().x


def test_question_and_title_terms(spark):
    assert one(spark, "What is the Al-Kāfī book, and the 'book' of Ali?", tx.query_terms) == ["al-kāfī", "book", "ali"]
    assert sorted(one(spark, "The Book of Çelebi (poet)", tx.title_terms)) == ["celebi"]
    assert one(spark, "Ṭālib's ḥadīth_x", tx.tokens) == ["talib", "s", "hadith", "x"]
    assert one(spark, None, tx.query_terms) == []


def test_titles_links_and_slugs(spark):
    assert one(spark, " some_page #part ", tx.page_title) == "Some page"
    assert one(spark, "[[A b|shown]] and [[C]]", tx.wiki_links) == ["A b", "C"]
    assert [one(spark, t, tx.is_content_link) for t in ("Ali", "en:Ali", "File:x.png", "Text:Prayer")] == [True, False, False, True]
    assert one(spark, "Dhu l-Qa'da", tx.slug) == "dhu-l-qada"
    assert one(spark, "[[Place|Birth_place]] of-x", tx.field_name) == "birth place of x"
    assert one(spark, "</script>", tx.html_safe) == "<\\/script>"


PAGE = """<!-- c -->{{Infobox person|name=Ali|birth_place=[[Kufa]]|image=-|x=}} '''Ali''' was al-Shifa''s son.<ref name="a">A [[Book|book]]</ref><ref name="a" />
{{Main|Other page}}
== Life ==
{{quote box|title=T|quote=Be good|author=Him}} He {{lang|ar|did}} things. [[File:x.png|thumb|a [[b]] c]]
* one
*
# two
=== Youth ===
{{unknown|short}}{{unknown|this parameter is long enough to be kept as running text}}
== References ==
gone
{|
| table
|}"""


def test_clean_page():
    p = wt.clean_page(PAGE)
    assert p["infobox"] == [{"k": "Name", "v": "Ali"}, {"k": "Birth Place", "v": "Kufa"}]
    assert p["summary"] == "Ali was al-Shifas son." and p["citations"] == ["A book"] and p["pointers"] == ["Other page"]
    life, youth = p["sections"]
    assert life["path"] == ["Life"] and youth["path"] == ["Life", "Youth"] and len(p["sections"]) == 2
    assert 'T: "Be good" — Him' in life["text"] and "He did things." in life["text"] and life["text"].endswith("- one\n- two")
    assert youth["text"] == "this parameter is long enough to be kept as running text"


def test_clean_pages_frame(spark):
    raw = spark.createDataFrame([(1, 0, "T", "u", ["Category:X"], PAGE), (2, 0, "E", None, None, None)], "pageid long, ns int, title string, url string, categories array<string>, wikitext string")
    rows = {r.page_id: r for r in wt.clean_pages(raw).collect()}
    assert rows[1].categories == ["X"] and len(rows[1].sections) == 2 and rows[2].summary == ""


def test_section_stack(spark):
    levels = spark.sql("select array(named_struct('level',2,'name','A'),named_struct('level',3,'name','B'),named_struct('level',2,'name','C'),named_struct('level',4,'name','D')) h")
    assert levels.select(ck.section_paths(F.col("h")).alias("p")).first().p == [["A"], ["A", "B"], ["C"], ["C", "D"]]


def test_chunks_keep_limits_and_sections(spark):
    sizes = ck.ChunkSizes(100, 160, 20, 5)
    text = "\n\n".join(f"Sentence number {i} is here. It has a second part, {i}." for i in range(60))
    rows = spark.createDataFrame([(1, 0, "Summary", "summary", text), (1, 1, "Life", "body", "Z" * 1500), (1, 2, "Tiny", "body", "x")], "page_id long, section_no int, section string, kind string, text string")
    out = ck.chunk_sections(rows, sizes).orderBy("ordinal").collect()
    assert [r.ordinal for r in out] == list(range(len(out))) and {r.section for r in out} == {"Summary", "Life"}
    assert all(r.tokens <= 160 * 1.25 for r in out)
    assert sum(len(r.text) for r in out if r.section == "Life") >= 1500


def test_dates(spark):
    day = lambda t: one(spark, t, lambda c: dates.node_id(dates.parsed(c)))
    assert day("Sha'ban 15, 255 AH") == "date:ah:0255-08-15" and day("May 15, 1990 CE") == "date:ce:1990-05-15"
    assert day("4 BH") == "date:bh:0004" and day("Rabi’ I 12") == "date:ah-md:03-12" and day("nothing") is None
    assert one(spark, "Rajab 13", lambda c: dates.label_of(dates.of_field(c, F.array(F.lit("30 BH"), F.lit("March 15, 600 CE"))))) == "Rajab 13 / 30 BH / March 15, 600 CE"


def test_narrate(spark):
    preds = spark.createDataFrame([("taught_by", "was taught by", "taught"), ("taught", "taught", "taught_by"), ("records", "records", None)], "p string, label string, inverse string")
    rows = [
        ("A", ["taught_by", "taught_by"], ["out", "out"], ["B", "C"], [False, True], "A was taught by B, who was taught by C."),
        ("A", ["records", "taught_by"], ["in", "out"], ["B", "C"], [False, True], "B records A, and B was taught by C."),
        ("A", ["taught", "taught_by"], ["in", "in"], ["B", "C"], [False, False], "A was taught by B, which taught C."),
        ("A", ["taught", "records", "taught"], ["out", "in", "out"], ["B", "C", "D"], [True] * 3, "A taught B, and C records B, and C taught D."),
        ("A", ["taught", "x", "taught"], ["out", "out", "out"], ["B", "C", "D"], [True] * 3, "A taught B."),
        ("A", ["x"], ["out"], ["B"], [False], None), ("A", ["taught"], ["out"], [None], [False], None),
    ]
    d = spark.createDataFrame(rows, "s string, p array<string>, d array<string>, l array<string>, w array<boolean>, want string")
    got = d.withColumn("got", narrate.narrated(preds, *[F.col(c) for c in "spdlw"])).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_comparison_line(spark):
    row = spark.createDataFrame([("A", "B", "wrote", ["x", "y"], ["y"], ["y"])], "a string, b string, v string, x array<string>, y array<string>, s array<string>")
    line = narrate.narrated_comparison(*[F.col(c) for c in ("a", "b", "v", "x", "y", "s")])
    assert row.select(line.alias("l")).first().l == "A wrote x, y; B wrote y (both: y)."


def test_default_ontology_is_consistent():
    from lorekeep.functions import ontology

    o = ontology.default()
    assert o.problems() == [] and len(o.predicates) == 69 and len(o.classes) == 17
    names = {p.name for p in o.predicates}
    assert set(ontology.NO_TRANSIT) <= names and sum(p.priority < 3 for p in o.predicates) == 33
