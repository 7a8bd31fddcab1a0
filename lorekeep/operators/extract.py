"""Knowledge-graph extraction from raw pages: nodes, typed edges, dates, taxonomy, links."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import dates
from lorekeep.functions import text as tx
from lorekeep.functions.wikitext import infobox_fields
from lorekeep.operators.chunking import is_navigation
from lorekeep.operators.curate import apply_overrides
from lorekeep.sources.tables import kept


@dataclass(frozen=True)
class Predicate:
    """A relation and the infobox fields that state it."""

    name: str
    label: str
    fields: tuple[str, ...] = ()
    range: str = "entity"
    inverse: str | None = None
    domain: tuple[str, ...] = ()
    range_classes: tuple[str, ...] = ()
    priority: int = 3


@dataclass(frozen=True)
class Ontology:
    """classes maps a class to its templates; noise fields carry no relation."""

    classes: dict[str, tuple[str, ...]]
    predicates: tuple[Predicate, ...]
    noise: tuple[str, ...] = ()
    symmetric: tuple[str, ...] = field(default=())

    def problems(self) -> list[str]:
        """What is inconsistent, one line each."""
        names, bad, used = {p.name for p in self.predicates}, [], {}
        for p in self.predicates:
            if p.range not in ("entity", "date"):
                bad.append(f"{p.name}: unknown range {p.range}")
            if p.inverse and p.inverse not in names:
                bad.append(f"{p.name}: its inverse {p.inverse} does not exist")
            bad += [f"{p.name}: unknown class {c}" for c in (*p.domain, *p.range_classes) if c not in self.classes]
            for f in p.fields:
                if f in self.noise:
                    bad.append(f"{p.name}: field {f} is also noise")
                if not p.domain and used.setdefault(f, p.name) != p.name:
                    bad.append(f"field {f} means both {used[f]} and {p.name}")
        return bad

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(predicates, field map, class map)."""
        p = spark.createDataFrame([(x.name, x.label, x.range, x.inverse, list(x.range_classes), x.priority) for x in self.predicates], "p string, label string, range string, inverse string, range_classes array<string>, priority int")
        f = spark.createDataFrame([(n, x.name, d) for x in self.predicates for n in x.fields for d in x.domain or (None,)], "field_name string, p string, domain string")
        c = spark.createDataFrame([(t, c, i) for i, (c, ts) in enumerate(self.classes.items()) for t in ts], "template string, class string, class_no int")
        return p, f, c


def page_index(raw: DataFrame, redirects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages (page_id, title, node, aliases), names (name, node): titles and one redirect hop)."""
    pages = raw.where((F.col("ns") != 14) & ~is_navigation(F.col("title"), F.col("wikitext"))).select(F.col("pageid").cast("long").alias("page_id"), tx.page_title(F.col("title")).alias("title"), "url")
    pages = kept(pages.withColumn("node", F.concat(F.lit("page:"), F.col("page_id").cast("string"))))
    direct = pages.select(F.col("title").alias("name"), "node")
    red = redirects.select(tx.page_title(F.col("alias")).alias("name"), tx.page_title(F.col("target")).alias("title"))
    hop = red.join(pages, "title").select("name", "node")
    aliases = hop.groupBy("node").agg(F.array_sort(F.collect_set("name")).alias("aliases"))
    names = kept(direct.unionByName(hop.join(direct, "name", "left_anti")).dropDuplicates(["name"]))
    return pages.join(aliases, "node", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))), names


def extract(raw: DataFrame, redirects: DataFrame, onto: Ontology, rules: DataFrame | None = None) -> dict[str, DataFrame]:
    """nodes, edges (s, p, o, src, field, raw), links (s, o, n), classes (node, class) and unmapped (template, field, pages, links).

    What several of them are made of (pages, names, fields, what fields mean) is written once, so
    the pages are read three times: for titles, for templates and for links.
    """
    spark = raw.sparkSession
    preds, field_map, class_map = onto.tables(spark)
    pages, names = page_index(raw, redirects)
    fields = kept(infobox_fields(raw).withColumn("template", tx.field_name(F.col("template"))).join(pages.select("page_id", "node"), "page_id"))
    classes = fields.join(F.broadcast(class_map), "template").select("node", "class", "class_no").distinct()

    named = fields.where("field is not null").withColumn("field_name", tx.field_name(F.col("field"))).where(~F.col("field_name").isin(list(onto.noise)))
    named = named.withColumn("fid", F.xxhash64("node", "template", "field", "raw"))
    met = named.join(F.broadcast(field_map), "field_name", "left").join(classes.select("node", F.col("class").alias("domain"), F.lit(True).alias("has")), ["node", "domain"], "left")
    met = met.where(F.col("p").isNull() | F.col("domain").isNull() | F.col("has"))
    one = Window.partitionBy("fid").orderBy(F.col("domain").isNull(), F.col("p").isNull(), "p")
    best = kept(met.withColumn("k", F.row_number().over(one)).where("k = 1").drop("k", "domain", "has").join(F.broadcast(preds.select("p", "range", "range_classes")), "p", "left"))

    linked = best.withColumn("target", F.explode_outer(F.array_distinct(tx.wiki_links(F.col("raw")))))
    linked = linked.withColumn("name", tx.page_title(F.col("target"))).join(names.select("name", F.col("node").alias("o")), "name", "left")
    typed = linked.where("range = 'entity' and o is not null and o <> node")
    of = classes.groupBy(F.col("node").alias("o")).agg(F.collect_set("class").alias("o_classes"))
    typed = typed.join(of, "o", "left").where((F.size("range_classes") == 0) | F.col("o_classes").isNull() | F.arrays_overlap("range_classes", "o_classes"))
    edge = lambda df, src: df.select(F.col("node").alias("s"), "p", "o", F.lit(src).alias("src"), "field", F.substring("raw", 1, 300).alias("raw"))
    facts = edge(typed, "infobox").dropDuplicates(["s", "p", "o"])

    dated = best.where("range = 'date'").withColumn("v", dates.of_field(F.col("raw"), F.transform(tx.wiki_links(F.col("raw")), tx.page_title)))
    dated = dated.withColumn("o", dates.node_id(F.col("v"))).where("o is not null")
    date_edges = edge(dated, "infobox").dropDuplicates(["s", "p", "o"])

    bare = lambda c: F.regexp_replace(c, r"(?i)^\s*category\s*:\s*", "")
    cats = raw.select(F.col("pageid").cast("long").alias("page_id"), "ns", "title", F.explode("categories").alias("cat")).withColumn("o", F.concat(F.lit("cat:"), bare(F.col("cat"))))
    none = [F.lit(None).cast("string").alias(c) for c in ("field", "raw")]
    inst = cats.join(pages.select("page_id", "node"), "page_id").select(F.col("node").alias("s"), F.lit("instance_of").alias("p"), "o", F.lit("category").alias("src"), *none)
    sub = cats.where("ns = 14").select(F.concat(F.lit("cat:"), bare(F.col("title"))).alias("s"), F.lit("subclass_of").alias("p"), "o", F.lit("category").alias("src"), *none).where("s <> o").distinct()
    edges = facts.unionByName(date_edges).unionByName(inst).unionByName(sub)
    report = None
    if rules is not None:
        typed_only = edges.where(~F.col("p").isin("instance_of", "subclass_of"))
        ends = rules.join(names.select(F.col("name").alias("subject"), F.col("node").alias("s")), "subject", "left").join(names.select(F.col("name").alias("object"), F.col("node").alias("o")), "object", "left")
        done, report = apply_overrides(typed_only, ends.where("s is not null and (object is null or o is not null)").select("action", "s", F.col("predicate").alias("p"), "o"))
        edges = done.withColumn("src", F.coalesce("src", F.lit("manual"))).unionByName(edges.where(F.col("p").isin("instance_of", "subclass_of")))

    out = raw.select(F.col("pageid").cast("long").alias("page_id"), F.explode(tx.wiki_links(F.col("wikitext"))).alias("t")).where(tx.is_content_link(F.col("t")))
    links = out.join(pages.select("page_id", F.col("node").alias("s")), "page_id").withColumn("name", tx.page_title(F.col("t"))).join(names.select("name", F.col("node").alias("o")), "name").where("s <> o").groupBy("s", "o").agg(F.count("*").alias("n"))
    entity = pages.select(F.col("node").alias("id"), F.lit("entity").alias("kind"), F.col("title").alias("label"), "page_id", "url", "aliases")
    extra = lambda df, kind: df.select("id", F.lit(kind).alias("kind"), "label", F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.array().cast("array<string>").alias("aliases")).dropDuplicates(["id"])
    cat_nodes = extra(inst.select("o").union(sub.select("o")).union(sub.select("s")).select(F.col("o").alias("id"), F.substring("o", 5, 1000).alias("label")), "class")
    date_nodes = extra(dated.select(F.col("o").alias("id"), dates.label_of(F.col("v")).alias("label")), "date")
    unmapped = linked.where("p is null and o is not null").groupBy("template", "field_name").agg(F.count_distinct("node").alias("pages"), F.count("*").alias("links")).orderBy(F.col("links").desc(), "template", "field_name")
    tables = {"nodes": entity.unionByName(cat_nodes).unionByName(date_nodes), "edges": edges, "links": links, "classes": classes.select("node", "class"), "unmapped": unmapped, "predicates": preds.select("p", "label", "inverse", "priority")}
    return tables | ({"override_report": report} if report is not None else {})


def write_graph(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines; the ontology's snapshot is the predicates table."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}.jsonl")
