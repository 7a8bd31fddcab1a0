"""Reports, evaluation and pages for looking at the graph."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators import graph
from lorekeep.operators.curate import first_seen, numbered
from lorekeep.sources.tables import kept

PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title>
<body><h1>{title}</h1><input id="find" placeholder="find"><table id="rows"></table>
<script>const DATA = {data};
const table = document.getElementById("rows"), find = document.getElementById("find");
function show() {{
  const q = find.value.toLowerCase();
  table.innerHTML = "";
  for (const r of DATA.rows.filter(r => r.join(" ").toLowerCase().includes(q)).slice(0, 500)) {{
    const tr = table.insertRow();
    for (const c of r) tr.insertCell().textContent = c;
  }}
}}
find.oninput = show; show();</script></body>"""


def html_page(title: str, payload: dict) -> str:
    """A page that stands alone; no text in the data can end its script."""
    safe = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    return PAGE.format(title=safe(title), data=json.dumps(payload, ensure_ascii=False).replace("</", "<\\/"))


def node_classes(nodes: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(id, c): each node's first class by name, `Date` for dates, `(unclassed)` without any."""
    own = classes.groupBy(F.col("node").alias("id")).agg(F.min("class").alias("class")) if classes is not None else nodes.select("id", "class")
    both = nodes.select("id", "kind").join(own, "id", "left")
    return both.select("id", F.when(F.col("kind") == "date", "Date").otherwise(F.coalesce("class", F.lit("(unclassed)"))).alias("c"))


def schema_triples(cls: DataFrame, edges: DataFrame) -> DataFrame:
    """(sc, p, oc, n): typed edges counted by the classes of their ends."""
    t = edges.where(~F.col("p").isin(graph.TAXONOMY)).join(cls.withColumnsRenamed({"id": "s", "c": "sc"}), "s").join(cls.withColumnsRenamed({"id": "o", "c": "oc"}), "o")
    return t.groupBy("sc", "p", "oc").agg(F.count("*").alias("n"))


def unused_predicates(predicates: DataFrame, edges: DataFrame) -> DataFrame:
    return predicates.join(edges.select("p").distinct(), "p", "left_anti")


def schema_figures(cls: DataFrame, triples: DataFrame) -> DataFrame:
    """(name, value): what the schema page says in its margin: nodes, share without a class, triples, those of two edges or fewer."""
    sizes = cls.agg(F.count("*").cast("double").alias("nodes"), F.round(F.avg((F.col("c") == "(unclassed)").cast("double")), 6).alias("unclassed share"))
    tail = triples.agg(F.count("*").cast("double").alias("triples"), F.coalesce(F.sum((F.col("n") <= 2).cast("double")), F.lit(0.0)).alias("triples of two edges or fewer"))
    row = sizes.crossJoin(tail)  # one row each
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("value")) for c in row.columns])).alias("x")).select("x.name", "x.value")


def seats(cls: DataFrame) -> DataFrame:
    """(c, n, seat): the classes' places around the page, by size."""
    return cls.groupBy("c").agg(F.count("*").alias("n")).withColumn("seat", F.row_number().over(Window.orderBy(F.col("n").desc(), "c")))


def schema_payload(nodes: DataFrame, edges: DataFrame, predicates: DataFrame, top: int = 500, classes: DataFrame | None = None) -> dict:
    """Class-level triples by count, class sizes and unused predicates; a report of bounded length."""
    cls = node_classes(nodes, classes)
    triples = schema_triples(cls, edges)
    rows = triples.orderBy(F.col("n").desc(), "sc", "p", "oc").limit(top).collect()
    sizes = seats(cls).where(F.col("seat") <= top).orderBy("seat").collect()
    unused = unused_predicates(predicates, edges).select("p").collect()
    return {"rows": [[r.sc, r.p, r.oc, r.n] for r in rows], "classes": {r.c: r.n for r in sizes}, "unused": sorted(r.p for r in unused), "figures": {r["name"]: r["value"] for r in schema_figures(cls, triples).collect()}}


def explorer_tables(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with their number n by id, typed edges as numbers sn, on_, pn): predicates are numbered by first appearance."""
    n = numbered(nodes, "id")
    e = edges.where(~F.col("p").isin(graph.TAXONOMY))
    p = F.broadcast(kept(first_seen(e, "p", "eid").withColumnRenamed("n", "pn")))  # a row a predicate
    ends = lambda c, to: n.select(F.col("id").alias(c), F.col("n").alias(to))
    return n, e.join(p, "p").drop("p").join(ends("s", "sn"), "s").join(ends("o", "on_"), "o").join(p, "pn")


def explorer_payload(nodes: DataFrame, edges: DataFrame, top: int | None = None) -> dict:
    """All nodes and typed edges as numbers, or the best-connected nodes and the edges among them: a page must fit a browser."""
    if top is not None:
        best = graph.degrees(nodes, edges).orderBy(F.col("degree").desc(), "id").limit(top).select("id")
        nodes = nodes.join(best, "id", "left_semi")
        edges = edges.join(best.withColumnRenamed("id", "s"), "s", "left_semi").join(best.withColumnRenamed("id", "o"), "o", "left_semi")
    if "eid" not in edges.columns:
        edges = edges.withColumn("eid", F.xxhash64("s", "p", "o"))
    n, e = explorer_tables(nodes.select("id", "label"), edges)
    ids = [[r.id, r.label] for r in n.orderBy("n").collect()]
    among = e.orderBy("pn", "sn", "on_").collect()
    preds = {r.pn: r.p for r in among}
    linked = {x for r in among for x in (r.sn, r.on_)}
    return {"nodes": [i for i, _ in ids], "labels": [x for _, x in ids], "predicates": [preds[k] for k in sorted(preds)], "edges": [[r.sn, r.pn, r.on_] for r in among], "rows": [[ids[r.sn][1], r.p, ids[r.on_][1]] for r in among], "stats": {"nodes": len(ids), "edges": len(among), "connected": len(linked)}}


def write_pages(folder: str, kinds: list[str], nodes: DataFrame, edges: DataFrame, predicates: DataFrame, classes: DataFrame | None = None, top: int = 2_000) -> list[str]:
    """The pages as files in a folder of the driver; one line for each."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    out = []
    for kind in kinds:
        made = explorer_payload(nodes, edges, top) if kind == "explorer" else schema_payload(nodes, edges, predicates, top, classes)
        path = Path(folder) / f"{kind}.html"
        path.write_text(html_page(f"Graph {kind}", made), encoding="utf-8")
        out.append(f"{path} ({path.stat().st_size // 1024} KB)")
    return out


def cases(text: str) -> list[dict]:
    """Evaluation cases of a list in a small subset of YAML: q, expect (a bracketed list), answer."""
    out: list[dict] = []
    for line in text.splitlines():
        m = re.match(r"\s*(-\s*)?(\w+):\s*(.*?)\s*$", line)
        if not m or line.lstrip().startswith("#"):
            continue
        if m[1]:
            out.append({})
        value = m[3].strip("\"'")
        out[-1][m[2]] = [v.strip().strip("\"'") for v in value[1:-1].split(",") if v.strip()] if value.startswith("[") else value
    return [{"q": c["q"], "expect": c.get("expect", []), "answer": c.get("answer")} for c in out if c.get("q")]


def excerpts(context: str) -> str:
    """A context without its blocks of recorded facts."""
    return "\n".join(line for line in context.splitlines() if not line.startswith(("[KG]", "[KG-PATH]")))


def scores(hits: DataFrame, contexts: DataFrame, truth: DataFrame, k: int = 6) -> DataFrame:
    """One row: recall at k, mean reciprocal rank, answers in contexts, median tokens. truth (qid, expect, answer), hits with title."""
    first = hits.where(F.col("position") <= k).join(truth, "qid").where(F.expr("exists(expect, e -> lower(e) = lower(title))")).groupBy("qid").agg(F.min("position").alias("first"))
    rows = truth.join(first, "qid", "left").join(contexts, "qid", "left")
    has = F.when(F.col("answer").isNotNull(), F.coalesce(F.lower("context").contains(F.lower("answer")), F.lit(False)).cast("double"))
    return rows.agg(F.avg(F.col("first").isNotNull().cast("double")).alias("recall"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(has).alias("answer_in_context"), F.median("context_tokens").alias("median_tokens"))


def compared(settings: DataFrame, found: DataFrame, truth: DataFrame, k: int = 6) -> DataFrame:
    """(setting, found, mrr) of rankings (setting, qid, id, position) against truth (qid, id): graph off or on, one step or two, side by side.

    Every setting (setting) has a row, also one that finds nothing; questions without truth do not count.
    """
    asked = truth.select("qid").distinct()
    first = found.join(truth, ["qid", "id"]).groupBy("setting", "qid").agg(F.min("position").alias("first"))
    rows = settings.crossJoin(F.broadcast(asked)).join(first, ["setting", "qid"], "left")  # settings: a few rows
    return rows.groupBy("setting").agg(F.sum((F.coalesce(F.col("first"), F.lit(k + 1)) <= k).cast("int")).alias("found"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
