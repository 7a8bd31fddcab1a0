"""The property graph: look-ups, adjacency, degrees, neighbours, facts, walks, comparisons, and pages of paths.

nodes (id, kind, label, page_id, classes), edges (eid, s, p, o); predicates (p, label, inverse,
priority) is the small ontology table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.keys import Keys, among
from lorekeep.sources.tables import kept

TAXONOMY = ["instance_of", "subclass_of"]
HOP_DECAY = 0.45
TIER_WEIGHTS = [1.0, 0.75, 0.5, 0.3]
DEFAULT_PRIORITY = 3
HUB_DEGREE = 40


#: A table, or what gives its rows for some keys: walks over large graphs then never make the whole of it.
Table = DataFrame | Callable[[DataFrame], DataFrame]


def rows_for(table: Table, keys: DataFrame) -> DataFrame:
    return table if isinstance(table, DataFrame) else table(keys)


def adjacency(nodes: DataFrame, edges: DataFrame, predicates: DataFrame, taxonomy: bool = False, anchors: DataFrame | None = None, eid: Column | None = None, repeated: DataFrame | None = None) -> DataFrame:
    """(anchor, dir, p, other, other_label, other_kind, other_page, prio, eid): both directions of every edge.

    With anchors (anchor) of edges at these only: the others, and nodes that none of these leads to,
    are left where they lie. `eid` numbers edges that have no number, after that. `repeated` holds
    further edges, each of which counts once however often it is stated: of those at the anchors
    that is found out, not of all.
    """
    typed = lambda df: df if taxonomy else df.where(~F.col("p").isin(TAXONOMY))
    keys = None if anchors is None else Keys(anchors.select("anchor"))
    met = lambda df, end: typed(df) if keys is None else among(typed(df), end, keys)
    at = lambda end: met(edges, end) if repeated is None else met(edges, end).unionByName(met(repeated, end).distinct())
    numbered = lambda df: df if eid is None else df.withColumn("eid", eid)
    both = numbered(at("s")).select(F.col("s").alias("anchor"), F.lit("out").alias("dir"), "p", F.col("o").alias("other"), "eid").unionByName(numbered(at("o")).select(F.col("o").alias("anchor"), F.lit("in").alias("dir"), "p", F.col("s").alias("other"), "eid"))
    n = nodes.select(F.col("id").alias("other"), F.col("label").alias("other_label"), F.col("kind").alias("other_kind"), F.col("page_id").alias("other_page"))
    if keys is not None:
        both = kept(both)
        n = among(n, "other", Keys(both.select("other")))
    prio = F.coalesce("priority", F.lit(DEFAULT_PRIORITY))
    return both.join(n, "other", "left").join(predicates.select("p", "priority"), "p", "left").withColumn("prio", prio).drop("priority")


def edge_order() -> list[Column]:
    """By priority, out before in, predicate, then edge number."""
    return [F.col("prio"), F.when(F.col("dir") == "out", 0).otherwise(1), F.col("p"), F.col("eid")]


def nodes_of(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of ids (id); unknown ids give no row."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def nodes_for_pages(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """pages (page_id, ...) with the entity `node` that stands for the page; pages without one are left out."""
    own = nodes.where((F.col("kind") == "entity") & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.min("id").alias("node"))
    return pages.join(own, "page_id")


def classes_of(classes: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, classes) for every one of ids (id), from rows (node, class); an empty list without any.

    Without ids for every node of the rows; a node without a class then has a row without one, and
    rows move once.
    """
    if ids is None:
        return classes.select(F.col("node").alias("id"), "class").repartition("id").groupBy("id").agg(F.array_sort(F.collect_set("class")).alias("classes"))
    of = classes.join(ids.select(F.col("id").alias("node")).distinct(), "node", "left_semi").groupBy("node").agg(F.array_sort(F.collect_set("class")).alias("classes"))
    return ids.select("id").distinct().join(of.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("classes", F.array().cast("array<string>")).alias("classes"))


def person_flags(paths: DataFrame, classes: DataFrame, person_classes: list[str]) -> DataFrame:
    """paths with `persons`: of each node that a step leaves from whether it is a person, from rows (node, class)."""
    persons = classes.where(F.col("class").isin(person_classes)).select(F.col("node").alias("_node")).distinct().withColumn("_is", F.lit(True))
    keyed = paths.withColumn("_path", F.xxhash64("qid", "seed", F.to_json("nodes"), F.to_json("preds"), F.to_json("dirs")))
    each = keyed.select("_path", F.posexplode(F.slice("nodes", F.lit(1), F.size("preds"))).alias("i", "_node")).distinct().join(persons, "_node", "left")
    flags = each.groupBy("_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("_is", F.lit(False)).alias("is")))), lambda x: x["is"]).alias("persons"))
    return keyed.join(flags, "_path").drop("_path")


def edges_from(adj: DataFrame, anchors: DataFrame) -> DataFrame:
    """The edges of each anchor (anchor) in their order, numbered from 1."""
    near = adj.join(anchors, "anchor", "left_semi")
    return near.withColumn("nth", F.row_number().over(Window.partitionBy("anchor").orderBy(*edge_order())))


def degrees(nodes: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, degree): typed edges in and out, 0 for isolated nodes; a loop counts twice. With ids (id) of these nodes only."""
    e = edges.where(~F.col("p").isin(TAXONOMY))
    keys = None if ids is None else Keys(ids.select("id"))
    at = lambda end: among(e.select(F.col(end).alias("id")), "id", keys)
    met = e.select(F.explode(F.array("s", "o")).alias("id")) if keys is None else at("s").unionAll(at("o"))
    ends = met.groupBy("id").agg(F.count("*").alias("degree"))
    own = nodes.select("id") if keys is None else among(nodes.select("id"), "id", keys)
    return own.join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def prominence(nodes: DataFrame, edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, prominence): degree plus aliases (id, n_aliases)."""
    return degrees(nodes, edges).join(aliases, "id", "left").select("id", (F.col("degree") + F.coalesce("n_aliases", F.lit(0))).alias("prominence"))


def neighbour_pages(adj: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """(qid, page_id, position): pages one step from the seeds (qid, anchor, seed_rank), dealt round robin.

    Entities with a page only, no seed, each once a seed; a page met again under another seed has
    used up that seed's turn.
    """
    near = adj.join(seeds, "anchor").where((F.col("other_kind") == "entity") & F.col("other_page").isNotNull())
    near = near.join(seeds.select("qid", F.col("anchor").alias("other")).distinct(), ["qid", "other"], "left_anti")
    one = Window.partitionBy("qid", "anchor", "other").orderBy(*edge_order())
    near = near.withColumn("again", F.row_number().over(one)).where("again = 1")
    slot = F.row_number().over(Window.partitionBy("qid", "anchor").orderBy(*edge_order()))
    first = near.withColumn("slot", slot).groupBy("qid", F.col("other_page").alias("page_id")).agg(F.min(F.struct("slot", "seed_rank")).alias("at"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("at"))).where(F.col("position") <= limit).select("qid", "page_id", "position")


def sentences(adj: DataFrame, nodes: DataFrame, predicates: DataFrame) -> DataFrame:
    """adj with `sentence`: read from the anchor if the predicate (or its inverse) can be, else from the far end."""
    me = nodes.select(F.col("id").alias("anchor"), F.col("label").alias("anchor_label"))
    p = predicates.select("p", F.col("label").alias("verb"), F.col("inverse").alias("inv"))
    q = predicates.select(F.col("p").alias("inv"), F.col("label").alias("inv_verb"))
    rows = adj.join(me, "anchor", "left").join(F.broadcast(p), "p", "left").join(F.broadcast(q), "inv", "left")  # the ontology: tens of rows
    ahead = F.when(F.col("dir") == "out", F.col("verb")).otherwise(F.col("inv_verb"))
    said = F.when(F.col("other_label").isNull() | F.col("verb").isNull(), None).when(ahead.isNotNull(), F.concat_ws(" ", "anchor_label", ahead, "other_label")).otherwise(F.concat_ws(" ", "other_label", "verb", "anchor_label"))
    return rows.withColumn("sentence", F.concat(said, F.lit("."))).drop("inv")


def facts(adj: DataFrame, nodes: DataFrame, predicates: DataFrame, anchors: DataFrame, limit: int) -> DataFrame:
    """(anchor, sentence, position): distinct sentences of each anchor in edge order."""
    rows = sentences(edges_from(adj, anchors), nodes, predicates).where("sentence is not null")
    first = rows.groupBy("anchor", "sentence").agg(F.min("nth").alias("nth"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy("anchor").orderBy("nth"))).where(F.col("position") <= limit).drop("nth")


def canonical(predicates: DataFrame, edges: DataFrame, symmetric: list[str]) -> DataFrame:
    """edges with cs, cp, co: one form for a fact that is stored from both ends."""
    e = edges.join(F.broadcast(predicates.select("p", "inverse")), "p", "left")
    sym = F.col("p").isin(symmetric) | F.coalesce(F.col("inverse") == F.col("p"), F.lit(False))
    flip = ~sym & F.coalesce(F.col("inverse") < F.col("p"), F.lit(False))
    return e.withColumns({"cs": F.when(sym, F.least("s", "o")).when(flip, F.col("o")).otherwise(F.col("s")), "cp": F.when(flip, F.col("inverse")).otherwise(F.col("p")), "co": F.when(sym, F.greatest("s", "o")).when(flip, F.col("s")).otherwise(F.col("o"))}).drop("inverse")


def tier_weight(prio: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in TIER_WEIGHTS]), F.least(prio, F.lit(len(TIER_WEIGHTS) - 1)).cast("int") + 1)


def walk(adj: Table, seeds: DataFrame, degree: Table, predicates: DataFrame, no_transit: list[str], symmetric: list[str], hops: int = 2, beam: int = 24, hub: int = HUB_DEGREE, stop_at: DataFrame | None = None) -> DataFrame:
    """Paths of 1 to `hops` steps from the seeds (qid, anchor), as rows (qid, seed, depth, node, score, preds, nodes, labels, dirs, pages, trail).

    A path never meets a seed or a node of its own, and no fact twice. Of paths with equal facts the
    first counts. It goes on from entities only, not over a predicate in no_transit, not from a node
    with more than `hub` edges, and only the `beam` best of a question by (score, node) go on. The
    hops are unrolled; each is a join with the adjacency, or with what `adj` gives for the nodes
    (anchor) that a hop leaves from, and `degree` for those (id) that may be gone on from. Every
    hop but the last is written once.
    """
    pred = predicates.select("p", "inverse")
    sym = F.col("p").isin(symmetric) | F.coalesce(F.col("inverse") == F.col("p"), F.lit(False))
    flip = ~sym & F.coalesce(F.col("inverse") < F.col("p"), F.lit(False))
    s, o = F.when(F.col("dir") == "out", F.col("anchor")).otherwise(F.col("other")), F.when(F.col("dir") == "out", F.col("other")).otherwise(F.col("anchor"))
    sig = F.concat_ws("|", F.when(sym, F.least(s, o)).when(flip, o).otherwise(s), F.when(flip, F.col("inverse")).otherwise(F.col("p")), F.when(sym, F.greatest(s, o)).when(flip, s).otherwise(o))
    taken = seeds.select("qid", F.collect_set("anchor").over(Window.partitionBy("qid")).alias("all_seeds")).distinct()
    none = F.array().cast("array<string>")
    front = seeds.select("qid", F.col("anchor").alias("seed"), F.col("anchor").alias("node"), F.lit(1.0).alias("score"), none.alias("preds"), F.array("anchor").alias("nodes"), none.alias("labels"), none.alias("dirs"), F.array().cast("array<bigint>").alias("pages"), none.alias("sigs"), F.array().cast("array<struct<prio:int,d:int,p:string,eid:bigint>>").alias("trail"))
    out = None
    for depth in range(1, hops + 1):
        near = rows_for(adj, front.select(F.col("node").alias("anchor")).distinct())
        steps = near.join(F.broadcast(pred), "p", "left").withColumn("sig", sig).drop("inverse")
        nxt = front.join(steps, front["node"] == steps["anchor"]).join(taken, "qid")
        free = ~F.array_contains("nodes", F.col("other")) & ~F.array_contains("sigs", F.col("sig"))
        free &= ~F.array_contains("all_seeds", F.col("other"))
        decay = 1.0 if depth == 1 else HOP_DECAY
        rank = F.concat("trail", F.array(F.struct(F.col("prio").cast("int").alias("prio"), F.when(F.col("dir") == "out", 0).otherwise(1).alias("d"), "p", F.col("eid").cast("long").alias("eid"))))
        nxt = nxt.where(free).select(
            "qid", "seed", F.lit(depth).alias("depth"), F.col("other").alias("node"), "other_kind", "other_page", F.round(F.col("score") * decay * tier_weight(F.col("prio")), 9).alias("score"),
            F.concat("preds", F.array("p")).alias("preds"), F.concat("nodes", F.array("other")).alias("nodes"), F.concat("labels", F.array("other_label")).alias("labels"),
            F.concat("dirs", F.array("dir")).alias("dirs"), F.concat("pages", F.array(F.col("other_page").cast("long"))).alias("pages"), F.array_sort(F.concat("sigs", F.array("sig"))).alias("sigs"), rank.alias("trail"), F.col("p").alias("last_p"),
        )
        nxt = nxt.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "seed", "sigs").orderBy("trail"))).where("_n = 1").drop("_n")
        nxt = kept(nxt) if depth < hops else nxt
        rows = nxt.select("qid", "seed", "depth", "node", "other_page", "score", "preds", "nodes", "labels", "dirs", "pages", "trail")
        out = rows if out is None else out.unionByName(rows)
        if depth < hops:
            on = nxt.where((F.col("other_kind") == "entity") & ~F.col("last_p").isin(no_transit))
            if stop_at is not None:
                on = on.join(stop_at.select("qid", F.col("anchor").alias("node")), ["qid", "node"], "left_anti")
            found = rows_for(degree, on.select(F.col("node").alias("id")).distinct())
            on = on.join(found.select(F.col("id").alias("node"), "degree"), "node").where(F.col("degree") <= hub)
            on = on.withColumn("_b", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "node", "trail"))).where(F.col("_b") <= beam)
            front = kept(on.select("qid", "seed", "node", "score", "preds", "nodes", "labels", "dirs", "pages", "sigs", "trail"))
    return out


def path_order(prominence: Table | None, paths: DataFrame) -> tuple[DataFrame, list[Column]]:
    """(paths with what they are ordered by, the order): score, then shortness, prominence of the end, its label, its id, the way there."""
    if prominence is not None:
        if not isinstance(prominence, DataFrame):
            paths = kept(paths)
        found = rows_for(prominence, paths.select(F.col("node").alias("id")).distinct())
        paths = paths.join(found.select(F.col("id").alias("node"), F.col("prominence").alias("_prom")), "node", "left")
    else:
        paths = paths.withColumn("_prom", F.lit(0))
    return paths, [F.col("score").desc(), F.col("depth"), F.coalesce("_prom", F.lit(0)).desc(), F.coalesce(F.element_at("labels", -1), F.lit("")), F.col("node"), F.col("trail")]


def expand(paths: DataFrame, limit: int, prominence: Table | None = None, shown: bool = False) -> DataFrame:
    """The best paths of a question: by seed and depth in path_order, dealt depth-major round robin; `position` from 1.

    If shown, each with the `prominence` of its end, so that who needs it later need not count edges again.
    """
    rows, order = path_order(prominence, paths)
    rows = rows.withColumn("slot", F.row_number().over(Window.partitionBy("qid", "seed", "depth").orderBy(*order)))
    position = F.row_number().over(Window.partitionBy("qid").orderBy("slot", "depth", "seed"))
    best = rows.withColumn("position", position).where(F.col("position") <= limit)
    return best.withColumnRenamed("_prom", "prominence") if shown else best.drop("_prom")


def connect(paths: DataFrame, ends: DataFrame, limit: int = 3) -> DataFrame:
    """Of paths that end in ends (qid, anchor), the shortest only, best first by score, predicates and the way there."""
    met = paths.join(ends.select("qid", F.col("anchor").alias("node")), ["qid", "node"], "left_semi")
    short = met.withColumn("least", F.min("depth").over(Window.partitionBy("qid"))).where("depth = least").drop("least")
    position = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), F.array_join("preds", ","), "trail"))
    return short.withColumn("position", position).where(F.col("position") <= limit)


def compare(adj: DataFrame, pairs: DataFrame, predicates: DataFrame, limit: int = 6) -> DataFrame:
    """(qid, verb, a_objects, b_objects, shared): what both ends of (qid, a, b) have of one kind."""
    verbs = predicates.select("p", F.col("label").alias("verb"), F.col("inverse").alias("inv")).join(predicates.select(F.col("p").alias("inv"), F.col("label").alias("inv_verb")), "inv", "left")
    told = adj.join(F.broadcast(verbs), "p").withColumn("said", F.when(F.col("dir") == "out", F.col("verb")).otherwise(F.col("inv_verb"))).where("said is not null and other_label is not null")

    ends = pairs.select("qid", F.explode(F.array(F.struct(F.lit("a").alias("end"), F.col("a").alias("anchor")), F.struct(F.lit("b").alias("end"), F.col("b").alias("anchor")))).alias("x")).select("qid", "x.end", "x.anchor")
    each = told.join(ends, "anchor").groupBy("qid", "prio", "said", "end", "other_label").agg(F.min(F.struct(*edge_order())).alias("at"))
    objects = lambda end: F.transform(F.array_sort(F.collect_list(F.when(F.col("end") == end, F.struct("at", "other_label")))), lambda x: x["other_label"]).alias(f"{end}_objects")
    both = each.groupBy("qid", "prio", "said").agg(objects("a"), objects("b")).where((F.size("a_objects") > 0) & (F.size("b_objects") > 0))
    both = both.withColumn("shared", F.array_intersect("a_objects", "b_objects"))
    position = F.row_number().over(Window.partitionBy("qid").orderBy("prio", "said"))
    return both.withColumn("position", position).where(F.col("position") <= limit).select("qid", "position", F.col("said").alias("verb"), "a_objects", "b_objects", "shared")


def path_pages(paths: DataFrame) -> DataFrame:
    """(qid, page_id, hop, score, connects, position, step): the pages that paths (with `connects`) make worth reading.

    Of a chain its end, of a route between two seeds the nodes between them.
    """
    steps = F.transform(F.sequence(F.lit(1), F.size("pages")), lambda i: F.struct(i.alias("hop"), F.element_at(F.col("pages"), i).alias("page_id")))
    wanted = F.filter(steps, lambda x: x["page_id"].isNotNull() & F.when(F.col("connects"), x["hop"] < F.size("pages")).otherwise(x["hop"] == F.size("pages")))
    return paths.select("qid", "score", "connects", "position", F.explode(wanted).alias("x")).select("qid", "x.page_id", "x.hop", "score", "connects", "position")


def shown_inbound(edges: DataFrame, predicates: DataFrame) -> DataFrame:
    """(node, p, other): inbound edges as a reader of `node` sees them, without those whose inverse is stated outbound as well."""
    inv = predicates.where("inverse is not null").select("p", F.col("inverse").alias("ip"))
    # only where both a predicate and its inverse are used can an edge be stated twice: the others stay where they lie
    used = edges.select("p").distinct()
    both = kept(inv.join(used, "p", "left_semi").join(used.select(F.col("p").alias("ip")), "ip", "left_semi").select("p", "ip"))
    into = edges.select(F.col("o").alias("node"), "p", F.col("s").alias("other")).join(F.broadcast(both), "p", "left")  # the ontology: tens of rows
    stated = edges.select(F.col("s").alias("node"), F.col("p").alias("ip"), F.col("o").alias("other")).join(F.broadcast(both.select("ip")), "ip", "left_semi")
    alone = into.where("ip is null").unionByName(into.where("ip is not null").join(stated, ["node", "ip", "other"], "left_anti"))
    return alone.select("node", "p", "other")


def round_robin_pages(paths: DataFrame, limit: int, seeds: DataFrame | None = None) -> DataFrame:
    """(qid, page_id, position): the pages of paths in order of score, no seed's page (qid, page_id), dealt round robin over their depths."""
    paths = paths if "connects" in paths.columns else paths.withColumn("connects", F.lit(False))
    rows = path_pages(paths)
    if seeds is not None:
        rows = rows.join(seeds.select("qid", "page_id").distinct(), ["qid", "page_id"], "left_anti")
    pages = rows.groupBy("qid", "page_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "connects", "position", "hop")).alias("at"))
    slot = F.row_number().over(Window.partitionBy("qid", "at.hop").orderBy("at"))
    rows = pages.withColumn("slot", slot).withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("slot", "at.hop")))
    return rows.where(F.col("position") <= limit).select("qid", "page_id", "position")
