"""What the command line does, as methods that give lines of text."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.config import Settings
from lorekeep.functions import ontology
from lorekeep.functions.narrate import narrated
from lorekeep.functions.text import label_search
from lorekeep.operators import graph, index
from lorekeep.plans import answer, build, clients, report, retrieve, service
from lorekeep.sources import store, tables, wiki


class Nothing(Exception):
    """There is nothing to show; the command ends with status 1."""


class Desk:
    """The index and the graph of a data folder. chat and embed are injected; without them there are no answers and no vectors."""

    def __init__(self, spark: SparkSession, s: Settings, chat=None, embed=None, embed_health=None):
        self.spark, self.s, self.chat, self.embed, self.embed_health = spark, s, chat, embed, embed_health
        self.index_store = store.TableStore(spark, s.index_dir, store.INDEX_TABLES)
        self.graph_store = store.GraphStore(spark, s.graph_dir)

    # -- the corpus and its index --------------------------------------------------------------
    def fetch(self, get, base_url: str, namespaces: list[int] | None = None, force: bool = False) -> Iterator[str]:
        client = wiki.WikiClient(get, base_url, self.s)
        for ns, n in store.fetch_all(client, self.spark, self.s.raw_dir, namespaces or tables.NAMESPACES, force).items():
            yield f"name space {ns}: {n} pages"

    def index(self, given) -> Iterator[str]:
        if not given.embed_only:
            raw = tables.read_raw(self.spark, self.s.raw_dir, [0, 3000])
            made = build.build_index(raw, tables.aliases(store.read_redirects(self.spark, self.s.raw_dir)), noise=list(ontology.default().noise))
            self.index_store.reset()
            for n in ("pages", "chunks"):
                self.index_store.write(n, made[n])
            for n, t in index.counted(self.index_store.read("chunks"), retrieve.COLUMNS).items():
                self.index_store.write(n, t)
            c = self.index_store.counts()
            yield f"text index: {c['pages']} pages, {c['chunks']} chunks"
        if not given.text_only:
            if self.embed is None:
                raise Nothing("no embedding client is set up")
            yield f"embedded {self.embed_missing(given.limit)} chunks"

    def embed_missing(self, limit: int | None = None) -> int:
        from lorekeep.operators import vectors
        from lorekeep.operators.chunking import embed_text

        chunks, held = self.index_store.read("chunks"), self.index_store.read("vectors")
        todo = chunks.select("chunk_id", embed_text(F.col("title"), F.col("section"), F.col("text")).alias("embed_text"))
        todo = index.missing_vectors(todo, held) if held is not None else todo
        todo = todo.orderBy("chunk_id").limit(limit) if limit else todo
        before = held.count() if held is not None else 0
        vectors.embedded(todo, self.embed).write.mode("append").parquet(f"{self.s.index_dir}/vectors")
        return self.index_store.read("vectors").count() - before

    def prune(self, _given=None) -> Iterator[str]:
        held = {n: tables.kept(t) for n in ("pages", "chunks", "vectors") if (t := self.index_store.read(n)) is not None}
        if "pages" not in held:
            raise Nothing("no index yet")
        before = {n: t.count() for n, t in held.items()}
        for n, t in index.prune(held).items():
            self.index_store.write(n, t)
        for n, t in index.counted(self.index_store.read("chunks"), retrieve.COLUMNS).items():
            self.index_store.write(n, t)
        yield ", ".join(f"{n}: {before[n] - self.index_store.read(n).count()} removed" for n in held)

    def status(self, _given=None) -> Iterator[str]:
        for ns in tables.NAMESPACES:
            yield f"raw pages of name space {ns}: {tables.read_raw(self.spark, self.s.raw_dir, [ns]).count()}"
        c = self.index_store.counts()
        yield f"pages: {c['pages']}, chunks: {c['chunks']}, vectors: {c['vectors']} ({100 * c['vectors'] / max(c['chunks'], 1):.1f} %)"
        g = self.graph_store.counts()
        built, raw = self.graph_store.get_meta("built_at"), self._newest_raw()
        stale = bool(built and raw and built < raw)
        yield f"graph: {g['nodes']} nodes, {g['edges']} edges ({g['typed_edges']} typed), {g['links']} links, built {built or 'never'}{', older than the raw pages' if stale else ''}"
        yield f"graph in retrieval: weight {self.s.weight_graph}, {self.s.kg_max_hops} hops, chains {self.s.kg_chains}, facts {self.s.kg_facts}"

    def _newest_raw(self) -> str | None:
        times = [f.stat().st_mtime for f in Path(self.s.raw_dir).glob("*.jsonl/_SUCCESS")]
        return __import__("datetime").datetime.fromtimestamp(max(times), __import__("datetime").UTC).isoformat(timespec="seconds") if times else None

    # -- questions -----------------------------------------------------------------------------
    def opened(self) -> retrieve.Index:
        chunks, pages = self.index_store.read("chunks"), self.index_store.read("pages")
        if chunks is None or pages is None:
            raise Nothing("no index yet; run index")
        words = {n: self.index_store.read(n) for n in ("postings", "stats")}
        ix = retrieve.Index(chunks, pages, self.index_store.read("vectors"), words=words)
        if self.s.kg_enabled and self.graph_store.is_populated:
            self.graph_into(ix)
        return ix

    def graph_into(self, ix: retrieve.Index) -> None:
        g = self.graph_store
        ix.nodes, ix.edges, ix.classes = g.read("nodes"), g.read("edges"), g.read("node_classes")
        ix.predicates = g.read("predicates")

    def found(self, question: str, top_k: int | None = None, parts: list[str] | None = None) -> answer.Retrieval:
        ix = self.opened()
        if parts:
            rows = self.spark.createDataFrame([(1, i, p) for i, p in enumerate(parts)], "qid long, part int, question string")
            hits = tables.kept(retrieve.merged_parts(rows, ix, self.s, self.embed))
            contexts = retrieve.contexts(hits, self.s)
        else:
            hits, contexts = retrieve.retrieved(self.spark.createDataFrame([(1, question)], "qid long, question string"), ix, self.s, self.embed, top_k)
            hits = tables.kept(hits)
        packed = contexts.first()
        used = {u.position for u in packed.used} if packed else set()
        rows = [r.asDict() for r in hits.orderBy("position").collect() if r.position in used]
        return answer.Retrieval(packed.context if packed else "", rows, packed.context_tokens if packed else 0)

    def search(self, given) -> Iterator[str]:
        got = self.found(given.question, given.top_k)
        if not got.hits:
            raise Nothing("no matches")
        yield from (line for line in got.context.split("\n\n") if line.startswith("[KG"))
        for h in got.hits:
            yield f"[{h['position']}] {h['label']}  (score {h['score']:.4f})\n    {h['url']}\n    {h['text'] if given.full else h['text'][:220]}"
        yield f"context tokens: {got.context_tokens}"

    def engine(self) -> answer.Engine:
        if self.chat is None:
            raise Nothing("no chat client is set up")
        return answer.Engine(self.found, self.chat, self.s)

    def ask(self, given) -> Iterator[str]:
        import json

        options = {"profile": given.profile, "top_k": given.top_k, "decompose": given.decompose}
        if given.json:
            yield json.dumps(self.engine().answer(given.question, **options), ensure_ascii=False)
            return
        for e in self.engine().stream(given.question, **options):
            if e["event"] == "sources":
                yield from [f"- {q}" for q in e["sub_questions"]] + [f"[{x['position']}] {x['url']}" for x in e["sources"]]
            elif e["event"] == "done":
                yield e["answer"]["text"]

    def serve(self, given) -> Iterator[str]:
        chunks = lambda: self.index_store.counts()
        ok = self.embed_health or (lambda: (self.embed is not None, ""))
        api = answer.Api(self.engine(), lambda: {"embedder": ok()[0], "chunks": chunks()["chunks"], "vectors": chunks()["vectors"]})
        with service.server(api, given.host, given.port) as s:
            yield f"serving on {s.server_address}"
            s.serve_forever()

    # -- the graph -----------------------------------------------------------------------------
    def kg_build(self, given) -> Iterator[str]:
        raw = tables.read_raw(self.spark, self.s.raw_dir)
        made = store.build_graph(raw, store.read_redirects(self.spark, self.s.raw_dir), ontology.default(), f"{self.s.graph_dir}/jsonl", None if given.jsonl_only else self.graph_store)
        yield from (f"{n}: {k}" for n, k in made.items())

    def _graph(self) -> SimpleNamespace:
        g = self.graph_store
        if not g.has("edges"):
            raise Nothing("no graph yet; run kg build")
        nodes, edges, preds = g.read("nodes"), g.read("edges"), g.read("predicates")
        return SimpleNamespace(nodes=nodes, edges=edges, preds=preds, classes=g.read("node_classes"), adj=graph.adjacency(nodes, edges, preds), degree=graph.degrees(nodes, edges))

    def _resolve(self, k: SimpleNamespace, title: str):
        rows = label_search(k.nodes.where("kind = 'entity'"), "label", title, 5, "id").collect()
        if not rows:
            raise Nothing(f"nothing in the graph matches {title!r}")
        return rows[0]

    def kg_stats(self, given) -> Iterator[str]:
        k = self._graph()
        yield str(self.graph_store.counts())
        for name, df, key in (("class", k.classes, "class"), ("predicate", k.edges.where(~F.col("p").isin(graph.TAXONOMY)), "p")):
            for r in df.groupBy(key).count().orderBy(F.col("count").desc(), key).limit(given.top).collect():
                yield f"{name} {r[key]}: {r['count']}"
        unmapped = store.read_graph(self.spark, f"{self.s.graph_dir}/jsonl").get("unmapped")
        for r in unmapped.orderBy(F.col("links").desc(), "template", "field_name").limit(given.top).collect() if unmapped is not None else []:
            yield f"unmapped {r.template} / {r.field_name}: {r.links} links on {r.pages} pages"

    def kg_show(self, given) -> Iterator[str]:
        k = self._graph()
        node = self._resolve(k, given.title)
        one = self.spark.createDataFrame([(node.id, node.id)], "id string, anchor string")
        classes = graph.classes_of(k.classes, one).first().classes
        yield node.label + (f" ({', '.join(classes)})" if classes else "")
        for r in graph.facts(k.adj, k.nodes, k.preds, one.select("anchor"), given.limit).orderBy("position").collect():
            yield r.sentence
        cats = k.edges.where((F.col("s") == node.id) & (F.col("p") == "instance_of")).join(k.nodes.select(F.col("id").alias("o"), "label"), "o").orderBy("label").collect()
        if cats:
            yield "categories: " + ", ".join(r.label for r in cats)

    def _lines(self, k: SimpleNamespace, paths: DataFrame, label: str) -> Iterator[str]:
        told = graph.person_flags(paths, k.classes, list(ontology.PEOPLE)).withColumn("line", narrated(k.preds, F.lit(label), F.col("preds"), F.col("dirs"), F.col("labels"), F.col("persons")))
        for r in told.orderBy("position").collect():
            yield f"{r.score:.3f}  {r.line}\n       via {' -> '.join(p + ('' if d == 'out' else ' (back)') for p, d in zip(r.preds, r.dirs, strict=True))}"

    def _walk(self, k: SimpleNamespace, node, hops: int, **more) -> DataFrame:
        seeds = self.spark.createDataFrame([(1, node.id)], "qid int, anchor string")
        return graph.walk(k.adj, seeds, k.degree, k.preds, ontology.NO_TRANSIT, ontology.SYMMETRIC, hops, self.s.kg_beam, self.s.kg_hub_degree, **more)

    def kg_chain(self, given) -> Iterator[str]:
        k = self._graph()
        node = self._resolve(k, given.title)
        paths = graph.expand(self._walk(k, node, given.hops or 2), 4 * given.limit, k.degree.withColumnRenamed("degree", "prominence"))
        paths = paths.where("depth >= 2") if given.deep_only else paths
        lines = list(self._lines(k, paths, node.label))[: given.limit]
        if not lines:
            raise Nothing("no typed relations lead on from here")
        yield from [node.label, *lines]

    def kg_path(self, given) -> Iterator[str]:
        k = self._graph()
        a, b = self._resolve(k, given.start), self._resolve(k, given.end)
        end = self.spark.createDataFrame([(1, b.id)], "qid int, anchor string")
        lines = list(self._lines(k, graph.connect(self._walk(k, a, given.hops or self.s.kg_connect_hops, stop_at=end), end, given.limit), a.label))
        if not lines:
            raise Nothing("no typed route within that many steps; routes over places and hubs do not count")
        yield from [f"{a.label} -> {b.label}", *lines]

    def kg_compare(self, given) -> Iterator[str]:
        k = self._graph()
        a, b = self._resolve(k, given.first), self._resolve(k, given.second)
        rows = graph.compare(k.adj, self.spark.createDataFrame([(1, a.id, b.id)], "qid int, a string, b string"), k.preds, given.limit).orderBy("position").collect()
        if not rows:
            raise Nothing("nothing is recorded of both")
        for r in rows:
            yield f"{r.verb}\n  {a.label}: {', '.join(r.a_objects[:5])}\n  {b.label}: {', '.join(r.b_objects[:5])}" + (f"\n  both: {', '.join(r.shared[:5])}" if r.shared else "")

    def kg_viz(self, given) -> Iterator[str]:
        k = self._graph()
        kinds = ["explorer", "schema"] if given.kind == "both" else [given.kind]
        yield from report.write_pages(given.out or f"{self.s.graph_dir}/viz", kinds, k.nodes, k.edges, k.preds, k.classes)


def desk(spark: SparkSession, s: Settings, model_url: str, embed_model: str) -> Desk:
    """A desk whose models are behind HTTP."""
    return Desk(spark, s, clients.ChatClient(model_url, s), clients.EmbedClient(model_url, embed_model))
