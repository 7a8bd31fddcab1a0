"""Named tables under one folder: the index and the graph, with their life cycle, counts and notes."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import extract as ex
from lorekeep.sources.tables import exists

INDEX_TABLES = ["pages", "chunks", "postings", "stats", "vectors"]
GRAPH_TABLES = ["nodes", "node_classes", "edges", "links"]
#: How the graph's tables look as JSON lines.
JSON_SCHEMAS = {
    "nodes": "id string, kind string, label string, page_id long, url string, aliases array<string>",
    "edges": "s string, p string, o string, src string, field string, raw string",
    "links": "s string, o string, n long",
    "classes": "node string, class string",
    "unmapped": "template string, field_name string, pages long, links long",
    "predicates": "p string, label string, inverse string, priority int",
}


class TableStore:
    """Parquet tables at path/name; a table that is not there counts as empty."""

    def __init__(self, spark: SparkSession, path: str, names: list[str]):
        self.spark, self.path, self.names = spark, path.rstrip("/"), names

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def has(self, name: str) -> bool:
        return exists(self.spark, f"{self.path}/{name}/_SUCCESS")

    def read(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{name}") if self.has(name) else None

    def write(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        fs, p = self._file(name)
        fs.delete(p, True)

    def reset(self) -> None:
        """Without any table and note; everything here can be made again."""
        for n in [*self.names, "meta"]:
            self.drop(n)

    def counts(self) -> dict[str, int]:
        return {n: t.count() if (t := self.read(n)) is not None else 0 for n in self.names}

    def set_meta(self, key: str, value: str) -> None:
        rows = {**self.all_meta(), key: value}
        made = self.spark.createDataFrame(list(rows.items()), "key string, value string").coalesce(1)
        self.write("meta_next", made)
        self.drop("meta")
        fs, p = self._file("meta_next")
        fs.rename(p, self._file("meta")[1])

    def all_meta(self) -> dict[str, str]:
        held = self.read("meta")
        return {r.key: r.value for r in held.collect()} if held is not None else {}

    def get_meta(self, key: str, default: str | None = None) -> str | None:
        return self.all_meta().get(key, default)


class GraphStore(TableStore):
    """The graph's tables; nodes that are loaded again replace those of the same id."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, GRAPH_TABLES)

    def load(self, tables: dict[str, DataFrame]) -> None:
        """nodes (fields beyond the usual go into `data` as JSON), one row a node and class, edges with numbers, links."""
        nodes = tables["nodes"]
        usual = ["id", "kind", "label", "page_id", "url"]
        extra = [c for c in nodes.columns if c not in usual]
        data = F.to_json(F.struct(*extra)) if extra else F.lit(None).cast("string")
        one = nodes.select(*usual, data.alias("data")).groupBy("id").agg(F.min_by(F.struct("kind", "label", "page_id", "url", "data"), F.struct("kind", "label")).alias("n")).select("id", "n.*")
        self.write("nodes", one)
        self.write("node_classes", tables["classes"].select("node", "class"))
        self.write("edges", tables["edges"].withColumn("eid", F.shiftrightunsigned(F.xxhash64("s", "p", "o", "src", "field"), 16)))
        self.write("links", tables["links"])
        self.write("predicates", tables["predicates"])
        self.set_meta("built_at", datetime.now(UTC).isoformat(timespec="seconds"))

    def counts(self) -> dict[str, int]:
        n = super().counts()
        e = self.read("edges")
        return n | {"typed_edges": e.where(~F.col("p").isin("instance_of", "subclass_of")).count() if e is not None else 0}

    @property
    def is_populated(self) -> bool:
        return self.counts()["edges"] > 0


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that `extract.write_graph` wrote as JSON lines, the ontology's snapshot among them."""
    return {n: spark.read.schema(schema).json(f"{path}/{n}.jsonl") for n, schema in JSON_SCHEMAS.items() if exists(spark, f"{path}/{n}.jsonl")}


def build_graph(raw: DataFrame, redirects: DataFrame, onto: ex.Ontology, folder: str, store: GraphStore | None = None, rules: DataFrame | None = None) -> dict[str, int]:
    """Extract the graph, write it as JSON lines under folder and, if there is a store, load it from these. Returns the rows of each table."""
    made = ex.extract(raw, redirects, onto, rules)
    ex.write_graph(made, folder)
    back = read_graph(raw.sparkSession, folder)
    if store is not None:
        store.reset()
        store.load(back)
        store.set_meta("ontology", json.dumps({"classes": len(onto.classes), "predicates": len(onto.predicates)}))
    return {n: t.count() for n, t in back.items()}


def fetch_all(client, spark: SparkSession, folder: str, namespaces: list[int], force: bool = False) -> dict[int, int]:
    """Fetch the pages of each name space and the redirects from a wiki into JSON lines; what is there stays unless forced."""
    from lorekeep.sources import tables

    got = {}
    for ns in namespaces:
        path = tables.raw_path(folder, ns)
        if force or not exists(spark, path):
            rows = list(client.fetch([p["title"] for p in client.list_pages(ns)]))  # one client is one polite crawler
            spark.createDataFrame(rows, tables.RAW_PAGE).write.mode("overwrite").json(path)
        got[ns] = tables.read_raw(spark, folder, [ns]).count()
    path = f"{folder}/redirects.jsonl"
    if force or not exists(spark, path):
        spark.createDataFrame(list(client.redirects().items()), "alias string, target string").coalesce(1).write.mode("overwrite").json(path)
    return got


def read_redirects(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder}/redirects.jsonl"
    schema = "alias string, target string"
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)
