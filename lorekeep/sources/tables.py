"""Scans and sinks of tables and JSON lines."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name spaces in the order in which their pages are read.
NAMESPACES = [0, 3000, 14]
RAW_PAGE = "pageid long, ns int, title string, url string, revid long, timestamp string, categories array<string>, wikitext string"


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str, rows: int = 10_000) -> DataFrame:
    """The rows by key over tasks of some `rows` each: for small tables of whose rows much is made, which else one task would read."""
    return df.repartition(max(1, -(-df.count() // rows)), key)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; only a local master may go without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/lorekeep-work"
    return base.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: what follows reads them instead of making them again."""
    path = f"{shared_dir(df.sparkSession)}/lorekeep-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Where tables made once in an application lie, by what they were made from.
_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, name: str, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables that `make` gives, written to the shared folder when first asked for, and read from there after that.

    `name` says what they are made from; within an application equal names mean equal tables.
    """
    key = (spark.sparkContext.applicationId, name)
    path = _STORED.get(key)
    if path is None or not exists(spark, f"{path}/_names"):
        path = f"{shared_dir(spark)}/lorekeep-{uuid.uuid4().hex}"
        made = make()
        for n, df in made.items():
            df.write.parquet(f"{path}/{n}")
        spark.createDataFrame([(n,) for n in made], "name string").coalesce(1).write.parquet(f"{path}/_names")
        _STORED[key] = path
    return {r["name"]: spark.read.parquet(f"{path}/{r['name']}") for r in spark.read.parquet(f"{path}/_names").collect()}


def raw_path(folder: str, ns: int) -> str:
    return f"{folder}/ns{ns}.jsonl"


def read_raw(spark: SparkSession, folder: str, namespaces: list[int] | None = None) -> DataFrame:
    """Raw pages of the name spaces whose files exist; blank lines are skipped."""
    paths = [p for p in (raw_path(folder, n) for n in namespaces or NAMESPACES) if exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], RAW_PAGE)
    return spark.read.schema(RAW_PAGE).json(paths).where("pageid is not null")


def write_raw(pages: DataFrame, folder: str, force: bool = False) -> None:
    """One JSON-lines folder a name space; an existing one stays unless forced. The committer makes it appear at once."""
    for ns in NAMESPACES:
        pages.where(F.col("ns") == ns).write.mode("overwrite" if force else "ignore").json(raw_path(folder, ns))


def raw_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("ns").agg(F.count("*").alias("n_pages"))


def aliases(redirects: DataFrame) -> DataFrame:
    """(target, aliases) from redirects (alias, target)."""
    return redirects.groupBy("target").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def counts(tables: dict[str, DataFrame | None]) -> dict[str, int]:
    """Rows of each table, 0 for a missing one."""
    return {n: t.count() if t is not None else 0 for n, t in tables.items()}
