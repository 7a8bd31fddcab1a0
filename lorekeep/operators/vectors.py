"""Vectors: normalising, embedding, exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOCUMENT_PREFIX, QUERY_PREFIX = "search_document: ", "search_query: "
#: Query vectors held by each task at a time (64-bit floats).
QUERY_BLOCK = 2_048
#: Queries and vectors of a pair of blocks, where queries are a table.
PAIR_QUERIES, PAIR_VECTORS = 256, 4_096


def l2_normalised(v: Column) -> Column:
    """v scaled to length 1; a zero vector stays as it is."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm)).otherwise(d)


def knn(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(qid, id, distance, rank): the k nearest vectors by Euclidean distance, exactly.

    A stated batch of queries meets all vectors: each task keeps its k best of every query, one
    matrix product a batch of rows, and only those move. The queries go out in blocks of
    QUERY_BLOCK, so what a task holds is bounded.
    """
    blocks = [queries[i : i + QUERY_BLOCK] for i in range(0, len(queries), QUERY_BLOCK)] or [[]]
    found = None
    for block in blocks:
        ids = np.array([q for q, _ in block], np.int64)
        q = np.array([v for _, v in block], float).reshape(len(block), -1)

        def nearest(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            best_d = np.full((len(ids), 0), np.inf)
            best_i = np.zeros((len(ids), 0), np.int64)
            for b in batches:
                if not b.num_rows or not len(ids):
                    continue
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float)
                d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * q @ x.T, 0))
                d = np.c_[best_d, np.round(d, 9)]
                i = np.c_[best_i, np.broadcast_to(b.column("id").to_numpy(), (len(ids), b.num_rows))]
                order = np.lexsort((i, d), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
            n = best_d.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best_i.ravel()), pa.array(best_d.ravel())], names=["qid", id_col, "distance"])

        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null")
        part = rows.mapInArrow(nearest, f"qid long, {id_col} long, distance double")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("distance", 6), id_col))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("distance", F.round("distance", 6))


def knn_of(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """As knn, for queries (qid, v) of any number that stay in the cluster.

    Both sides are packed into blocks of rows and every pair of blocks is one matrix product that
    yields the k nearest of its queries; only the number of queries comes to the driver. A task holds
    as many pairs at a time as spark.sql.execution.arrow.maxBytesPerBatch lets it (64 MB by default).
    """
    queries = queries.select(F.col("qid").cast("long").alias("id"), "v").where("id is not null and v is not null")
    n_blocks = max(1, -(-queries.count() // PAIR_QUERIES))
    q = queries.repartition(n_blocks).mapInArrow(_blocks(PAIR_QUERIES), "ids binary, vs binary").toDF("q_ids", "q_vs")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null")
    x = rows.mapInArrow(_blocks(PAIR_VECTORS), "ids binary, vs binary")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                qid, i = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q, v = np.frombuffer(r["q_vs"]).reshape(len(qid), -1), np.frombuffer(r["vs"]).reshape(len(i), -1)
                d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1) - 2 * q @ v.T, 0))
                d = np.floor(d * 1e6 + 0.5) / 1e6  # ties are ties of the rounded distance
                order = np.lexsort((np.broadcast_to(i, d.shape), d), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, order.shape[1])), pa.array(i[order].ravel()), pa.array(np.take_along_axis(d, order, 1).ravel())], names=["qid", id_col, "distance"])

    found = x.crossJoin(q).mapInArrow(nearest, f"qid long, {id_col} long, distance double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", id_col))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("distance", F.round("distance", 6))


def _blocks(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, v) as blocks of up to `size` rows: their ids and vectors as bytes of 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, size):
                part = b.slice(i, size)
                ids, vs = part.column("id").to_numpy(), part.column("v").flatten().to_numpy(zero_copy_only=False).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([vs.tobytes()], pa.binary())], names=["ids", "vs"])

    return run


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 16, id_col: str = "chunk_id", text_col: str = "embed_text") -> DataFrame:
    """(id, embedding) from an injected model that takes `batch` texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                vecs = embed([DOCUMENT_PREFIX + (t or "") for t in part.column("text").to_pylist()])
                norms = [float(np.linalg.norm(v)) or 1.0 for v in vecs]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([[x / n for x in v] for v, n in zip(vecs, norms, strict=True)], pa.list_(pa.float32()))], names=[id_col, "embedding"])

    return chunks.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} long, embedding array<float>")


def hash_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for a model: signed hashed words."""

    def embed(texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h & 0x10000 else -1.0
            out.append(v)
        return out

    return embed
