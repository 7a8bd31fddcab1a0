"""Queries over rows that lie beyond what the smallest tables hold, against brute force."""

import hashlib
import random

import numpy as np

from lorekeep.operators import vectors
from lorekeep.queries import corpus, retrieval


def packed(text, target, keep):
    done, open_, fresh = [], "", 0
    for b in [x.strip(" ") for x in text.split("\n") if x.strip(" ")]:
        joined = f"{open_}\n{b}" if open_ else b
        if open_ and fresh and len(joined) > target:
            end = open_[-keep:]
            tail = "" if len(open_) <= keep else end[end.index(" ") + 1 :] if " " in end else end
            done, open_, fresh = [*done, open_], f"{tail}\n{b}" if tail else b, 1
        else:
            open_, fresh = joined, fresh + 1
    return [*done, open_] if open_ else done


def test_long_documents_and_unknown_lengths_are_packed(spark, tmp_path):
    r = random.Random(2)
    line = lambda: " ".join("x" * r.randrange(1, 9) for _ in range(r.randrange(40)))
    texts = ["\n".join(line() for _ in range(n)) for n in (3, 900, 40)] + ["y" * 25_000, None]
    rows = [(i, t, None if i == 2 else len(t or "")) for i, t in enumerate(texts)]
    assert rows[1][2] > 20_000
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(x.doc_id, x.nth): (x.chars, x.md5) for x in corpus.chunk_pack(spark, str(tmp_path)).collect()}
    s = corpus.SIZES
    want = {(i, n): (len(p), hashlib.md5(p.encode()).hexdigest()) for i, t in enumerate(texts) for n, p in enumerate(packed(t or "", s.chars(s.target), s.chars(s.overlap)))}
    assert got == want and {i for i, _ in got} == {0, 1, 2, 3}


def test_every_question_has_a_vector_channel(spark, tmp_path):
    r = np.random.default_rng(4)
    e = np.round(r.normal(size=(300, 4)), 1).astype(np.float32)  # with ties
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    items = [0, 39, 40, 77, 299, 500]
    spark.createDataFrame([(i, f"question alpha {i}") for i in [*items, 77]], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, f"text beta {i}", "a") for i in range(300)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for x in retrieval._rankings(spark, str(tmp_path)).where("channel = 'vec'").collect():
        got.setdefault(x.qid, {})[x["rank"]] = x.chunk_id
    d = lambda i: np.round(np.sqrt(((e.astype(float) - e[i].astype(float)) ** 2).sum(1)), 6)
    want = {i: dict(enumerate(np.lexsort((np.arange(300), d(i)))[: retrieval.K].tolist(), 1)) for i in items if i < 300}
    assert got == want
    seen = {x.qid for x in retrieval.rrf_fuse(spark, str(tmp_path)).where("vec_rank is not null").collect()}
    assert seen == set(want)


def test_knn_of_more_queries_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PAIR_QUERIES", 3)
    monkeypatch.setattr(vectors, "PAIR_VECTORS", 7)
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(50)], "vec_id long, embedding array<float>").repartition(4)
    few = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(20)]
    key = lambda df: sorted((r.qid, r.vec_id, r.distance, r["rank"]) for r in df.collect())
    got = key(vectors.knn_of(v, spark.createDataFrame(few, "qid long, v array<float>"), 4))
    assert got == key(vectors.knn(v, few, 4)) and len(got) == 80
    assert not key(vectors.knn_of(v, spark.createDataFrame([], "qid long, v array<float>"), 4))
