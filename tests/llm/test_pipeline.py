"""The pipeline against a brute-force version of its stages, and the registered queries against SQL."""

import collections

import duckdb
import sentencepiece
from test_operators import repeats, true_components, words

import corpus_pipeline
from lorekeep.llm import mixing, quality, queries
from lorekeep.llm.common import table

DIR = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = [tuple(r) for r in table(spark, DIR, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    good = {r.doc_id for r in quality.trusted_ids(table(spark, DIR, "labels")).collect()}
    verdict = {r.doc_id: r for r in queries.op1_ngram_ratio_quality(spark, DIR).collect()}
    kept = []
    for d in docs:
        w = words(d[1])
        failed = len(w) < 50 or 100 * repeats(w) > 50 * len(w)
        assert verdict[d[0]].base_failed == failed
        if not failed and verdict[d[0]].score >= quality.THRESHOLD:
            kept.append(d)
    assert len(good) > 10 and 0.5 * len(docs) < len(kept) < len(docs)
    best = {}
    for d in kept:
        best[d[1]] = max(best.get(d[1], d), d)
    comps = true_components(list(best.values()))
    single = [d for d in best.values() if comps[d[0]][2]]
    frame = spark.createDataFrame(single, "doc_id long, text string, lang string, source string, n_chars long")
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(frame).collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL_PATH)
    want = collections.Counter()
    for d in single:
        if copies[d[0]]:
            want[d[0], tuple(lib.encode(d[1]))] += copies[d[0]]
    got = collections.Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, DIR).collect())
    assert got == want


def test_exact_copies_equal_their_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, DIR)
        assert sorted(map(tuple, df.collect())) == sorted(con.sql(sql).select(*df.columns).fetchall())


def test_stages_take_awkward_rows(spark):
    """Nulls in any column, empty texts, repeated rows, an empty table: every stage but the last gives columns of documents."""
    text = " ".join(f"w{i}" for i in range(80))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, text, None, None, None), (1, text, None, None, None), (None, text, "en", "a", 3), (2, None, "en", "a", 0), (3, "", "en", None, 0), (None, None, None, None, None), (4, text + " more", "fr", "b", 9)]
    labels = {i for i in (1, 4)}
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        sizes = []
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, DIR), name.replace(" ", "_"))
            sizes.append(docs.count())
            assert docs.columns == (corpus_pipeline.COLUMNS if name != "piece ids" else ["doc_id", "n_ids", "ids"])
        assert sizes == ([0] * 5 if not given else sizes) and labels
        if given:  # texts under fifty words go, copies go, the near copy goes with its group
            assert sizes[0] == 4 and sizes[1] == 2 and 1 <= sizes[2] <= 2
