"""Repeated passages that share no whole line or sentence with their copies."""

import random

import pytest

from lorekeep.llm import line_dedup, queries


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    prose = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    passage, long = prose(50), prose(120).split()
    changed = [*long[:60], "other", *long[61:]]
    return [
        (1, f"{prose(30)} {passage} {prose(30)}"), (2, f"{prose(7)} {passage} {prose(41)}"), (3, passage.replace(" ", "\n", 25) + " " + prose(3)),
        (4, " ".join(long)), (5, f"{prose(5)} {' '.join(changed)} {prose(5)}"), (6, "spam " * 300), (7, prose(200)), (8, None), (9, "é" * 30 + " " + prose(38)),
    ]


def test_any_shared_fifty_words_lose_words(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op9_line_hash_dedup(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    assert all(not got[i].spans and got[i].n_units_removed == 0 for i in (1, 4, 7, 8, 9))  # first or only places stay whole
    text = dict(rows)
    earlier = {2: (1,), 3: (1, 2), 5: (4,)}
    for i, least in ((2, 20), (3, 20), (5, 60)):
        assert got[i].n_units_removed > 0 and got[i].words_removed >= least
        raw, n = text[i].encode(), 0
        for s, e in got[i].spans:
            w = raw[s:e].decode().split()
            n += len(w)
            assert any(f" {' '.join(w)} " in f" {' '.join(text[j].split())} " for j in earlier[i])
        assert n == got[i].words_removed
    assert 20 <= 300 - got[6].words_removed <= 300 - 240  # a text that repeats itself keeps its first stretch


def test_every_shared_run_shares_a_stretch(spark):
    r = random.Random(3)
    least = line_dedup.STRETCH + line_dedup.WINDOW - 1
    docs = []
    for i in range(60):
        shared = " ".join(f"w{r.randrange(3000)}" for _ in range(least))
        docs += [(2 * i + k, " ".join([*(f"a{r.random()}" for _ in range(r.randrange(40))), shared, *(f"a{r.random()}" for _ in range(r.randrange(40)))])) for k in range(2)]
    got = line_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string"), min_words=10, sentences=True, stretches=True)
    assert all((row.words_removed >= line_dedup.STRETCH) == (row.doc_id % 2 == 1) for row in got.collect())
