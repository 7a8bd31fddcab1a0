"""Every registered query of the engine against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from lorekeep.queries import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries whose parts other ones here hold as well: hybrid_retrieve, recall_mrr, graph_ab, graph_context.
HELD_ELSEWHERE = ("rrf_fuse", "fusion_sweep", "answer_in_context", "graph_channel", "context_chains", "context_facts")
FAST = [n for n, (_, sql) in catalogue().items() if sql and n not in HELD_ELSEWHERE]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, duck, name):
    build, sql = catalogue()[name]
    df = build(spark, DIR)
    rel = duck.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    names = sorted(df.columns)
    at = [rel.columns.index(c) for c in names]
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
