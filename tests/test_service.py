"""Decomposition, answering, the API's checks, the wiki client, evaluation cases, streams and the entry's contract."""

import pytest

import __spark_entry__
from lorekeep import config
from lorekeep.plans import answer, report
from lorekeep.sources import tables, wiki
from lorekeep.streaming import incremental


@pytest.mark.parametrize(("raw", "want"), [
    ("1. Who was Ali's teacher?\n2) Where did he live then?", ["Who was Ali's teacher?", "Where did he live then?"]),
    ("Sure, here they are:\n```text\n- Who taught him law?\n* Who taught him verse?\n```", ["Who taught him law?", "Who taught him verse?"]),
    ("SINGLE", []), ("", []), (None, []), ("1. Who was it then?", []), ("1. short one\n2. also", []),
    ("1. Who was it then?\n2. Who was it then?", []), ("\n".join(f"{i}. What is number {i} of them?" for i in range(9)), [f"What is number {i} of them?" for i in range(3)]),
])
def test_sub_questions(raw, want):
    assert answer.sub_questions(raw) == want


def engine(hits):
    def chat(model, messages, **options):
        yield from ("So ", "it is [1].")

    return answer.Engine(lambda q, k, parts: answer.Retrieval("ctx", hits, 3), chat)


def test_answer_stream_and_api():
    hit = {"url": "u", "position": 1, "section": "Summary"}
    events = list(engine([hit]).stream("a question"))
    assert [e["event"] for e in events] == ["sources", "delta", "delta", "done"] and events[-1]["answer"]["text"] == "So it is [1]."
    assert engine([]).answer("a question")["text"] == answer.NO_CONTEXT
    api = answer.Api(engine([hit]), lambda: {"embedder": True, "chunks": 3, "vectors": 3})
    assert api.health()["ok"] and api.search("what")["context_tokens"] == 3 and api.ask("what")["model"] == "small"
    for q, k in (("x", None), ("x" * 2001, None), ("ok", 0), ("ok", 21)):
        with pytest.raises(ValueError, match="422"):
            api.ask(q, k)
    with pytest.raises(RuntimeError, match="503"):
        answer.Api().ask("what")
    assert answer.split("q", lambda p: 1 / 0) == []


def test_wiki_client_retries_and_follows():
    calls, slept = [], []

    def transport(params):
        calls.append(params)
        if len(calls) == 1:
            return 429, {"Retry-After": "2"}, {}
        if len(calls) == 2:
            return 200, {}, {"error": {"code": "maxlag"}}
        more = {} if "apcontinue" in params else {"continue": {"apcontinue": "B"}}
        return 200, {}, {"query": {"allpages": [{"title": params.get("apcontinue", "A")}]}} | more

    c = wiki.WikiClient(transport, "http://x", sleep=slept.append)
    assert [p["title"] for p in c.list_pages(0)] == ["A", "B"] and 2.0 in slept
    with pytest.raises(RuntimeError, match="refused"):
        wiki.WikiClient(lambda p: (200, {}, {"error": {"code": "bad"}}), "", sleep=slept.append).get()
    pages = {"query": {"pages": [{"title": "R", "links": [{"title": "T"}]}, {"title": "S", "links": [{"title": "T"}, {"title": "U"}]}]}}
    assert wiki.WikiClient(lambda p: (200, {}, pages), "", sleep=slept.append).redirects() == {"R": "T"}
    page = {"query": {"pages": [{"pageid": 1, "ns": 0, "title": "A b", "revisions": [{"revid": 2, "slots": {"main": {"content": "x"}}}]}, {"title": "M", "missing": True}]}}
    got = list(wiki.WikiClient(lambda p: (200, {}, page), "http://x", sleep=slept.append).fetch(["A b", "M"]))
    assert [(g["title"], g["url"]) for g in got] == [("A b", "http://x/A_b")]


def test_raw_pages_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([(1, 0, "T", "u", 5, "t", ["c"], "w"), (2, 14, "C", "u", 6, "t", [], "w")], tables.RAW_PAGE)
    tables.write_raw(raw, str(tmp_path))
    back = tables.read_raw(spark, str(tmp_path))
    assert sorted(r.pageid for r in back.collect()) == [1, 2] and {r.ns: r.n_pages for r in tables.raw_counts(back).collect()} == {0: 1, 14: 1}
    assert tables.read_raw(spark, str(tmp_path / "none")).count() == 0


def test_cases_and_excerpts():
    got = report.cases('# c\n- q: "Who?"\n  expect: [A, "B c"]\n  answer: Ali\n- q: What?\n  expect: [D]\n')
    assert got == [{"q": "Who?", "expect": ["A", "B c"], "answer": "Ali"}, {"q": "What?", "expect": ["D"], "answer": None}]
    assert report.excerpts("[KG] x\n[1] y") == "[1] y"


def test_scores(spark):
    hits = spark.createDataFrame([(1, 2, "A"), (1, 1, "X"), (2, 1, "Y")], "qid long, position int, title string")
    ctx = spark.createDataFrame([(1, "it was ALI", 10), (2, "no", 20)], "qid long, context string, context_tokens int")
    truth = spark.createDataFrame([(1, ["a"], "Ali"), (2, ["Z"], None)], "qid long, expect array<string>, answer string")
    r = report.scores(hits, ctx, truth).first()
    assert (r.recall, r.mrr, r.answer_in_context, r.median_tokens) == (0.5, 0.25, 1.0, 15.0)


def test_settings():
    s = config.from_env({"LOREKEEP_RRF_K": "7", "LOREKEEP_DECOMPOSE": "yes"})
    assert s.rrf_k == 7 and s.decompose and s.model("quality") == "large"
    with pytest.raises(ValueError, match="profile"):
        s.model("x")


def test_resumed_embedding(spark, tmp_path):
    from lorekeep.operators.vectors import hash_embedder

    src, out = str(tmp_path / "chunks"), str(tmp_path / "vectors")
    frame = lambda ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "chunk_id long, embed_text string")
    for ids in ([1, 2], [2, 3]):
        frame(ids).write.mode("append").parquet(src)
        q = incremental.embed_new(spark.readStream.schema("chunk_id long, embed_text string").parquet(src), out, hash_embedder(8), str(tmp_path / "cp"))
        q.awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted(r.chunk_id for r in rows) == [1, 2, 3] and all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in rows)


def test_entry_contract(spark):
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 60
    assert __spark_entry__.entry(spark).columns[:3] == ["qid", "position", "chunk_id"]


def test_clients_read_both_shapes_and_end_when_done():
    from lorekeep.plans import clients

    sent = []

    def post(url, payload):
        sent.append((url, payload))
        if url.endswith("/api/chat"):
            yield from ({"message": {"content": "So"}}, {"message": {}}, {"message": {"content": " it is"}, "done": True}, {"message": {"content": "never"}})
        else:
            yield {"embedding": [1.0]} if len(payload["input"]) == 1 else {"embeddings": [[1.0], [2.0]]}

    chat = clients.ChatClient("http://m/", config.Settings(), post)
    assert "".join(chat("small", [{"role": "user", "content": "q"}], temperature=0.0)) == "So it is"
    assert sent[0][0] == "http://m/api/chat" and sent[0][1]["options"]["temperature"] == 0.0 and sent[0][1]["options"]["num_predict"] == 512
    embed = clients.EmbedClient("http://m", "e", post, lambda: ["e:latest"])
    assert embed(["a"]) == [[1.0]] and embed(["a", "b"]) == [[1.0], [2.0]] and embed.health() == (True, "ok")
    with pytest.raises(RuntimeError, match="no vectors"):
        clients.EmbedClient("http://m", "e", lambda u, p: iter([{}]))(["a"])
    assert clients.EmbedClient("http://m", "e", post, lambda: (_ for _ in ()).throw(OSError("down"))).health()[0] is False


def test_web_service():
    import json
    import threading
    import urllib.error
    import urllib.request

    from lorekeep.plans import service

    api = answer.Api(engine([{"url": "u", "position": 1, "section": "Summary"}]), lambda: {"embedder": True, "chunks": 1, "vectors": 1})
    with service.server(api, port=0) as web:
        threading.Thread(target=web.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{web.server_address[1]}"

        def ask(path, payload=None):
            try:
                with urllib.request.urlopen(urllib.request.Request(base + path, payload if payload is None else json.dumps(payload).encode()), timeout=10) as r:
                    return r.status, r.read().decode()
            except urllib.error.HTTPError as e:
                return e.code, e.read().decode()

        assert ask("/health")[0] == 200 and json.loads(ask("/search", {"question": "what"})[1])["context_tokens"] == 3
        assert json.loads(ask("/ask", {"question": "what"})[1])["text"] == "So it is [1]."
        assert ask("/ask/stream", {"question": "what"})[1].count("data: ") == 4
        assert [ask("/ask", p)[0] for p in ({"question": "x"}, {}, {"question": "ok", "top_k": 0})] == [422] * 3 and ask("/none", {"question": "ok"})[0] == 404
        api.engine = None
        assert ask("/ask", {"question": "what"})[0] == 503
        web.shutdown()


def test_commands_over_a_data_folder(spark, tmp_path, capsys):
    from types import SimpleNamespace as given

    from lorekeep import commands
    from lorekeep.__main__ import parser

    raw = [
        (1, 0, "Ali Reader", "u1", 1, "t", ["Category:Readers"], "{{Infobox person|teachers=[[Sara Writer]]}}Ali Reader read all the books of the town for many years and told others of what he had read there."),
        (2, 0, "Sara Writer", "u2", 1, "t", [], "{{Infobox person|students=[[Ali Reader]]|teachers=[[Old Master]]}}Sara Writer wrote many books in the town and taught those who came to hear her speak of them in those years."),
        (3, 0, "Old Master", "u3", 1, "t", [], "{{Infobox person|place of birth=[[Town]]}}Old Master taught the writers of the town for a long time and was known to all who lived there at that time."),
    ]
    s = config.Settings(data_dir=str(tmp_path))
    tables.write_raw(spark.createDataFrame(raw, tables.RAW_PAGE), s.raw_dir)
    chat = lambda model, messages, **options: iter(["Sara ", "did [1]."])
    desk = commands.Desk(spark, s, chat)
    with pytest.raises(commands.Nothing):
        list(desk.search(given(question="who", top_k=None, full=False)))
    assert list(desk.index(given(embed_only=False, text_only=True, limit=None)))[0].startswith("text index: 3 pages")
    assert "nodes: 4" in list(desk.kg_build(given(jsonl_only=False)))
    assert any("3 nodes" in x or "4 nodes" in x for x in desk.status())
    assert any("learnt from" in x for x in desk.kg_show(given(title="ali", limit=5)))
    assert any("Old Master" in x for x in desk.kg_chain(given(title="ali", hops=2, limit=4, deep_only=True)))
    assert any("Sara Writer" in x for x in desk.kg_path(given(start="ali", end="old", hops=None, limit=2)))
    assert any("learnt from" in x for x in desk.kg_compare(given(first="ali", second="sara", limit=3)))
    assert len(list(desk.kg_viz(given(out=str(tmp_path / "viz"), kind="both")))) == 2 and (tmp_path / "viz" / "schema.html").exists()
    lines = list(desk.search(given(question="Who taught Ali Reader?", top_k=3, full=False)))
    assert any(x.startswith("[1] Ali Reader") for x in lines) and any(x.startswith("[KG-PATH]") for x in lines)
    assert list(desk.ask(given(question="Who taught Ali Reader?", top_k=3, json=False, profile=None, decompose=False)))[-1] == "Sara did [1]."
    assert parser().parse_args(["kg", "path", "a", "b", "--hops", "3"]).hops == 3
