"""The streaming encoder against the library's own results."""

import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from lorekeep.llm import sentencepiece_codec as sc
from lorekeep.llm.queries import MODEL_PATH

random.seed(3)
LETTERS = "abcdefgh the in  é日本語😀▁\n\tß" + " " * 4
TEXTS = ["", " ", "   lead", "trail   ", "Straße 日本 😀", "word " * 400, "x" * 300, *("".join(random.choice(LETTERS) for _ in range(random.randint(1, 60))) for _ in range(1500))]


@pytest.fixture(scope="module")
def model():
    return sc.read_model(MODEL_PATH)


def test_bpe_ids_and_round_trip(model):
    codec, lib = sc.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for t in TEXTS:
        want = lib.encode(t)
        assert codec.encode(t) == want, t
        assert codec.decode(want) == t.replace("▁", " ").encode(), t
        if t:
            assert list(codec.walk(" " + t.replace("▁", " "))) == want, t


def test_unigram_scores_are_best():
    m = pb.ModelProto()
    m.ParseFromString(sc.read_model(MODEL_PATH))
    m.trainer_spec.model_type = sc.UNIGRAM
    for i, p in enumerate(m.pieces):
        p.score = -5.0 - (i * 7919 % 1000) / 97
    raw = m.SerializeToString()
    codec, lib = sc.Codec(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    total = lambda ids: sum(m.pieces[i].score for i in ids)
    for t in ("the streaming walk finds it", "another one, with commas", "abcdefgh " * 30):
        a, b = codec.encode(t), lib.encode(t)
        assert total(a) == pytest.approx(total(b), abs=1e-3) and codec.decode(a) == t.encode()


def test_memory_is_bounded(model):
    codec, most = sc.Codec(model), 0

    def chars():
        for _ in range(20_000):
            yield random.choice("abcde ")

    real = codec._commit

    def watched(back, base, end):
        nonlocal most
        most = max(most, len(back))
        return real(back, base, end)

    codec._commit = watched
    assert sum(1 for _ in codec.walk(chars())) > 1000 and most < 40 * codec.longest


def long_stretches():
    r = random.Random(8)
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    return [pick("abcdeinthgr", r.randrange(60, 256)) for _ in range(90)] + [pick("日本語のはé", r.randrange(1, 400)) for _ in range(90)] + ["ab" * 200, "a" * 257, pick("etaoin", 3000)]


def test_long_stretches_are_committed_in_the_window(model):
    """Lanes longer than the window, of several lengths; a window that must grow; one lane alone."""
    codec, lib = sc.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = long_stretches()
    want = [lib.encode(t) for t in texts]
    (_, _, ids, off), = codec.encode_many(sc.pa.array(texts))
    assert [ids[off[k] : off[k + 1]].tolist() for k in range(len(texts))] == want
    cps, ends = codec.normal(np.frombuffer("".join(texts).encode(), np.uint8), np.r_[0, np.cumsum([len(t.encode()) for t in texts])], True)
    lane, start, sym = codec.walk_lanes(cps, ends)
    assert (np.diff(lane) >= 0).all() and (np.diff(start) > 0).all()
    for k in (0, 60, 100, len(texts) - 1):
        assert [i for c, i in zip(cps[start[lane == k]], sym[lane == k], strict=True) for i in ([i] if i < codec.n else codec.ids_of_char(int(c)))] == want[k]


def test_scores_that_rise_on_the_way(model):
    """Merges whose product scores better than its parts: stability is then found by merging."""
    m = pb.ModelProto()
    m.ParseFromString(model)
    r = random.Random(4)
    for p in m.pieces:
        if p.type == sc.NORMAL and len(p.piece) > 1:
            p.score = -float(r.randrange(1, 400_000))
    raw = m.SerializeToString()
    codec, lib = sc.Codec(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    assert not codec.falling.all()
    for t in TEXTS[:400] + ["the streaming walk finds every boundary that is left", "information retrieval and representation " * 5]:
        assert codec.encode(t) == lib.encode(t), t


def test_pairs_equal_the_merges(model):
    codec, r = sc.Codec(model), np.random.default_rng(2)
    usable = np.unique(codec.of_node[(codec.of_node >= 0) & (codec.of_node < codec.n)])
    p, q = r.choice(usable, 3000), r.choice(usable, 3000)
    assert codec.stable_pairs(p, q).tolist() == [codec.merged(codec.text[a] + codec.text[b]) == [codec.text[a], codec.text[b]] for a, b in zip(p, q, strict=True)]


def test_a_text_over_many_blocks(spark, model):
    """Over 1 MB, and over several blocks: walked block by block, the same ids as in one piece."""
    r = random.Random(6)
    text = "  ".join(r.choice(TEXTS[8:]) for _ in range(40_000))
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    codec = sc.Codec(model)
    parts = list(codec.parts(text.encode(), 1000))
    assert len(parts) > 100 and b"".join(parts) == text.encode()
    d = spark.createDataFrame([(1, text, 3), (None, "x" * 5000, 4)], "doc_id long, text string, ids int")
    got = {x.doc_id: x for x in sc.round_trip(d, model).collect()}
    assert len(text) > 1 << 20 and got[1].ids == lib.encode(text) and got[None].ids == lib.encode("x" * 5000) and got[None].exact
    size, sc.BLOCK_BYTES = sc.BLOCK_BYTES, 20_000
    try:
        (_, _, ids, _), = codec.encode_many(sc.pa.array([text]))
    finally:
        sc.BLOCK_BYTES = size
    assert ids.tolist() == got[1].ids


def test_bytes_that_are_no_utf8(model):
    codec = sc.Codec(model)
    raw = b"caf\xe9 \xff\xfe ok"
    (_, _, ids, off), = codec.encode_many(sc.pa.array([raw, b"fine"], sc.pa.binary()))
    assert codec.decode(ids[: off[1]].tolist()) == raw and codec.decode(ids[off[1] :].tolist()) == b"fine"


def test_frames(spark, model):
    d = spark.createDataFrame([(1, "Hello there"), (2, None), (3, ""), (3, "again"), (None, "x")], "doc_id long, text string").repartition(2)
    rows = sc.round_trip(d, model).collect()
    assert len(rows) == 5 and all(r.exact for r in rows) and all(r.n_ids == len(r.ids) for r in rows)
    back = {(r.doc_id, r.text) for r in sc.decode(sc.encode(d, model), model).collect()}
    assert back == {(1, "Hello there"), (2, ""), (3, ""), (3, "again"), (None, "x")}
    assert sc.encode(d.limit(0), model).count() == 0
