"""Every learnt term counts in a score, also one that shares its slot with a heavier one."""

import numpy as np
import pyarrow as pa

from lorekeep.llm import toxicity


def test_terms_of_one_slot_all_count():
    words = [f"w{i}" for i in range(9000)]
    terms = toxicity.hashed_words(words)
    slot = (terms & np.uint64(toxicity.TABLE - 1)).astype(int)
    _, first, n = np.unique(slot, return_index=True, return_counts=True)
    a = first[n > 1][0]
    b = np.flatnonzero((slot == slot[a]) & (np.arange(len(words)) != a))[0]
    run = toxicity.scorer(terms[[a, b]], np.array([2.0, -1.0]), 0.5)
    texts = [words[a], words[b], f"{words[b]} {words[a]} {words[b]}", f"{words[b]} " * 5, "none", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = np.concatenate([r.column("score").to_numpy() for r in run(iter([batch]))])
    assert np.allclose(got, 1 / (1 + np.exp(-np.array([2.5, -0.5, 0.5, -2.5, 0.5, 0.5]))))
