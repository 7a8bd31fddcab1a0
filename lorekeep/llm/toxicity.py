"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Everything is fitted on a bounded sample of labelled rows (MAX_FIT rows in the order of a seeded
hash of doc_id) whose crc32(doc_id as text) mod 3 is not 1; the others are held out. The fit runs
in one task and yields a small table of weights; the scoring then reads every whole text once.

Voters see words (runs of letters and digits, A-Z lower-cased) and their 4 to 6-byte beginnings:
a fixed lexicon of insults, lexicons mined from the sample (terms found almost only in toxic rows,
dealt to several voters by hash), and patterns (several hits, hits by density, hits close to each
other, no hit at all as a vote for clean). The label model is a two-class mixture fitted by EM on
the votes: class balance, each voter's rates of voting either way per class, and, along a tree of
the most correlated voters, its rates given how its neighbour votes, so a family of similar lexicons
does not count several times over (LabelModel). Its posteriors, never the raw labels, are the
targets of a logistic regression on hashed terms, the linear classifier that gives the score. It
learns weights of at most FEATURES terms, those whose share of rows differs most between the classes,
and every one of them counts in the scores.
Language, source, doc_id and labels are never inputs of a score.

Defined results: null and empty texts get the score of a text without terms; a document with
contradicting label rows counts as toxic; repeated rows are scored alike; without any labelled
row the fixed lexicon alone decides; a null doc_id is scored and not held out; extra columns are
ignored; an empty table gives an empty result. A text over a megabyte is read in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import tokens as tk

#: Labelled rows that the fit reads at most.
MAX_FIT = 8_000
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
GROUPS = 6
#: A mined term occurs in at least so many rows, with at least this share of toxic ones.
LEAST_ROWS, LEAST_SHARE = 4, 0.85
#: Terms that the classifier has at most, and slots of the table that finds them (a power of 2).
FEATURES = 20_000
TABLE = 1 << 20

#: Common insults, the lexicon that needs no labels.
INSULTS = (
    "idiot idiots stupid moron morons scum trash garbage loser losers pathetic worthless disgusting clown filth "
    "vermin imbecile dumb retard bastard bitch slut whore pervert creep coward liar ugly hate hateful despicable "
    "idiota imbecil estupido estupida basura asqueroso asquerosa payaso inutil idiote imbecile stupide ordure nul "
    "degoutant clown minable dumm dummkopf trottel abschaum ekelhaft wertlos versager widerlich idioten"
).split()


def term_hashes(w: tk.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(doc, hash) of words and of their beginnings; each kind has hashes of its own."""
    out = [(w.doc, w.hashes())]
    for n in PREFIXES:
        long = w.end - w.start > n
        part = tk.Words.__new__(tk.Words)
        part.data, part.sums, part.start, part.end, part.doc = w.data, w.sums, w.start[long], w.start[long] + n, w.doc[long]
        out.append((part.doc, part.hashes() ^ tk.seed(600 + n)))
    return out


def hashed_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return tk.Words(data, np.array([0, len(data)]), tk.NO_LETTER, lower=True).hashes()


def all_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, hash, position, kind) of every term of the texts, and nothing else of them."""
    docs, terms, at, kinds = [], [], [], []
    for i, _, data, off in tk.chunks(texts):
        w = tk.Words(data, off, tk.NO_LETTER, lower=True)
        for kind, (d, h) in enumerate(term_hashes(w)):
            docs.append((d + i).astype(np.int32))
            terms.append(h)
            kinds.append(np.full(len(d), kind, np.int8))
            at.append((w.start if kind == 0 else w.start[w.end - w.start > PREFIXES[kind - 1]]) - off[d])
        at[-len(PREFIXES) - 1 :] = [a.astype(np.int32) for a in at[-len(PREFIXES) - 1 :]]
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(docs, np.int32), cat(terms, np.uint64), cat(at, np.int32), cat(kinds, np.int8)


def voters(n: int, doc: np.ndarray, term: np.ndarray, at: np.ndarray, mined: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Votes (1 toxic, -1 clean, 0 none) of every voter for n texts."""
    hit = lambda mask: np.bincount(doc[mask], minlength=n)
    seeds = np.isin(term, hashed_words(INSULTS))
    found = np.isin(term, mined)
    group = (term >> np.uint64(40)) % np.uint64(GROUPS)
    votes = [hit(seeds) >= 1, hit(seeds) >= 2, *(hit(found & (group == g)) >= 1 for g in range(GROUPS)), hit(found) >= 2, hit(found) >= 4]
    dense = 200 * hit(found | seeds) >= words
    votes.append(dense & (hit(found | seeds) > 0))
    d, a = doc[found | seeds], at[found | seeds]
    order = np.lexsort((a, d))
    d, a = d[order], a[order]
    near = np.zeros(n, bool)
    if len(d) > 1:
        close = (d[1:] == d[:-1]) & (a[1:] - a[:-1] < 600) & (a[1:] > a[:-1])
        near[d[1:][close]] = True
    votes.append(near)
    out = np.stack([np.where(v, 1, 0) for v in votes], axis=1)
    return np.c_[out, np.where(hit(found | seeds) == 0, -1, 0)].astype(np.int8)


class LabelModel:
    """Two-class mixture over votes, fitted by EM, in which voters depend on the class and on one other voter.

    `start` is what an annotator who errs in a tenth of the rows says of each: one more voter, of
    fixed accuracy, that anchors which class is which.

    Within a class the votes form a tree: p(votes | class) = product of p(vote | class, vote of the
    voter's parent). The tree joins the voters of highest mutual information given the class (the
    best tree there is), so a family of voters that say the same thing counts about once. Accuracies
    are the voters' rates given the class, correlations the rates given class and parent; both are
    re-estimated in every round, the tree as well.
    """

    def __init__(self, votes: np.ndarray, start: np.ndarray, rounds: int = 30):
        p = self.start = start.astype(float)
        self.hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # row, voter, vote
        for _ in range(rounds):
            self._maximise(p)
            new = self.posterior(votes)
            if np.abs(new - p).max() < 1e-6:
                break
            p = new
        del self.hot

    def _maximise(self, p: np.ndarray) -> None:
        n, k, _ = self.hot.shape
        self.balance = float(np.clip(p.mean(), 1e-3, 1 - 1e-3))
        self.odds = np.log(self.start / (1 - self.start))
        flat = self.hot.reshape(n, 3 * k)
        both = np.stack([(flat * w[:, None]).T @ flat for w in (1 - p, p)]).reshape(2, k, 3, k, 3) + 0.5 / 9
        both /= both.sum(axis=(2, 4), keepdims=True)  # class, voter, vote, voter, vote
        one = both.sum(axis=4)[:, :, :, 0]  # class, voter, vote
        expected = one[:, :, :, None, None] * one[:, None, None, :, :]
        share = np.array([1 - self.balance, self.balance])[:, None, None]
        self.information = (share * (both * np.log(both / expected)).sum(axis=(2, 4))).sum(0)
        # the spanning tree of highest information, grown from voter 0
        self.parent, free = np.full(k, -1), np.arange(k) > 0
        best, to = self.information[0].copy(), np.zeros(k, int)
        while free.any():
            j = int(np.argmax(np.where(free, best, -np.inf)))
            self.parent[j], free[j] = to[j], False
            better = self.information[j] > best
            best, to = np.where(better, self.information[j], best), np.where(better, j, to)
        # log p(vote | class, parent's vote); the root has itself as parent
        self.log = np.zeros((2, k, 3, 3))  # class, voter, parent's vote, vote
        for j in range(k):
            joint = both[:, self.parent[j], :, j, :] if self.parent[j] >= 0 else np.repeat(one[:, j, None, :], 3, axis=1)
            self.log[:, j] = np.log(joint / joint.sum(axis=2, keepdims=True))
        self.accuracy = one

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        k = votes.shape[1]
        above = votes[:, np.where(self.parent < 0, np.arange(k), self.parent)] + 1
        of = self.log[:, np.arange(k), above, votes + 1].sum(axis=2)  # class, row
        s = self.odds + of[1] - of[0]
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def fit(texts: pa.Array, toxic: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(term hashes, weights, bias) of the linear classifier."""
    seeds = np.unique(hashed_words(INSULTS))
    if not len(toxic):
        return seeds, np.full(len(seeds), 2.0), -2.0
    n = len(toxic)
    doc, term, at, kind = all_terms(texts)
    words = np.bincount(doc[kind == 0], minlength=n)
    uniq, code = np.unique(term, return_inverse=True)
    pair = np.unique(code.astype(np.int64) * n + doc)
    in_rows = np.bincount(pair // n, minlength=len(uniq))
    in_toxic = np.bincount((pair // n)[toxic[pair % n] == 1], minlength=len(uniq))
    share = (in_toxic + 0.1) / (in_rows + 0.2)
    mined = uniq[(in_rows >= LEAST_ROWS) & (share >= LEAST_SHARE)]
    votes = voters(n, doc, term, at, mined, words)
    model = LabelModel(votes, np.where(toxic == 1, 0.9, 0.1))
    target = model.posterior(votes)

    # the terms whose frequency differs most between the posteriors' classes
    t_rows = np.bincount(pair // n, weights=target[pair % n], minlength=len(uniq))
    base = float(np.clip(target.mean(), 1e-4, 1))
    z = (t_rows - in_rows * base) / np.sqrt(in_rows * base * (1 - base) + 1)
    able = np.flatnonzero(in_rows >= 3)
    able = able[np.argsort(-np.abs(z[able]), kind="stable")][:FEATURES]
    able = able[np.abs(z[able]) > 2]
    place = np.full(len(uniq), -1)
    place[able] = np.arange(len(able))
    used = place[code] >= 0
    key, count = np.unique(doc[used] * max(len(able), 1) + place[code[used]], return_counts=True)
    rows, cols = key // max(len(able), 1), key % max(len(able), 1)
    x = np.minimum(count, 3).astype(float)
    weight, bias = np.zeros(len(able)), float(np.log(base / (1 - base)))
    size = np.bincount(cols, weights=x * x, minlength=len(able)) + 1.0
    m = np.zeros(len(able))
    for _ in range(steps):  # gradient steps scaled by each term's weight in the data
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=x * weight[cols], minlength=n) + bias, -30, 30)))
        g = np.bincount(cols, weights=x * (p - target)[rows], minlength=len(able)) + 0.02 * weight
        m = 0.8 * m + g / size
        weight -= 0.6 * m
        bias -= 0.5 * float((p - target).mean())
    return uniq[able], weight, bias


def lookup(terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots that have a term, for a quick no; the terms, sorted; their weights."""
    order = np.argsort(terms)
    slots = np.zeros(TABLE, bool)
    slots[(terms & np.uint64(TABLE - 1)).astype(np.int64)] = True
    return slots, terms[order], weights[order]


FIT_SCHEMA = "terms array<long>, weights array<double>, bias double"


def fitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    all_rows = list(batches)
    texts = pa.concat_arrays([b.column("text").cast(pa.large_string()) for b in all_rows]) if all_rows else pa.array([], pa.large_string())
    toxic = np.concatenate([b.column("toxic").to_numpy() for b in all_rows]) if all_rows else np.zeros(0, np.int64)
    terms, weights, bias = fit(texts, toxic)
    yield pa.RecordBatch.from_arrays([pa.array([terms.view(np.int64).tolist()], pa.list_(pa.int64())), pa.array([weights.tolist()], pa.list_(pa.float64())), pa.array([bias])], names=["terms", "weights", "bias"])


def learn(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> tuple[np.ndarray, np.ndarray, float]:
    """The classifier, from at most max_fit labelled rows that are not held out."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("toxic")).where("doc_id is not null and toxic is not null")
    ids = ids.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    rows = rows.repartition(1).sortWithinPartitions("doc_id", "text").select("text", "toxic")
    r = rows.mapInArrow(fitter, FIT_SCHEMA).collect()
    if not r:
        return fit(pa.array([], pa.large_string()), np.zeros(0, np.int64))
    return np.array(r[0].terms, np.int64).view(np.uint64), np.array(r[0].weights, float), r[0].bias


def scorer(terms: np.ndarray, weights: np.ndarray, bias: float):
    """doc_id and score of each text; a term counts three times at most, as in the fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, keys, vals = lookup(terms, weights)

        def met(w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
            """(doc, place in keys) of every known term."""
            docs, places = [], []
            for d, h in term_hashes(w):
                ok = np.flatnonzero(slots[(h & np.uint64(TABLE - 1)).astype(np.int64)])
                place = np.searchsorted(keys, h[ok])
                same = keys[np.minimum(place, len(keys) - 1)] == h[ok] if len(ok) else np.zeros(0, bool)
                docs.append(d[ok[same]])
                places.append(place[same])
            return np.concatenate(docs), np.concatenate(places)

        for b in batches:
            for i, j, data, off in tk.chunks(b.column("text")):
                if j - i == 1 and len(data) > tk.CHUNK_BYTES:
                    times = np.zeros(len(keys), np.int64)
                    for _, w in tk.long_text(data, tk.NO_LETTER, True):
                        times += np.bincount(met(w)[1], minlength=len(keys))
                    s = np.array([(vals * np.minimum(times, 3)).sum()])
                else:
                    key, n = np.unique(np.stack(met(tk.Words(data, off, tk.NO_LETTER, lower=True))), axis=1, return_counts=True)
                    s = np.bincount(key[0], weights=vals[key[1]] * np.minimum(n, 3), minlength=j - i) if len(n) else np.zeros(j - i)
                p = 1 / (1 + np.exp(-np.clip(s + bias, -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(p)], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of docs."""
    model = learn(docs, labels, max_fit)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(scorer(*model), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
