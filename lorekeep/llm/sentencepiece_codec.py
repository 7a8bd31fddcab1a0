"""SentencePiece encoding and decoding by streaming Viterbi.

A stretch of text is walked once, left to right. For the last `longest piece` characters only, the
walk keeps the best way to reach each position: a back-pointer to the piece that ends there. When
the back-pointer paths of all positions in that window run through one common boundary, the ids
before it can no longer change: they are committed and forgotten. Memory is bounded by the window
plus the stretch on which paths still differ, never by the text.

`walk_lanes` does this for many stretches at once with arrays (a lane a stretch, one step a
character for all lanes); `walk` does it for one stretch of any length, character by character.

Two kinds of models are read from the same file format. A unigram model scores a path by the sum
of its pieces' scores. A BPE model has no such sum: a plain best-sum path gives other ids than the
merges do. There the path into a position is the one whose last piece is stable by itself and
stable next to the piece before it (merging the two pieces' characters gives back just these two).
A sequence is the merges' result if and only if all its neighbours are stable, as the first merge
across a boundary would already happen between its two neighbours alone; so each position has one
such path, and the ids equal those of the reference library exactly.

If no piece holds a word mark after another character, all paths converge before each such mark,
whatever follows, so a stretch ends there (a word with its marks). Equal stretches of a block are
walked once; nothing is remembered from one block to the next but a table of fixed size of pairs
of pieces, and nothing at all when a task ends.

Text is taken as the model says: a word mark for each blank, one in front (dummy prefix); a
character without a piece becomes its UTF-8 byte pieces, or the unknown id. Models that rewrite
characters or remove blanks are refused. Defined results: null and empty texts have no ids, a null
doc_id stays null; rows are independent, so repeats and ties need no rule; extra columns are
ignored; an empty table gives an empty result. Texts of any length are handled whole: a text over
a block is walked block by block, cut where all paths converge.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import tokens as tk

MARK = "▁"
BLANK = 0x20
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Bytes of text in a block, characters of distinct stretches that are walked side by side.
BLOCK_BYTES, LANE_CHARS = 2 << 20, 1 << 17
#: Stretches longer than this are walked side by side only if so many others are as long.
LONG, LANES = 256, 64
#: Slots of the table of neighbours whose stability is known, in each task (9 bytes each).
PAIRS = 1 << 18
START = -2


class Lookup:
    """An exact map from numbers to numbers by open addressing, asked for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * max(len(keys), 1)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] < 0
            _, first = np.unique(slot[left][free], return_index=True)
            put = left[free][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + (self.keys[slot[left]] != keys[left])) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for unknown keys."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(-1))
        on = np.flatnonzero((held != keys) & (held >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) & self.mask
            held = self.keys[slot[on]]
            out[on] = np.where(held == keys[on], self.values[slot[on]], np.int32(-1))
            on = on[(held != keys[on]) & (held >= 0)]
        return out


class Codec:
    """A model and its tables; symbols are piece ids, then (from `n`) characters without a piece of their own."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only models with identity normalisation are supported")
        if trainer.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if any(p.type == USER for p in proto.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        self.bpe = trainer.model_type == BPE
        self.prefix = norm.add_dummy_prefix
        self.text = [p.piece.replace(MARK, " ") for p in proto.pieces]
        self.type = [p.type for p in proto.pieces]
        self.score = np.array([p.score for p in proto.pieces])
        self.n = len(self.text)
        self.unknown = self.type.index(UNKNOWN)
        self.longest = max(map(len, self.ids))
        self.unknown_score = float(min(self.score[i] for i in self.ids.values())) - 10.0
        self.cuts_at_marks = not any(" " in p.lstrip(" ") for p in self.ids)
        self.alphabet = sorted({c for p in self.ids for c in p})
        self._build_trie()
        if self.bpe:
            self._build_merges()

    # -- what follows from the pieces, made anew in each process that asks for it ------------------
    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, (p, t) in enumerate(zip(self.text, self.type, strict=True)) if t == NORMAL}

    @cached_property
    def byte_id(self) -> dict[int, int]:
        return {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.text, self.type, strict=True)) if t == BYTE}

    @cached_property
    def tails(self) -> set[str]:
        return {p[-n:] for p in self.ids for n in range(1, len(p) + 1)}

    @cached_property
    def class_of(self) -> np.ndarray:
        """Of each code point its place in the alphabet, from 1; 0 for all that occur in no piece."""
        table = np.zeros(0x110000, np.uint16 if len(self.alphabet) < 65535 else np.int32)
        table[[ord(c) for c in self.alphabet]] = np.arange(1, len(self.alphabet) + 1)
        return table

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("ids", "byte_id", "tails", "class_of", "known_pair", "known_ok")}

    # -- tables ------------------------------------------------------------------------------------
    def symbol(self, s: str) -> int:
        return self.ids.get(s, self.n + self.classes.get(s, 0))

    @cached_property
    def classes(self) -> dict[str, int]:
        return {c: k for k, c in enumerate(self.alphabet, 1)}

    def _build_trie(self) -> None:
        """Nodes are beginnings of pieces; `of_node` has a node's symbol, -1 if no path may use it."""
        nodes, edges = {"": 0}, []
        width = len(self.alphabet) + 1
        for p in self.ids:
            at = 0
            for n in range(1, len(p) + 1):
                to = nodes.get(p[:n])
                if to is None:
                    to = nodes[p[:n]] = len(nodes)
                    edges.append((at * width + self.classes[p[n - 1]], to))
                at = to
        self.width = width
        self.trie = Lookup(np.array([k for k, _ in edges]), np.array([v for _, v in edges]))
        self.of_node = np.array([-1 if len(s) != 1 and s not in self.ids else self.symbol(s) for s in nodes], np.int32)

    def _build_merges(self) -> None:
        """For every piece the two parts of its last merge, whether it is stable, and whether scores only fall on the way."""
        size = self.n + self.width
        self.left, self.right = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        stable, falling = np.ones(size, bool), np.ones(size, bool)
        joins = []
        for p, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            parts = [(p[:n], p[n:]) for n in range(1, len(p))]
            joins += [(self.symbol(a) * size + self.symbol(b), i) for a, b in parts if (a in self.ids or len(a) == 1) and (b in self.ids or len(b) == 1)]
            if len(p) == 1:
                continue
            steps = self.merged(p, steps=True)
            if len(steps[-1]) > 1:
                stable[i] = False
                continue
            self.left[i], self.right[i] = (self.symbol(x) for x in steps[-2])
            own = [self.score[x] if x < self.n else np.inf for x in (self.left[i], self.right[i]) if self.left[x] >= 0]
            falling[i] = all(falling[x] for x in (self.left[i], self.right[i])) and self.score[i] <= min(own, default=np.inf)
        self.falling = falling
        self.joins = Lookup(np.array([k for k, _ in joins]), np.array([v for _, v in joins]))
        usable = (self.of_node >= 0) & stable[np.maximum(self.of_node, 0)]
        self.of_node = np.where(usable, self.of_node, -1).astype(np.int32)

    # -- stability of BPE pieces -------------------------------------------------------------------
    def merged(self, s: str, steps: bool = False) -> list:
        """The merges' result on a short string: best score first, leftmost among equals; or all states on the way."""
        parts, states = list(s), []
        while True:
            states.append(parts)
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if at < 0:
                return states if steps else parts
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]

    def of_symbol(self, k: int) -> str:
        return self.text[k] if k < self.n else self.alphabet[k - self.n - 1]

    def stable_pairs(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether merging the characters of stable pieces p and q gives back just p and q.

        From the end of the merges backwards: the last merge of either is undone, and the piece that
        then lies across the boundary must not have been the better choice. Where a later merge
        scores better than an earlier one, the merges themselves are done.
        """
        out = np.ones(len(p), bool)
        size = self.n + self.width
        plain = self.falling[p] & self.falling[q]
        for i in np.flatnonzero(~plain):
            a, b = self.of_symbol(p[i]), self.of_symbol(q[i])
            out[i] = self.merged(a + b) == [a, b]
        on = np.flatnonzero(plain)
        u, v = p[on].astype(np.int64), q[on].astype(np.int64)
        limit, leftmost = np.full(len(on), -np.inf), np.zeros(len(on), bool)
        score = np.append(self.score, np.full(self.width, np.inf))
        while len(on):
            x = self.joins.get(u * size + v)
            s = np.where(x >= 0, self.score[x], -np.inf)
            bad = (x >= 0) & ((s > limit) | leftmost & (s == limit))
            out[on[bad]] = False
            cut_u, cut_v = self.left[u] >= 0, self.left[v] >= 0
            go = ~bad & (cut_u | cut_v)
            on, u, v, cut_u, cut_v = on[go], u[go], v[go], cut_u[go], cut_v[go]
            # of the two last merges the one of lower score came later; of equal ones the right one
            undo_v = cut_v & (~cut_u | (score[v] <= score[u]))
            limit, leftmost = np.where(undo_v, score[v], score[u]), undo_v
            u, v = np.where(undo_v, u, self.right[u]), np.where(undo_v, self.left[v], v)
        return out

    def beside(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """stable_pairs, with the answers kept in a table of fixed size; a text's start or a strange character suits all."""
        if "known_pair" not in self.__dict__:
            self.known_pair, self.known_ok = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        key = (p.astype(np.int64) << 32) | q
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (PAIRS - 1)
        any_way = (p == START) | (p == self.n) | (q == self.n)
        ok = any_way | self.known_ok[slot]
        new = np.flatnonzero(~any_way & (self.known_pair[slot] != key))
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            found = self.stable_pairs((fresh >> 32).astype(np.int64), (fresh & 0xFFFFFFFF).astype(np.int64))
            ok[new] = found[back]
            self.known_pair[slot[new]], self.known_ok[slot[new]] = key[new], ok[new]
        return ok

    # -- the streaming walk of one stretch ---------------------------------------------------------
    def walk(self, chars: Iterator[str] | str) -> Iterator[int]:
        """Ids of normalised characters (marks are blanks), committed as early as all paths agree."""
        size = self.longest
        window = ""  # the last `size` characters
        back: dict[int, tuple[int, str, float]] = {0: (-1, "", 0.0)}  # position -> (from, piece, score)
        base = end = 0  # everything before base is committed
        sure: dict[tuple[str, str], bool] = {}
        for c in chars:
            window = (window + c)[-size:]
            end += 1
            best = None
            for n in range(1, len(window) + 1):
                p = window[-n:]
                if n > 1 and p not in self.tails:
                    break  # no longer piece ends like this either
                known, start = p in self.ids, end - n
                if start not in back or not known and n > 1:
                    continue
                if self.bpe:
                    pair = (back[start][1], p)
                    if pair not in sure:
                        if len(sure) > 20_000:
                            sure.clear()
                        sure[pair] = self.merged(p) == [p] and (start == 0 or self.merged(pair[0] + p) == list(pair))
                    if sure[pair]:
                        best = (start, p, 0.0)
                        break
                else:
                    s = back[start][2] + (float(self.score[self.ids[p]]) if known else self.unknown_score)
                    if best is None or s > best[2]:
                        best = (start, p, s)
            back[end] = best
            if len(back) > 4 * size:
                base = yield from self._commit(back, base, end)
        yield from self._emit(back, base, end)

    def _commit(self, back: dict, base: int, end: int) -> Iterator[int]:
        """Emit what all paths into the last window share; return the boundary reached."""
        meet = set(range(max(base, end - self.longest + 1), end + 1)) & back.keys()
        while len(meet) > 1:  # step back from the rightmost until one boundary is left
            top = max(meet)
            meet.discard(top)
            meet.add(back[top][0])
        at = meet.pop()
        if at > base:
            yield from self._emit(back, base, at)
            for i in range(base, at):
                back.pop(i, None)
        return max(at, base)

    def _emit(self, back: dict, base: int, at: int) -> Iterator[int]:
        path = []
        while at > base:
            at, p, _ = back[at]
            path.append(p)
        for p in reversed(path):
            k = self.ids.get(p)
            yield from (k,) if k is not None else self.ids_of_char(ord(p))

    def ids_of_char(self, cp: int) -> list[int]:
        """A character without a piece; a byte that is no UTF-8 comes as the surrogate that stands for it."""
        if not self.byte_id:
            return [self.unknown]
        raw = bytes([cp - 0xDC00]) if 0xDC80 <= cp <= 0xDCFF else chr(cp).encode("utf-8", "surrogatepass")
        return [self.byte_id[b] for b in raw]

    # -- the streaming walk of many stretches ------------------------------------------------------
    def _matches(self, cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """[length - 1, start]: the symbol of these characters, -1 if none; ends: of each start its lane's end."""
        cls = self.class_of[cps].astype(np.int64)
        found = np.full((self.longest, len(cps)), -1, np.int32)
        at, state = np.arange(len(cps)), np.zeros(len(cps), np.int64)
        for n in range(self.longest):
            if n:
                room = ends[at] - at > n
                at, state = at[room], state[room]
            to = self.trie.get(state * self.width + cls[at + n])
            if n == 0:
                found[0] = self.n + cls
            ok = to >= 0
            at, state = at[ok], to[ok].astype(np.int64)
            found[n, at] = np.where(self.of_node[state] >= 0, self.of_node[state], found[n, at])
            if not len(at):
                break
        return found

    def walk_lanes(self, cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lane, start, symbol) of the pieces of each lane cps[off[i]:off[i + 1]], in order.

        One step a character for all lanes that are so long. The rows of `last`, `size` and `score`
        are the window: positions from `low` on; committed ones make way when the window is full.
        """
        length = np.diff(off)
        order = np.argsort(-length, kind="stable")
        first, length = off[:-1][order], length[order]
        found = self._matches(cps, np.repeat(off[1:], np.diff(off)))
        longest, m = self.longest, len(order)
        active = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), side="right")
        rows = 4 * longest
        last, size = np.full((rows + 1, m), START, np.int32), np.zeros((rows + 1, m), np.int32)
        score = None if self.bpe else np.zeros((rows + 1, m))
        piece_score = None if self.bpe else np.append(self.score, np.full(self.width, self.unknown_score))
        base, low, done = np.zeros(m, np.int64), 0, []

        def emit(lanes: np.ndarray, to: np.ndarray) -> None:
            """Commit the paths of these lanes back from `to` to their bases."""
            who, at = lanes, to.copy()
            on = at > base[who]
            while on.any():
                who, at = who[on], at[on]
                done.append((who, at - size[at - low, who], last[at - low, who]))
                at = at - size[at - low, who]
                on = at > base[who]
            base[lanes] = to

        for e in range(1, len(active) + 1):
            n_act = int(active[e - 1])
            if e - low > rows:  # commit, then move the window on
                who = np.arange(n_act)
                alive = np.zeros((n_act, rows + 1), bool)
                alive[:, max(0, e - longest - low) : e - low] = True
                on = who
                while len(on):  # step back from the rightmost until one boundary is left
                    on = on[alive[on].sum(1) > 1]
                    top = rows - np.argmax(alive[on, ::-1], axis=1)
                    alive[on, top] = False
                    alive[on, top - size[top, on]] = True
                emit(who, np.maximum(base[:n_act], np.argmax(alive, axis=1) + low))
                ended = np.arange(n_act, m)
                emit(ended, np.maximum(length[ended], base[ended]))
                keep = int(min(base[:n_act].min(), e - longest))
                if keep == low:  # some lane's paths still differ: a wider window
                    last, size = (np.vstack([x, np.zeros((rows, m), x.dtype)]) for x in (last, size))
                    score = score if score is None else np.vstack([score, np.zeros((rows, m))])
                    rows *= 2
                else:
                    for x in (last, size) if score is None else (last, size, score):
                        x[: e - keep] = x[keep - low : e - low].copy()
                    low = keep
            todo, row = np.arange(n_act), e - low
            best = None if self.bpe else np.full(n_act, -np.inf)
            for n in range(min(e, longest), 0, -1) if self.bpe else range(1, min(e, longest) + 1):
                c = found[n - 1][first[todo] + (e - n)]
                h = np.flatnonzero(c >= 0)
                if not len(h):
                    continue
                t, c = todo[h], c[h]
                if self.bpe:  # the longest piece that is stable beside the one before it
                    ok = self.beside(last[row - n, t], c)
                    last[row, t[ok]], size[row, t[ok]] = c[ok], n
                    left = np.ones(len(todo), bool)
                    left[h[ok]] = False
                    todo = todo[left]
                    if not len(todo):
                        break
                else:
                    s = score[row - n, t] + piece_score[c]
                    t, c, s = (x[s > best[t]] for x in (t, c, s))
                    best[t], last[row, t], size[row, t] = s, c, n
            if score is not None:
                score[row, :n_act] = best
        emit(np.arange(m), np.maximum(length, base))
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        who, start, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        start = start + first[who]
        place = np.argsort(start)
        return order[who[place]], start[place], sym[place]

    def _ids(self, cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each lane has) of lanes of any number and lengths."""
        length = np.diff(off)
        some = np.partition(length, len(length) - LANES)[len(length) - LANES] if len(length) > LANES else 0
        alone = length > max(LONG, some)
        ids, count, lane_of = [], np.zeros(len(length), np.int64), []
        for i in np.flatnonzero(alone):
            one = np.fromiter(self.walk(map(chr, cps[off[i] : off[i + 1]].tolist())), np.int32)
            ids.append(one)
            lane_of.append(np.full(len(one), i))
        together = np.flatnonzero(~alone)
        share = np.cumsum(length[together]) // LANE_CHARS
        for g in np.split(together, np.flatnonzero(np.diff(share)) + 1) if len(together) else []:
            inner = np.r_[0, np.cumsum(length[g])]
            part = cps[np.repeat(off[g] - inner[:-1], length[g]) + np.arange(inner[-1])]
            lane, start, sym = self.walk_lanes(part, inner)
            strange = np.flatnonzero(sym >= self.n)
            if len(strange):
                spelt = [self.ids_of_char(int(c)) for c in part[start[strange]]]
                times = np.ones(len(sym), np.int64)
                times[strange] = [len(x) for x in spelt]
                sym, lane = np.repeat(sym, times), np.repeat(lane, times)
                sym[sym >= self.n] = [x for s in spelt for x in s]
            ids.append(sym)
            lane_of.append(g[lane])
        if not ids:
            return np.zeros(0, np.int32), count
        flat, lane = np.concatenate(ids), np.concatenate(lane_of)
        count = np.bincount(lane, minlength=len(length))
        return flat[np.argsort(lane, kind="stable")], count

    # -- whole texts -------------------------------------------------------------------------------
    def encode_rows(self, cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of rows of normalised code points: their distinct stretches are walked."""
        if not len(cps):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        opens = np.zeros(len(cps), bool)
        if self.cuts_at_marks:
            opens[1:] = (cps[1:] == BLANK) & (cps[:-1] != BLANK)
        opens[off[:-1][off[:-1] < off[1:]]] = True
        start = np.flatnonzero(opens)
        at = np.r_[start, len(cps)].astype(np.int64)
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at * 4), pa.py_buffer(np.ascontiguousarray(cps))])
        coded = every.dictionary_encode()
        which = coded.indices.to_numpy()
        once = coded.dictionary
        lanes = np.frombuffer(once.buffers()[1], np.int64, len(once) + 1, once.offset * 8) // 4
        ids, count = self._ids(np.frombuffer(once.buffers()[2], np.uint32), lanes)
        begin = np.cumsum(count) - count
        n = count[which]
        total = np.cumsum(n)
        out = ids[np.repeat(begin[which] - (total - n), n) + np.arange(total[-1])]
        per_stretch = np.r_[0, total]
        return out, per_stretch[np.searchsorted(start, off)]

    def normal(self, data: np.ndarray, off: np.ndarray, prefix: bool) -> tuple[np.ndarray, np.ndarray]:
        """(code points, offsets) of UTF-8 rows: blanks for marks, one in front of each row that has text."""
        raw = data.tobytes()
        try:
            flat = raw.decode()
            begins = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][off]
        except UnicodeDecodeError:
            rows = [raw[off[i] : off[i + 1]].decode("utf-8", "surrogateescape") for i in range(len(off) - 1)]
            flat, begins = "".join(rows), np.r_[0, np.cumsum([len(r) for r in rows])]
        cps = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        cps[cps == ord(MARK)] = BLANK
        if prefix:
            some = begins[:-1] < begins[1:]
            cps = np.insert(cps, begins[:-1][some], BLANK)
            begins = begins + np.r_[0, np.cumsum(some)]
        return cps, begins

    def parts(self, raw: bytes, size: int) -> Iterator[bytes]:
        """A text in parts of about `size` bytes, cut before marks that follow another character."""
        at = 0
        while at < len(raw):
            cut = at + size
            while cut < len(raw):
                cut = raw.find(b" ", cut) if self.cuts_at_marks else -1
                if cut < 0:
                    break
                if raw[cut - 1] != BLANK and raw[cut - 3 : cut] != MARK.encode():
                    break
                cut += 1
            cut = len(raw) if cut < 0 else min(cut, len(raw))
            yield raw[at:cut]
            at = cut

    def encode_many(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, offsets) for runs of rows of about a block; null has no ids."""
        for i, j, data, off in tk.chunks(texts, BLOCK_BYTES):
            if len(data) <= 2 * BLOCK_BYTES:
                yield i, j, *self.encode_rows(*self.normal(data, off, self.prefix))
                continue
            done = []
            for k, part in enumerate(self.parts(data.tobytes(), BLOCK_BYTES)):
                part = np.frombuffer(part, np.uint8)
                done.append(self.encode_rows(*self.normal(part, np.array([0, len(part)]), self.prefix and k == 0))[0])
            ids = np.concatenate(done)
            yield i, j, ids, np.array([0, len(ids)])

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_many(pa.array([text], pa.string())))[2].tolist()

    def piece_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all pieces in a row, offsets); a mark is a blank, control pieces are empty."""
        raw = []
        for p, t in zip(self.text, self.type, strict=True):
            raw.append(bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.encode())
        return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])]

    def decode(self, ids: list[int]) -> bytes:
        flat, _ = decode_many(self.piece_bytes(), np.asarray(ids, np.int64), np.array([0, len(ids)]), self.prefix)
        return flat.tobytes()


def decode_many(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray, off: np.ndarray, prefix: bool) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of several id lists at once; the dummy prefix's blank is removed."""
    data, at = table
    start, size = at[ids], at[ids + 1] - at[ids]
    if prefix:
        firsts = off[:-1][off[:-1] < off[1:]]
        blank = (size[firsts] > 0) & (data[np.minimum(start[firsts], len(data) - 1)] == 32)
        start[firsts] += blank
        size[firsts] -= blank
    ends = np.r_[0, np.cumsum(size)]
    index = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
    return data[index], ends[off]


def encoder(codec: Codec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, ids, off in codec.encode_many(batch.column("text")):
                out = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(off), pa.int64()), out], names=["doc_id", "n_ids", "ids"])

    return run


def decoder(codec: Codec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec.piece_bytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                col = part.column("ids")
                off = col.offsets.to_numpy()
                flat, ends = decode_many(table, col.flatten().to_numpy().astype(np.int64), off - off[0], codec.prefix)
                text = pa.Array.from_buffers(pa.large_binary(), len(col), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), text.cast(pa.binary())], names=["doc_id", "decoded"])

    return run


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_ids, ids; one row per row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(encoder(Codec(model)), "doc_id long, n_ids long, ids array<int>")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id and the text that the ids stand for; null ids give an empty text."""
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(decoder(Codec(model)), "doc_id long, decoded binary")
    return rows.select("doc_id", F.col("decoded").cast("string").alias("text"))


def round_trip(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_ids, ids, exact: whether decoding the ids gives back the text's bytes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    codec = Codec(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec.piece_bytes()
        for batch in batches:
            for i, j, ids, off in codec.encode_many(batch.column("text")):
                flat, ends = decode_many(table, ids.astype(np.int64), off, codec.prefix)
                got = flat.tobytes()
                texts = batch.column("text").slice(i, j - i).cast(pa.large_binary()).fill_null(b"")
                exact = [got[ends[k] : ends[k + 1]] == t for k, t in enumerate(texts.to_pylist())]
                out = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(off), pa.int64()), out, pa.array(exact)], names=["doc_id", "n_ids", "ids", "exact"])

    return docs.mapInArrow(run, "doc_id long, n_ids long, ids array<int>, exact boolean")


def read_model(path: str) -> bytes:
    """The model file (half a megabyte), read by the driver and sent along with the tasks."""
    with open(path, "rb") as f:
        return f.read()
