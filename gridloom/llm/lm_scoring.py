"""Language-model scoring: a gated recurrent network in numpy with a class-factored softmax.

Tokens are words (A-Z lower-cased, between blanks) and an end for each text. Counts over all training texts come from
one shuffle with map-side sums. The VOCAB most frequent words are tokens of their own; any other is the token `rare`
times its share of the rare words' counts, so the probabilities of all words, unseen ones included, sum to one. Words
fall into classes by the roots of their masses, so a token costs a short softmax over the classes and one over its class.

Training: every token of every training text is learned, each text from its start in windows of WINDOW tokens by
truncated backpropagation, the state carried from window to window. Texts are dealt to replicas by a hash of id and text
and put in order by it, and a replica trains on one group of GROUP_TOKENS after the other, so the result depends neither
on the input's partitions nor on the size of Arrow batches; replicas are averaged, FAN_IN at a time, ROUNDS times. Only
counts of KNOWN words at most and averaged weights, both of fixed size, reach the driver. Scoring runs whole texts in
windows with the state carried, many texts side by side.

Counts of words that aren't among the KNOWN most frequent join by a shuffle; no word is left out. Words are told apart
by 64-bit hashes: among v distinct words two coincide with about v * v chances in 2^65, 3e-6 for ten million.

Defined cases: null and empty texts are one end token; a null doc_id is held out; rows equal in id and text get the
same scores; a corpus without training texts gives every text the uniform base and an untrained model; an empty table
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key, tidy

VOCAB = 4096
KNOWN = 1 << 18
CLASSES = 64
#: Most tokens that may be a class each before the others are divided.
ALONE = 16
#: Handling a token in its class costs about as much as so many logits.
OWN_LOGITS = 24
HIDDEN = 16
WINDOW = 32
LANES = 256
#: Lanes whose mean gradient a step has the size of, whatever LANES is.
RATE_LANES = 64
SCORE_LANES = 1024
#: Rows of an Arrow batch: many texts side by side make full lanes.
WIDE = 10_000
ROUNDS = 2
#: Tokens that a replica trains on in a round; more tokens are more replicas, so no task grows with the corpus.
REPLICA_TOKENS = 4_000_000
#: Tokens of the texts that a replica trains on side by side: more than nearly all replicas have, as a small last group leaves lanes empty.
GROUP_TOKENS = 4 * REPLICA_TOKENS
FAN_IN = 16
RATE = 0.1
ADD = 0.1
END, RARE = 0, 1
#: Bits of a hash by which it is looked up.
BEGIN = 20


def price(cls: np.ndarray, mass: np.ndarray) -> float:
    """What a token costs on average, in logits: one for each class, and in a class of several tokens theirs and OWN_LOGITS more."""
    size = np.bincount(cls)
    return len(size) + (np.bincount(cls, mass) * (size + OWN_LOGITS))[size > 1].sum() / mass.sum()


def classes(mass: np.ndarray) -> np.ndarray:
    """The class of each token (by frequency): the first ones stand alone, then come stretches with equal sums of the roots of their masses, for which the logits of a token are fewest. Of all such divisions into CLASSES classes at most, the one with the least price."""
    roots, found = np.sqrt(mass), []
    for alone in range(min(ALONE, len(mass) - 1) + 1):
        share = np.cumsum(roots[alone:])
        share /= share[-1]
        for n in range(1, CLASSES - alone + 1):
            cls = np.minimum((share * n).astype(np.int64), n - 1)
            _, cls = np.unique(cls, return_inverse=True)  # contiguous
            found.append(np.r_[np.arange(alone), alone + cls])
    return min(found, key=lambda cls: price(cls, mass))


class Vocabulary:
    """The KNOWN most frequent words (by hash, sorted) with their counts and token numbers, and the totals."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n: int, v: int, texts: int):
        order = np.lexsort((hashes, -counts))
        number = np.full(len(hashes), RARE, np.int32)
        number[order[:VOCAB]] = np.arange(2, 2 + min(VOCAB, len(order)))
        at = np.argsort(hashes)
        self.hashes, self.counts, self.number = hashes[at], counts[at].astype(np.float64), number[at]
        self.n, self.v, self.texts = n, v, texts
        top = counts[order[:VOCAB]].astype(np.float64)
        self.rare_n, self.rare_v = n - texts - top.sum(), max(0, v - (texts > 0) - len(top))
        mass = np.r_[texts + ADD, self.rare_n + ADD * (self.rare_v + 1), top + ADD]
        self.log_rare = np.log10(self.rare_n + ADD * (self.rare_v + 1))
        self.log_all = np.log10(n + ADD * (v + 1))
        self.cls, self.mass = classes(mass), mass

        # where the hashes of each beginning stand
        self.first = np.searchsorted(self.hashes, np.arange(1 << BEGIN, dtype=np.uint64) << np.uint64(64 - BEGIN))
        self.first = np.r_[self.first, len(self.hashes)].astype(np.int32)

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers and counts (-1: not among the known) of word hashes."""
        number, count = np.full(len(h), RARE, np.int32), np.full(len(h), -1.0)
        begin = (h >> np.uint64(64 - BEGIN)).astype(np.int32)
        at, end = self.first[begin], self.first[begin + 1]
        left = np.flatnonzero(at < end)
        at, end, h = at[left], end[left], h[left]
        while len(left):  # a few hashes at most have one beginning
            found = self.hashes[at] == h
            number[left[found]], count[left[found]] = self.number[at[found]], self.counts[at[found]]
            at = at + 1
            on = ~found & (at < end)
            left, at, end, h = left[on], at[on], end[on], h[on]
        return number, count


def packed(sizes: list[int], lanes: int) -> list[list[int]]:
    """The numbers of texts dealt to `lanes` lanes at most, the longest first to the lane that is least full; lanes by length."""
    heap = [(0, n) for n in range(min(lanes, len(sizes)))]
    out: list[list[int]] = [[] for _ in heap]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        full, n = heappop(heap)
        out[n].append(i)
        heappush(heap, (full + sizes[i], n))
    return sorted(out, key=lambda lane: sum(sizes[i] for i in lane))


def by_number(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, the most frequent first, and the sums of their rows: numbers that come often one by one, the others' second, third, ... rows together."""
    order = np.argsort(at.astype(np.uint16) if VOCAB < 60_000 else at, kind="stable")
    at = at[order]
    edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    n = np.diff(np.r_[edge, len(at)])
    most = np.argsort(-n, kind="stable")  # those that have an r-th row are the first ones
    edge, n = edge[most], n[most]
    out = rows[order[edge]]
    often = int((n > 16).sum())
    for k in range(often):
        out[k] = rows[order[edge[k] : edge[k] + n[k]]].sum(0)
    for r in range(1, 16):
        few = slice(often, int((n > r).sum()))
        if few.start == few.stop:
            break
        out[few] += rows[order[edge[few] + r]]
    return at[edge], out


class Lanes:
    """Texts one after the other in lanes side by side, by window; `first` stands before each text's first token."""

    def __init__(self, texts: list[np.ndarray], lanes: list[list[int]], first: int, numbered: bool = True):
        order = [i for lane in lanes for i in lane]
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        self.tokens = np.concatenate([texts[i] for i in order]) if order else np.zeros(0, np.int32)
        self.of = np.repeat(np.array(order, np.int64), sizes) if numbered else None
        self.begins = np.zeros(len(self.tokens) + 1, bool)
        self.begins[np.r_[0, np.cumsum(sizes)]] = True
        self.size = np.array([sum(len(texts[i]) for i in lane) for lane in lanes], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.longest, self.first = int(self.size.max(initial=0)), first

    def window(self, t: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """How many lanes more have ended since the window before, and, time by lane: the tokens (-1 past an end), those before them, whether a text begins, and its number."""
        done, before = (int(np.searchsorted(self.size, x, "right")) for x in (t, max(0, t - WINDOW)))
        steps = t + np.arange(min(WINDOW, self.longest - t))[:, None]
        on = steps < self.size[done:]
        at = np.where(on, self.start[done:] + steps, 0)
        fresh = self.begins[at] & on
        y = np.where(on, self.tokens[at], -1)
        given = np.where(fresh | ~on, self.first, self.tokens[at - 1])
        return done - (before if t else 0), y, given, fresh, None if self.of is None else self.of[at]


class Model:
    """A gated recurrent network over token numbers; its input table holds the gates' inputs of each token."""

    def __init__(self, cls: np.ndarray, mass: np.ndarray):
        rng = np.random.default_rng(11)
        size, n_cls = len(cls), int(cls.max()) + 1
        self.cls = cls
        self.edges = np.searchsorted(cls, np.arange(n_cls + 1))
        by_class = np.add.reduceat(mass, self.edges[:-1])
        f = np.float32
        self.p = {
            "x": (rng.standard_normal((size + 1, 3 * HIDDEN)) * 0.1).astype(f),  # the last row: before the first token
            "u": (rng.standard_normal((HIDDEN, 2 * HIDDEN)) * 0.2).astype(f),
            "n": (rng.standard_normal((HIDDEN, HIDDEN)) * 0.2).astype(f),
            "wc": np.zeros((n_cls, HIDDEN), f),
            "bc": np.log(by_class / mass.sum()).astype(f),
            "wo": np.zeros((size, HIDDEN), f),
            "bo": np.log(mass / by_class[cls]).astype(f),
        }
        self.sums = {k: np.full_like(v, 0.1) for k, v in self.p.items()}

    def step(self, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        p, H = self.p, HIDDEN
        zr = h @ -p["u"]
        zr -= g[:, : 2 * H]
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[:, :H], zr[:, H:]
        c = (r * h) @ p["n"]
        c += g[:, 2 * H :]
        np.tanh(c, out=c)
        after = h - c
        after *= z
        after += c
        return z, r, c, after

    @staticmethod
    def _soft(h: np.ndarray, w: np.ndarray, at: np.ndarray, high: bool) -> tuple[np.ndarray, ...]:
        """Logits at the numbers `at`, all shares' numerators and their sums, and where the numerators of `at` stand; h ends in ones, w in the biases, and high logits are made smaller."""
        e = h @ w.T
        if high:
            e -= e.max(1, keepdims=True)
        where = np.arange(0, e.size, len(w)) + at
        own = e.ravel()[where]
        np.exp(e, out=e)
        return own, e, e @ np.ones(len(w), np.float32), where

    def _heads(self) -> tuple[tuple[np.ndarray, bool], tuple[np.ndarray, bool]]:
        """Weights with their biases, of the classes and of the words, and whether logits may be high: no state is beyond -1 and 1."""
        both = np.c_[self.p["wc"], self.p["bc"]], np.c_[self.p["wo"], self.p["bo"]]
        return tuple((w, not np.abs(w).sum(1).max() <= 60) for w in both)

    def _by_class(self, cls: np.ndarray) -> Iterator[tuple[slice, int, int]]:
        """The rows of each class that has several tokens, from sorted class numbers, and these tokens' bounds."""
        bounds = np.searchsorted(cls, np.arange(len(self.edges)))
        for c in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(self.edges) > 1)):
            yield slice(bounds[c], bounds[c + 1]), self.edges[c], self.edges[c + 1]

    def _order(self, y: np.ndarray) -> np.ndarray:
        """In which order the tokens y are one stretch for each class."""
        return np.argsort(self.cls[y].astype(np.uint16), kind="stable")

    def log_prob(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural logs of the probabilities of tokens y after states h."""
        order = self._order(y)
        h, y = np.concatenate([h, np.ones((len(h), 1), np.float32)], 1)[order], y[order]
        cls = self.cls[y]
        (wc, high_c), (wo, high_o) = self._heads()
        own, _, total, _ = self._soft(h, wc, cls, high_c)
        got = own - np.log(total, dtype=np.float64)
        for rows, a, b in self._by_class(cls):
            own, _, total, _ = self._soft(h[rows], wo[a:b], y[rows] - a, high_o)
            got[rows] += own - np.log(total, dtype=np.float64)
        out = np.empty(len(y), np.float64)
        out[order] = got
        return out

    def gradients(self, h: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Gradients of minus the log probability of tokens y, one stretch for each class, after states h: of the states, and by table."""
        p = self.p
        grads = {k: np.zeros_like(p[k]) for k in ("wc", "bc", "wo", "bo")}
        ends = np.concatenate([h, np.ones((len(h), 1), np.float32)], 1)
        cls = self.cls[y]
        (wc, high_c), (wo, high_o) = self._heads()
        dh = self._back(h, p["wc"], *self._soft(ends, wc, cls, high_c)[1:], grads["wc"], grads["bc"])
        for rows, a, b in self._by_class(cls):
            soft = self._soft(ends[rows], wo[a:b], y[rows] - a, high_o)
            dh[rows] += self._back(h[rows], p["wo"][a:b], *soft[1:], grads["wo"][a:b], grads["bo"][a:b])
        return dh, grads

    @staticmethod
    def _back(h: np.ndarray, w: np.ndarray, e: np.ndarray, total: np.ndarray, where: np.ndarray, dw: np.ndarray, db: np.ndarray) -> np.ndarray:
        """Gradients of the states, and into dw and db those of the weights and biases, of numerators that aren't divided by their sums yet. The biases' are a product of their own: a 17th column slows a product down."""
        e.ravel()[where] -= total
        part = np.reciprocal(total)[:, None]
        np.matmul(e.T, h * part, out=dw)
        np.matmul(part[:, 0], e, out=db)
        dh = e @ w
        dh *= part
        return dh

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probabilities of token sequences: whole texts one after the other in lanes side by side, states carried from window to window, and new at each text."""
        out = np.zeros(len(texts))
        total = sum(map(len, texts))
        if not total:
            return out
        lanes = -(-total // max(max(map(len, texts)), total // SCORE_LANES))
        side = Lanes(texts, packed([len(t) for t in texts], lanes), len(self.cls))
        h = np.zeros((len(side.size), HIDDEN), np.float32)
        for t0 in range(0, side.longest, WINDOW):
            done, y, given, fresh, of = side.window(t0)
            h = h[done:]
            states = np.empty((*y.shape, HIDDEN), np.float32)
            g = self.p["x"][given]
            anew = fresh.any(1)
            for t in range(len(y)):
                if anew[t]:
                    h[fresh[t]] = 0
                states[t] = h = self.step(g[t], h)[3]
            on = y >= 0
            out += np.bincount(of[on], self.log_prob(states[on], y[on]), len(texts))
        return out / np.log(10)

    def train_window(self, y: np.ndarray, before: np.ndarray, h: np.ndarray, fresh: np.ndarray | None = None) -> np.ndarray:
        """One window of some lanes (y: time by lane, -1 past an end; fresh: where a text begins within a lane); returns the states after it."""
        p, H = self.p, HIDDEN
        T, B = y.shape
        given = np.concatenate([before[None], y[:-1]])
        if fresh is not None:
            given = np.where(fresh, len(self.cls), given)
        g = p["x"][given]
        starts, z, r, c, states = (np.empty((T, B, H), np.float32) for _ in range(5))
        anew = np.zeros(T, bool) if fresh is None else fresh.any(1)
        h = h.copy()
        for t in range(T):
            if anew[t]:
                h[fresh[t]] = 0
            starts[t] = h
            z[t], r[t], c[t], h = self.step(g[t], h)
            states[t] = h
        on = np.flatnonzero(y >= 0)
        on = on[self._order(y.ravel()[on])]
        dhs = np.zeros((T * B, H), np.float32)
        dhs[on], grads = self.gradients(states.reshape(T * B, H)[on], y.ravel()[on])
        dhs = dhs.reshape(T, B, H)
        dg = np.empty((T, B, 3 * H), np.float32)
        rh = r * starts
        inner_z, inner_c, inner_r = (starts - c) * z * (1 - z), (1 - z) * (1 - c * c), starts * r * (1 - r)
        dh = np.zeros((B, H), np.float32)
        nt, ut = np.ascontiguousarray(p["n"].T), np.ascontiguousarray(p["u"].T)
        for t in range(T - 1, -1, -1):  # past an end nothing comes back, so nothing need be masked
            d = dh + dhs[t]
            dg[t, :, :H] = d * inner_z[t]
            dg[t, :, 2 * H :] = dc = d * inner_c[t]
            drh = dc @ nt
            dg[t, :, H : 2 * H] = drh * inner_r[t]
            dh = d * z[t] + drh * r[t] + dg[t, :, : 2 * H] @ ut
            if anew[t]:
                dh[fresh[t]] = 0
        flat = dg.reshape(T * B, 3 * H)
        grads["u"] = starts.reshape(T * B, H).T @ flat[:, : 2 * H]
        grads["n"] = rh.reshape(T * B, H).T @ flat[:, 2 * H :]
        grads["x"] = by_number(np.where(given < 0, len(self.cls), given).ravel(), flat)
        scale = np.float32(RATE_LANES / max(1, len(on)))
        for name, g in grads.items():
            where, g = g if isinstance(g, tuple) else (slice(None), g)
            g = g * scale
            np.clip(g, -1, 1, out=g)
            sums = self.sums[name][where]
            sums += g * g
            self.sums[name][where] = sums
            g *= RATE
            g /= np.sqrt(sums)
            p[name][where] -= g
        return states[-1]

    def train(self, texts: list[np.ndarray]) -> None:
        """Every token once, each text from its start; texts stand one after the other in lanes of about equal length, in an order that their content scatters."""
        texts = sorted(texts, key=lambda t: zlib.crc32(t.tobytes()))
        side = Lanes(texts, [sorted(lane) for lane in packed([len(t) for t in texts], LANES)], len(self.cls), numbered=False)
        h = np.zeros((len(side.size), HIDDEN), np.float32)
        for t in range(0, side.longest, WINDOW):
            done, y, given, fresh, _ = side.window(t)
            # a lane that has ended goes out before its state is used
            h = self.train_window(y, given[0], h[done:], *((fresh,) if t and fresh.any() or fresh[1:].any() else ()))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    def load(self, blob: bytes) -> Model:
        with np.load(io.BytesIO(blob)) as z:
            self.p = {k: z[k] for k in z.files}
        return self


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By block: first row, hashes of all words, bounds of the texts in them."""
    from .kernels import blocks, word_hashes, word_spans

    for first, data, off in blocks(column):
        starts, ends, text = word_spans(data, off)
        yield first, word_hashes(data, starts, ends), np.searchsorted(text, np.arange(len(off)))


def counts(train: DataFrame) -> DataFrame:
    """w (word hash), c: counts of all words of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[np.ndarray] = [h for _, h, _ in _tokens(batch.column("text"))]
            w, c = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c.astype(np.int64))], ["w", "c"])

    return train.select("text").mapInArrow(tidy(run), "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def sequences(rows: DataFrame, held) -> DataFrame:
    """The columns of rows (doc_id, k, held_out, text) but the text, and of each whole text: ids (token numbers, the end included), size, known, and sums of the known words' logs (base: all; rest: of rare ones); rare (how many), tw and tn (unknown words and how often each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = held.value
        end = np.log10(voc.texts + ADD)
        for batch in batches:
            for first, h, bounds in _tokens(batch.column("text")):
                n = len(bounds) - 1
                numbers, c = voc.look(h)
                of = np.repeat(np.arange(n), np.diff(bounds))
                total = lambda weight: np.bincount(of, weight, n).astype(float)  # noqa: B023, E731
                there, is_rare = c >= 0, numbers == RARE
                log_c = np.where(there, np.log10(np.maximum(c, 0) + ADD), 0.0)
                ids = np.insert(numbers, bounds[1:], END)  # after each text's words
                listed = pa.ListArray.from_arrays(pa.array((bounds + np.arange(n + 1)).astype(np.int32)), pa.array(ids, pa.int32()))
                # unknown words: once a text, with their number
                lost = np.flatnonzero(~there)
                order = lost[np.lexsort((h[lost], of[lost]))]
                w, t = h[order], of[order]
                edge = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (t[1:] != t[:-1])]) if len(order) else np.zeros(0, np.int64)
                at = pa.array(np.searchsorted(t[edge], np.arange(n + 1)).astype(np.int32))
                tail = [pa.ListArray.from_arrays(at, pa.array(w[edge].view(np.int64))), pa.ListArray.from_arrays(at, pa.array(np.diff(np.r_[edge, len(order)]).astype(np.int32)))]
                part = batch.slice(first, n)
                own = [pa.array(np.diff(bounds) + 1, pa.int64()), pa.array((total(there) + (voc.texts > 0)).astype(np.int64)), pa.array(total(log_c) + end), pa.array(total(log_c * is_rare)), pa.array(total(is_rare).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in ("doc_id", "k", "held_out")), listed, *own, *tail], ["doc_id", "k", "held_out", "ids", "size", "known", "base", "rest", "rare", "tw", "tn"])

    return rows.select("doc_id", "k", "held_out", "text").mapInArrow(tidy(run), "doc_id long, k long, held_out boolean, ids array<int>, size long, known long, base double, rest double, rare long, tw array<long>, tn array<int>")


def most_frequent(counted: DataFrame, most: int = KNOWN) -> DataFrame:
    """w, c of words that are all more frequent than any other: as many as fit into `most`, by a histogram of counts in steps of a sixteenth of a power of two."""
    step = F.floor(F.log2("c") * 16)
    left, least = most, 1 << 12
    for r in sorted(counted.groupBy(step.alias("step")).count().collect(), reverse=True):  # 1024 rows at most
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    return counted.filter(step >= least)


def groups(batches: Iterator[pa.RecordBatch], tokens: int = GROUP_TOKENS) -> Iterator[list[np.ndarray]]:
    """The texts in order, in groups that end with the text by which they hold so many tokens, whatever the batches."""
    texts, size = [], 0
    for batch in batches:
        for x in batch.column("ids").to_numpy(zero_copy_only=False):
            texts.append(np.array(x))
            size += len(x)
            if size >= tokens:
                yield texts
                texts, size = [], 0
    if texts:
        yield texts


def fit(parts: DataFrame, held, rounds: int = ROUNDS) -> bytes:
    """Average of the replicas that the partitions of `parts` (k, ids; dealt by k) train, `rounds` times over; means of FAN_IN at a time till a few are left."""
    sc = parts.sparkSession.sparkContext
    tokens = parts.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).collect()[0][0]
    replicas = max(8, tokens // REPLICA_TOKENS)
    parts = parts.repartition(replicas, "k").sortWithinPartitions("k", "ids").select("ids")
    voc = held.value
    blob = Model(voc.cls, voc.mass).dump()

    def replica(batches: Iterator[pa.RecordBatch], start) -> Iterator[pa.RecordBatch]:
        model, n = Model(held.value.cls, held.value.mass).load(start.value), 0
        for texts in groups(batches):
            model.train(texts)
            n += sum(map(len, texts))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([model.dump()], pa.binary())], ["n", "w"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, None
        for batch in batches:
            for n, w in zip(batch.column("n").to_pylist(), batch.column("w").to_pylist(), strict=True):
                with np.load(io.BytesIO(w)) as z:
                    got = {k: z[k].astype(np.float64) * n for k in z.files}
                sums = got if sums is None else {k: sums[k] + got[k] for k in got}
                total += n
        if total:
            out = io.BytesIO()
            np.savez(out, **{k: (v / total).astype(np.float32) for k, v in sums.items()})
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([out.getvalue()], pa.binary())], ["n", "w"])

    for _ in range(rounds):
        start = sc.broadcast(blob)
        trained = parts.mapInArrow(tidy(lambda it, start=start: replica(it, start)), "n long, w binary")
        # neighbours first, however many partitions there are, then FAN_IN means at a time
        near = trained.withColumn("g", F.floor(F.spark_partition_id() / FAN_IN)).repartition("g").select("n", "w")
        trained, left = near.mapInArrow(tidy(mean), "n long, w binary"), -(-replicas // FAN_IN)
        while True:
            left = -(-left // FAN_IN)
            trained = trained.repartition(left).mapInArrow(tidy(mean), "n long, w binary")
            if left == 1:
                break
        for r in trained.collect():  # one row; none from an empty corpus
            blob = bytes(r.w)
    return blob


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("k"), F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 10 == 0, F.lit(True)).alias("held_out"), F.col(text).alias("text"))
    train = rows.filter(~F.col("held_out"))
    counted = cut(counts(train), "counts", WIDE)
    words, kinds = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).collect()[0]
    texts = train.count()
    top = most_frequent(counted).toArrow()
    n, v = words + texts, kinds + (texts > 0)
    voc = Vocabulary(top.column("w").to_numpy().view(np.uint64), top.column("c").to_numpy(), n, v, texts)
    held = sc.broadcast(voc)
    read = cut(sequences(rows, held), "sequences", WIDE)
    weights = sc.broadcast(fit(read.filter(~F.col("held_out")).select("k", "ids"), held))
    own = ["doc_id", "k", "held_out", "size", "known", "base", "rest", "rare", "own_m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = held.value
        model = Model(voc.cls, voc.mass).load(weights.value)
        for batch in batches:
            ids, at = batch.column("ids").values.to_numpy(), batch.column("ids").offsets.to_numpy()
            net = model.score([ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(net)], [*own, "net"])

    counted_own = read.withColumn("own_m", F.aggregate("tn", F.lit(0).cast("long"), lambda s, x: s + x)).select(*own, "ids")
    seen = cut(counted_own.mapInArrow(tidy(run), "doc_id long, k long, held_out boolean, size long, known long, base double, rest double, rare long, own_m long, net double"), "scored", WIDE)
    tail = read.select("doc_id", "k", F.explode(F.arrays_zip("tw", "tn")).alias("t")).select("doc_id", "k", F.col("t.tw").alias("w"), F.col("t.tn").cast("long").alias("m"))
    tail = tail.join(counted, "w", "left")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + ADD)
    # rows equal in id and text come in together here, and are set apart again by their number
    tail = tail.groupBy("doc_id", "k").agg(F.sum("m").alias("all_m"), F.sum(F.when(F.col("c").isNotNull(), F.col("m")).otherwise(0)).alias("known_m"), F.sum(F.col("m") * log_c).alias("log_m"))
    tail = tail.withColumnsRenamed({"doc_id": "t_id", "k": "t_k"})
    out = seen.join(tail, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("k") == F.col("t_k")), "left")
    share = F.when(F.col("own_m") > 0, F.col("own_m") / F.col("all_m")).otherwise(0.0)
    more = F.coalesce(F.col("log_m") * share, F.lit(0.0))
    return out.select(
        "doc_id", "held_out", F.col("size").alias("n_tokens"),
        (F.col("known") + F.coalesce(F.round(F.col("known_m") * share), F.lit(0.0)).cast("long")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("size") * F.lit(float(voc.log_all))).alias("base_score"),
        (F.col("net") + F.col("rest") + more - F.col("rare") * F.lit(float(voc.log_rare))).alias("score"),
    )
