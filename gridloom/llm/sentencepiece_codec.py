"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking.

A piece sequence is the model's encoding of a text exactly if merging any two neighbouring pieces' characters again,
by the model's merge order, gives back those two pieces. So the encoder walks a word from the left: an Aho-Corasick
automaton gives the pieces that start at each place, the longest comes first, a candidate must be compatible with
the piece before it (found by taking their merges back and merging again at the border), and a bitfield marks places from which no
encoding was found, so none is tried twice. Characters without a piece become byte pieces.

Where no piece of the vocabulary holds two kinds of characters side by side (a blank mark after another character, a
letter beside a sign), nothing ever merges across, so texts are cut there and the encodings of the parts are
independent; which cuts are safe is read from the vocabulary. Parts are remembered, up to twice CACHE_PARTS a worker.

The model file is a parameter and is read by the workers (`public_tokenizers.path`, the same on every machine).

Defined cases: null and empty texts give the end id alone and decode to an empty text; repeated rows are encoded
alike; a word of any length is encoded whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BATCH_ROWS, tidy

MARK = "▁"
MODEL = "piece_bpe_32k.model"
CACHE_PARTS = 400_000
CACHE_PAIRS = 400_000
#: Characters of a word whose matches are held at once, twice over.
STRETCH = 1 << 16
#: Kinds of characters, each a pattern; texts are cut between kinds that no piece joins. One character a part: digits and line ends.
KINDS = {"mark": MARK, "letter": r"[^\W\d_]", "digit": r"\d", "line": r"\n", "sign": rf"(?:_|[^\w\n{MARK}])"}
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def matches(trie, s: str, a: int, b: int, end: int) -> list[list[tuple[int, int]]]:
    """(length, id) of the pieces that start at each place from a to b and stop by `end`, the shortest first."""
    starts: list[list[tuple[int, int]]] = [[] for _ in range(b - a)]
    for last, found in trie.iter(s, a, end):  # ends ascend, so the lengths at each start do too
        at = last + 1 - found[0] - a
        if at < b - a:
            starts[at].append(found)
    return starts


class Matches:
    """`matches` of a very long word, by place; two stretches of it are held at a time, and others are found again when the search goes back."""

    def __init__(self, trie, s: str, longest: int):
        self.trie, self.s, self.longest = trie, s, longest
        self.held: dict[int, list[list[tuple[int, int]]]] = {}

    def __getitem__(self, i: int) -> list[tuple[int, int]]:
        number, at = divmod(i, STRETCH)
        got = self.held.get(number)
        if got is None:
            if len(self.held) > 1:
                del self.held[max(self.held, key=lambda x: abs(x - number))]
            b = min(len(self.s), (number + 1) * STRETCH)
            got = self.held[number] = matches(self.trie, self.s, number * STRETCH, b, min(len(self.s), b + self.longest))
        return got[at]


class Codec:
    """Encoder and decoder of one model. The library is asked for the vocabulary and for decode(), never to encode."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        kind = lambda ch: next(k for k, pattern in KINDS.items() if re.fullmatch(pattern, ch))
        pairs = {(a, b) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        # letters that stand beside a sign in a piece (such as a raised figure before a full stop) count as signs
        odd = {x for a, b in pairs if {kind(a), kind(b)} == {"letter", "sign"} for x in (a, b) if kind(x) == "letter"}
        joined = {tuple("sign" if x in odd else kind(x) for x in pair) for pair in pairs}
        if any(b == "mark" != a for a, b in joined):
            raise ValueError("a piece has a blank mark after another character")
        if joined <= {("mark", "mark"), ("mark", "letter"), ("mark", "sign"), ("letter", "letter"), ("sign", "sign")}:
            rest = "".join(map(re.escape, sorted(odd)))
            letter, sign = (f"(?![{rest}]){KINDS['letter']}", f"(?:[{rest}]|{KINDS['sign']})") if odd else (KINDS["letter"], KINDS["sign"])
            word = f"(?:{letter})+|{KINDS['digit']}|{KINDS['line']}|{sign}+"
        else:
            word = f"[^{MARK}]+"
        self.parted = re.compile(f"{MARK}*(?:{word})|{MARK}+")
        self.end = sp.eos_id()
        self.runs = max((len(p) for p in self.ids if set(p) == {MARK}), default=1)
        if any(ch not in self.ids for p in self.ids for ch in p):
            raise ValueError("a piece has a character that is no piece itself")
        #: By id: the score of the merge that makes a piece (None: one character), and the two pieces that it merges last.
        self.rank: list[float | None] = [None] * n
        self.halves: list[tuple[int, int]] = [(-1, -1)] * n
        #: Pieces that any two others make: first id * n + second id -> score.
        self.across = {self.ids[p[:k]] * n + self.ids[p[k:]]: self.score[p] for p in self.ids for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self.n = n
        self.trie = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) > 1 and set(p) != {MARK}:
                got, halves = self.merge(p)
                if got != [p]:
                    continue  # its characters never merge to it
                self.rank[i], self.halves[i] = self.score[p], tuple(self.ids[x] for x in halves)
            if len(p) == 1 or set(p) != {MARK}:
                self.trie.add_word(p, (len(p), i))
        self.trie.make_automaton()
        self.longest = max(map(len, self.ids))
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[tuple[int, ...], str]] = {}
        self.old_words: dict[str, tuple[tuple[int, ...], str]] = {}
        self.parts: dict[str, tuple[int, str, tuple[int, ...]]] = {}
        self.older: dict[str, tuple[int, str, tuple[int, ...]]] = {}

    def merge(self, s: str) -> tuple[list[str], tuple[str, str] | None]:
        """The symbols of s by the model's own order (the best score first, of equal ones the leftmost), and the two that merged last."""
        sym: list[str] = list(s)
        after, before, live, last = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1)), [True] * len(s), None
        queue = [(-self.score[p], i, p) for i in range(len(s) - 1) if (p := s[i : i + 2]) in self.score]
        heapify(queue)
        while queue:
            _, i, p = heappop(queue)
            j = after[i]
            if not live[i] or j >= len(s) or sym[i] + sym[j] != p:
                continue
            last = sym[i], sym[j]
            sym[i], live[j], after[i] = p, False, after[j]
            if after[i] < len(s):
                before[after[i]] = i
                if (q := p + sym[after[i]]) in self.score:
                    heappush(queue, (-self.score[q], i, q))
            if before[i] >= 0 and (q := sym[before[i]] + p) in self.score:
                heappush(queue, (-self.score[q], before[i], q))
        return [x for x, on in zip(sym, live, strict=True) if on], last

    def fits(self, a: int, b: int) -> bool:
        """Whether pieces a and b stand side by side: their merges are taken back, latest first, and at no time may the symbols beside the border have merged across it before."""
        rank, halves, across, n = self.rank, self.halves, self.across, self.n
        limit, first = float("-inf"), True  # the score of the merge taken back last; whether one across of that score comes before it
        while True:
            join = across.get(a * n + b)
            if join is not None and (join > limit or first and join == limit):
                return False
            ra, rb = rank[a], rank[b]
            if rb is None:
                if ra is None:
                    return True
                limit, first, a = ra, False, halves[a][1]
            elif ra is not None and ra < rb:  # the later merge is the one of worse score; of one score, the right one
                limit, first, a = ra, False, halves[a][1]
            else:
                limit, first, b = rb, True, halves[b][0]

    def pieces(self, s: str) -> list[int]:
        """The ids of s, whose characters are all pieces, and of which only the first may be a blank mark."""
        n, pairs, base = len(s), self.pairs, self.n
        if n > STRETCH:
            starts = Matches(self.trie, s, self.longest)
        else:
            starts = [[] for _ in range(n)]
            for end, found in self.trie.iter(s):  # ends ascend, so the lengths at each start do too
                starts[end + 1 - found[0]].append(found)
        if starts[0][-1][0] == n:
            return [starts[0][-1][1]]
        failed = bytearray((n >> 3) + 1)
        # of a very long word, numbers in 8 bytes each
        out, where, tries = (array("q"), array("q", [0]), array("q")) if n > STRETCH else ([], [0], [])
        i, k = 0, len(starts[0])
        while i < n:
            at = starts[i]
            while k:
                k -= 1
                size, piece = at[k]
                j = i + size
                if failed[j >> 3] & (1 << (j & 7)):
                    continue
                if out:
                    key = out[-1] * base + piece
                    good = pairs.get(key)
                    if good is None:
                        if len(pairs) >= CACHE_PAIRS:
                            pairs.clear()
                        good = pairs[key] = self.fits(out[-1], piece)
                    if not good:
                        continue
                out.append(piece)
                tries.append(k)
                where.append(j)
                i, k = j, len(starts[j]) if j < n else 0
                break
            else:
                if not out:
                    raise AssertionError("a text has no encoding")
                failed[i >> 3] |= 1 << (i & 7)  # from here nothing goes on, so this place is passed over from now on
                where.pop()
                out.pop()
                i, k = where[-1], tries.pop()
        return list(out)

    def word(self, s: str) -> list[int]:
        """The ids of s, of which only the first character may be a blank mark; characters without a piece become bytes."""
        if all(ch in self.ids for ch in s):
            return self.pieces(s)
        out: list[int] = []
        for known, run in groupby(s, self.ids.__contains__):
            out += self.pieces("".join(run)) if known else [self.bytes[b] for b in "".join(run).encode()]
        return out

    def part(self, s: str, keep: bool = True) -> tuple[int, str, tuple[int, ...]]:
        """Number of ids, the ids as text, and the ids, of one run of blanks with the word after it."""
        known = self.parts.get(s)
        if known is None:
            known = self.older.get(s)
            if known is None:
                word = s.lstrip(MARK)
                blanks = len(s) - len(word)
                got = self.word((MARK if blanks else "") + word) if word else [self.ids[MARK]]
                blanks -= bool(blanks)
                if blanks and got[0] == self.ids[MARK]:
                    blanks, got = blanks + 1, got[1:]
                # blanks that no word takes merge last, all with one score: leftmost first, so runs as long as can be
                whole, rest = divmod(blanks, self.runs)
                ids = [self.ids[MARK * self.runs]] * whole + ([self.ids[MARK * rest]] if rest else []) + got
                known = len(ids), " ".join(map(str, ids)), tuple(ids)
            if not keep:
                return known
            if len(self.parts) >= CACHE_PARTS:  # what was used lately moves on to the new half
                self.parts, self.older = {}, self.parts
            self.parts[s] = known
        return known

    def cut(self, text: str) -> list[str]:
        """The parts of a text, with its blanks as marks and the mark that the model puts in front."""
        return self.parted.findall(MARK + text.replace(" ", MARK)) if text else []

    def spans(self, text: str) -> tuple[list[tuple[int, ...]], list[str]]:
        """The ids of a text without the end id, in runs, and the same as text. Words between single blanks are remembered whole."""
        if not text:
            return [], []
        words = text.split(" ")
        if "" in words or MARK in text:
            got = [self.part(s) for s in self.cut(text)]
            return [g[2] for g in got], [g[1] for g in got]
        ids = list(map(self.words.get, words))
        if None in ids:
            for k in [k for k, x in enumerate(ids) if x is None]:
                w = words[k]
                if (known := self.words.get(w)) is None:
                    known = self.old_words.get(w)
                    if known is None:
                        found = self.parted.findall(MARK + w)
                        got = [self.part(s, len(found) > 1) for s in found]  # a word that is one part is remembered as a word
                        known = got[0][1:] if len(got) == 1 else (" ".join(g[1] for g in got), tuple(chain.from_iterable(g[2] for g in got)))
                        known = known[::-1]
                    if len(self.words) >= CACHE_PARTS:
                        self.words, self.old_words = {}, self.words
                    self.words[w] = known
                ids[k] = known
        return [x[0] for x in ids], [x[1] for x in ids]

    def encode(self, text: str) -> list[int]:
        """All ids with the end id."""
        return [*chain.from_iterable(self.spans(text)[0]), self.end]

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


_codecs: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    """The codec of a model of the public vocabulary files (a name), or of a file (a path); one a process."""
    if model not in _codecs:
        import public_tokenizers

        _codecs[model] = Codec(model if "/" in model else public_tokenizers.path(model))
    return _codecs[model]


def digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text. One pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            n_tokens, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                runs, shown = c.spans(text.as_py() or "")
                ids = [*chain.from_iterable(runs), c.end]
                n_tokens.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join([*shown, str(c.end)]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(tidy(run, BATCH_ROWS), SCHEMA)


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids (array of int) and decoded (string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            ids = [c.encode(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(tidy(run, BATCH_ROWS), "doc_id long, ids array<int>, decoded string")
