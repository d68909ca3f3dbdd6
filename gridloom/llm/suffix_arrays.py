"""Suffix arrays by induced sorting; of bytes in numpy, a bucket at a time instead of a suffix at a time.

Suffixes are classified (L: larger than the next, S: smaller), the substrings between leftmost S suffixes are sorted by
inducing and numbered, and the string of their numbers is ordered: at once if they differ, else recursively, each level
being a third of the one before or so; from that order all suffixes are induced in linear time. The numbers of a deeper
level have too many buckets to step through, so there both sortings are of the heads that induction would walk along
(a suffix up to its next leftmost S place, and that place's rank); a string of long runs, whose heads have no bound, is
ordered by doubling. Common prefixes are permuted (text order): only irreducible ones are compared, the others follow by
subtraction.
"""

from __future__ import annotations

import numpy as np

#: Rounds, of a few numbers each, in which heads are compared before a string counts as one of long runs.
HEAD = 64


def _classes(s: np.ndarray) -> np.ndarray:
    """True where the suffix is S-type; the end of the string counts as smaller than any byte."""
    n = len(s)
    turn = np.full(n, n - 1)
    differs = np.flatnonzero(s[:-1] != s[1:])
    turn[differs] = differs
    turn = np.minimum.accumulate(turn[::-1])[::-1]  # the end of the run of equal bytes
    out = np.zeros(n, bool)
    inner = turn < n - 1
    out[inner] = s[turn[inner]] < s[turn[inner] + 1]
    return out


def _deal(lists: list[list[np.ndarray]], at: np.ndarray, s: np.ndarray) -> None:
    """Append the places to the lists of their bytes, in order."""
    if not len(at):
        return
    c = s[at]
    order = np.argsort(c, kind="stable")
    at = at[order]
    edges = np.r_[0, np.cumsum(np.bincount(c, minlength=256))]
    for k in np.flatnonzero(np.diff(edges)):
        lists[k].append(at[edges[k] : edges[k + 1]])


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _induce(s: np.ndarray, small: np.ndarray, leftmost: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The L and the S suffixes of each byte, in order, from the leftmost S suffixes in order."""
    n = len(s)
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    heads: list[list[np.ndarray]] = [[] for _ in range(256)]
    _deal(heads, leftmost, s)
    _deal(larger, np.array([n - 1], np.int32), s)
    ls: list[np.ndarray] = []
    for c in range(256):
        k = 0
        while k < len(larger[c]):
            todo = _joined(larger[c][k:])
            larger[c][k:] = [todo]
            before = todo[todo > 0] - 1
            _deal(larger, before[~small[before]], s)
            k += 1
        head = _joined(heads[c])
        _deal(larger, head[head > 0] - 1, s)  # what stands before a leftmost S suffix is L
        ls.append(_joined(larger[c]))
    smaller: list[list[np.ndarray]] = [[] for _ in range(256)]
    ss: list[np.ndarray] = [np.zeros(0, np.int32)] * 256
    for c in range(255, -1, -1):  # from the largest: all orders are reversed
        k = 0
        while k < len(smaller[c]):
            todo = _joined(smaller[c][k:])
            smaller[c][k:] = [todo]
            before = todo[todo > 0] - 1
            _deal(smaller, before[small[before]], s)
            k += 1
        l = ls[c][::-1]
        before = l[l > 0] - 1
        _deal(smaller, before[small[before]], s)
        ss[c] = _joined(smaller[c])[::-1]
    return ls, ss


def _by_heads(s: np.ndarray, is_left: np.ndarray, at: np.ndarray, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The suffixes at these places in order of their heads: their numbers up to the next leftmost S place, with it, and then that place's rank (if ranks are known). Also which equal the one before. None if heads are longer than HEAD."""
    n, m = len(s), len(at)
    token = np.r_[2 * (s + 1) + is_left, 1]  # the end is a place of its own, smaller than all
    stop = np.r_[is_left, True]
    bits = int(max(token.max(), 0 if rank is None else rank.max())).bit_length()
    each = max(1, 62 // bits)
    place, first = at.astype(np.int64), True
    stage = np.zeros(m, np.int8)  # 0: among numbers, 1: at its stop, the rank comes next, 2: read to its end
    order, group = np.arange(m), np.zeros(m, np.int64)  # both by place in the order
    live = np.arange(m)
    for _ in range(HEAD):
        who = order[live]
        key = np.zeros(len(who), np.int64)
        p, g = place[who], stage[who]
        for _ in range(each):
            now = np.where(g == 0, 2 * (s[np.minimum(p, n - 1)] + 1) if first else token[p], 0)
            if rank is not None:
                now = np.where(g == 1, rank[p], now)
            key = (key << bits) | now
            ends = (g == 0) & (stop[p] if not first else False)
            p = np.where((g == 0) & ~ends, np.minimum(p + 1, n), p)
            g = np.where(ends, 1, np.where(g == 1, 2, g)).astype(np.int8)
            first = False
        place[who], stage[who] = p, g
        by = np.lexsort((key, group[live]))
        who, key = who[by], key[by]
        order[live] = who
        edge = np.r_[True, (group[live][1:] != group[live][:-1]) | (key[1:] != key[:-1])]
        group[live] = np.maximum.accumulate(np.where(edge, live, 0))  # a group is named by its first place
        new = group[live]
        alone = edge & np.r_[edge[1:], True]
        goes_on = ~alone & (stage[who] < (1 if rank is None else 2))
        live = live[goes_on]
        if not len(live):
            return at[order], np.r_[False, group[1:] == group[:-1]]
    return None


def _by_doubling(s: np.ndarray) -> np.ndarray:
    """The suffix array of numbers that come in long runs, by doubling."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1] + 1
    step = 1
    while True:
        after = np.r_[rank[step:], np.zeros(min(step, n), rank.dtype)]
        key = rank.astype(np.int64) * (n + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.r_[True, key[order][1:] != key[order][:-1]]
        if fresh.all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        step *= 2


def _order_of_numbers(s: np.ndarray) -> np.ndarray:
    """The suffix array of a string of numbers: leftmost substrings are sorted and numbered, ordered recursively, and all suffixes follow from their order and their heads."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    small = _classes(s)
    is_left = np.zeros(n, bool)
    is_left[1:] = small[1:] & ~small[:-1]
    left = np.flatnonzero(is_left)
    rank = np.zeros(n + 1, np.int64)
    if len(left):
        sorted_ = _by_heads(s, is_left, left, None)
        if sorted_ is None:
            return _by_doubling(s)
        order, same = sorted_
        if same.any():
            number = np.empty(n, np.int64)
            number[order] = np.cumsum(~same) - 1
            order = left[_order_of_numbers(number[left])]
        rank[order] = np.arange(1, len(order) + 1)
    every = _by_heads(s, is_left, np.arange(n), rank)
    return _by_doubling(s) if every is None else every[0]


def _names(s: np.ndarray, left: np.ndarray, by_substring: np.ndarray) -> tuple[np.ndarray, int]:
    """Of the leftmost substrings in text order: numbers by their order, equal ones alike; and how many differ."""
    n = len(s)
    end = np.full(n, n, np.int64)
    end[left[:-1]] = left[1:]
    length = end[by_substring] - by_substring + 1
    same = length[1:] == length[:-1]
    live = np.flatnonzero(same)
    k = 0
    padded = np.r_[s.astype(np.int64), -1, -1]
    while len(live):  # neighbours of one length, place by place
        a, b = by_substring[live], by_substring[live + 1]
        equal = padded[a + k] == padded[b + k]
        same[live[~equal]] = False
        k += 1
        live = live[equal & (length[live] > k)]
    number = np.empty(n, np.int64)
    number[by_substring] = np.r_[0, np.cumsum(~same)]
    return number[left], int(len(left) - same.sum())


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of all suffixes of a byte string."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    small = _classes(s)
    is_left = np.zeros(n, bool)
    is_left[1:] = small[1:] & ~small[:-1]
    left = np.flatnonzero(is_left).astype(np.int32)
    both = lambda ls, ss: np.concatenate([x for c in range(256) for x in (ls[c], ss[c])])
    ls, ss = _induce(s, small, left)  # sorts the leftmost substrings
    if not len(left):
        return both(ls, ss)
    by_substring = np.concatenate(ss)
    by_substring = by_substring[is_left[by_substring]]
    names, different = _names(s, left, by_substring)
    sorted_left = by_substring if different == len(left) else left[_order_of_numbers(names)]
    return both(*_induce(s, small, sorted_left))


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place, the length of the common prefix of its suffix and the one before it in the order."""
    n = len(s)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.empty(n, np.int32)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    irreducible = (place == 0) | (before <= 0) | (np.r_[True, s[:-1] != s[np.maximum(before[1:] - 1, 0)]])
    irreducible[1:] |= before[:-1] < 0
    at = np.flatnonzero(irreducible)
    wide = np.zeros(n + 8, np.uint64)
    padded = np.r_[s, np.zeros(16, np.uint8)].astype(np.uint64)
    for k in range(8):
        wide |= padded[k : k + n + 8] << np.uint64(8 * k)
    live = at[before[at] >= 0]
    a, b = live, before[live]
    while len(live):  # eight bytes a round
        x = wide[np.minimum(a, n)] ^ wide[np.minimum(b, n)]
        room = n - np.maximum(a, b)
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, (np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64))
        got = np.minimum(same, np.minimum(room, 8))
        out[live] += got
        go = got == 8
        live, a, b = live[go], a[go] + 8, b[go] + 8
    # the others are one less than at the place before
    source = np.maximum.accumulate(np.where(irreducible, place, 0))
    return np.maximum(out[source] - (place - source), 0)
