"""Recompression of a block's words: which runs and pairs of symbols a round names, and what stays of each window.

A symbol is a stretch of words. Words stand for themselves by a hash; the names of runs and pairs come from
outside (``naming``), where equal ones get one name and those that stand once only get none (0). The first round
names runs of a repeated word and pairs of two single words, later rounds pairs of symbols: a bit of a symbol's name says whether it is a
left or a right one, and a left symbol followed by a right one becomes one symbol. No symbol grows beyond
``cap`` words. Whether neighbours merge depends on them alone, so two equal windows are parsed alike but for
margins, which can be told from the window itself: ``low`` and ``high`` bound its interior in every round. A
window with a nameless symbol in its interior stands nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b
from itertools import chain

import numpy as np
import xxhash

U = np.uint64


def listed(words: list[bytes]) -> np.ndarray:
    """Words as an array, from which many are taken at once."""
    out = np.empty(len(words), object)
    out[:] = words
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64 bits of XXH3 of each word, never 0: enough where words are compared in full afterwards."""
    found = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    return np.where(found == 0, U(1), found)


def word_digests(words: list[bytes]) -> np.ndarray:
    """64 bits of BLAKE2 of each word, never 0: for words that are known by them alone."""
    found = np.frombuffer(b"".join([blake2b(w, digest_size=8).digest() for w in words]), "<u8").astype(U)
    return np.where(found == 0, U(1), found)


def numbered(texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, number of each word, where each text's words begin)."""
    bounds = np.concatenate([[0], np.cumsum([len(ws) for ws in texts])]).astype(np.int64)
    distinct = list(dict.fromkeys(chain.from_iterable(texts)))
    number = {w: k for k, w in enumerate(distinct)}
    return distinct, np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int32, int(bounds[-1])), bounds


def chained(h: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of ``size`` consecutive values, at every place or at those given; each step is mixed."""
    if at is None:
        at = np.arange(max(0, len(h) - size + 1))
    out = np.full(len(at), U(size))
    for k in range(size):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[at + k])
    return out


#: What a window is: gone (equal to no other), alive (with an interior), loose (nothing known).
GONE, ALIVE, LOOSE = 0, 1, 2


@dataclass
class State:
    """Symbols of a block (name, first word) and, by its first word, each window: what it is, margins at both ends."""

    bounds: np.ndarray
    sym: np.ndarray
    pos: np.ndarray
    flag: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def n(self) -> int:
        return int(self.bounds[-1])

    def length(self) -> np.ndarray:
        return np.diff(np.append(self.pos, self.n))


def begin(hashes: np.ndarray, bounds: np.ndarray, window: int, skip: np.ndarray) -> State:
    """All windows of texts that ``skip`` doesn't name."""
    n = int(bounds[-1])
    flag = np.zeros(n, np.int8)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.arange(max(0, n - window + 1))
    if len(starts):
        flag[starts] = (owner[starts] == owner[starts + window - 1]) & ~skip[owner[starts]]
    margin = np.zeros(n, np.int8)
    return State(bounds, hashes, np.arange(n), flag, margin, margin.copy())


def _is_right(sym: np.ndarray, level: int) -> np.ndarray:
    return (mix(sym * U(0xD6E8FEB86659FD93) + U(2 * level + 1)) >> U(63)).astype(bool)


def _same_owner(state: State) -> np.ndarray:
    """Of each symbol but the last, whether the next one is in the same text."""
    owner = np.searchsorted(state.bounds, state.pos, "right")
    return owner[1:] == owner[:-1]


@dataclass
class Merges:
    """What a round would merge: first symbol, number of symbols, and a key.

    The key is a hash of the two parts. Should two pairs share one, they share a name, which only brings more windows together.
    """

    at: np.ndarray
    count: np.ndarray
    key: np.ndarray


def plan(state: State, level: int, window: int, cap: int) -> Merges:
    """Merges of a round, 1 at first, of words that a window still needs."""
    sym, m = state.sym, len(state.sym)
    none = np.zeros(0, np.int64)
    if not m:
        return Merges(none, none, none.astype(U))
    length = state.length()
    steps = np.zeros(state.n + 1, np.int64)
    open_ = np.flatnonzero(state.flag)
    np.add.at(steps, open_, 1)
    np.add.at(steps, open_ + window, -1)
    needed = np.cumsum(steps)[:-1] > 0
    live = (sym != 0) & needed[state.pos]
    joined = _same_owner(state)
    right = _is_right(sym, level)
    single = np.ones(m, bool)
    at, count = none, none
    if level == 1:
        head = np.flatnonzero(np.concatenate([[True], (sym[1:] != sym[:-1]) | ~joined]))
        run = np.diff(np.append(head, m))
        single = np.repeat(run == 1, run)
        merged = (run > 1) & (run <= cap) & live[head]
        at, count = head[merged], run[merged]
    pair = np.flatnonzero(single[:-1] & single[1:] & ~right[:-1] & right[1:] & joined & (length[:-1] + length[1:] <= cap) & live[:-1] & live[1:])
    first = np.concatenate([sym[at], sym[pair]])
    second = np.concatenate([(-count).astype(np.int64).view(U), sym[pair + 1]])
    key = mix(mix(first + U(level)) * U(0x9E3779B97F4A7C15) + second)
    return Merges(np.concatenate([at, pair]), np.concatenate([count, np.full(len(pair), 2)]), key)


def _edges(state: State, level: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each place where an interior may begin (end): where it begins (ends) after the round."""
    n, sym, length = state.n, state.sym, state.length()
    left, right_ = np.arange(n + 1), np.arange(n + 1)
    is_right = _is_right(sym, level)
    if level > 1:
        small = (length < cap) & (sym != 0)
        left[state.pos] = np.where(is_right & small, state.pos + length, state.pos)
        right_[state.pos + length] = np.where(~is_right & small, state.pos, state.pos + length)
        return left, right_
    # Symbols are words. A run at the edge may go on outside; a word at the edge may be of a run or a pair outside, or of a pair inside.
    same = np.append(~(sym[1:] == sym[:-1]) | ~_same_owner(state), True) if n else np.zeros(0, bool)  # the run ends here
    end = np.flatnonzero(same)
    begin_ = np.concatenate([[0], end[:-1] + 1])
    run = end - begin_ + 1
    at = np.arange(n)
    ahead, back = np.repeat(end + 1, run) - at, at - np.repeat(begin_, run) + 1
    ahead_next, back_last = np.append(ahead[1:], 0), np.concatenate([[0], back[:-1]])
    pair = np.append(~is_right[:-1] & is_right[1:], False)
    left[:n] = np.where(ahead > cap, at, np.where(ahead > 1, at + ahead, np.where(pair & (ahead_next == 1), at + 2, at + 1)))
    right_[1:] = np.where(back > cap, at + 1, np.where(back > 1, at + 1 - back, np.where(np.concatenate([[False], pair[:-1]]) & (back_last == 1), at - 1, at)))
    return left, right_


def apply(state: State, merges: Merges, names: np.ndarray, level: int, window: int, cap: int) -> State:
    """The state after a round, ``names`` being those of its merges (0: stands once only)."""
    n, m = state.n, len(state.sym)
    left, right = _edges(state, level, cap)
    alive = np.flatnonzero(state.flag == ALIVE)
    low, high = left[alive + state.low[alive]], right[alive + window - state.high[alive]]
    sym, stays = state.sym.copy(), np.ones(m, bool)
    sym[merges.at] = names
    inner = merges.count - 1
    first = np.repeat(merges.at + 1 - np.concatenate([[0], np.cumsum(inner)[:-1]]), inner) if len(inner) else np.zeros(0, np.int64)
    stays[first + np.arange(len(first))] = False
    sym, pos = sym[stays], state.pos[stays]
    dead = np.concatenate([[0], np.cumsum(np.bincount(pos[sym == 0], minlength=n))]) if n else np.zeros(1, np.int64)
    flag, low8, high8 = state.flag.copy(), state.low.copy(), state.high.copy()
    inside = low < high
    flag[alive[~inside]] = LOOSE
    gone = inside & (dead[np.where(inside, high, 0)] > dead[np.where(inside, low, 0)])
    flag[alive[gone]] = GONE
    keeps = inside & ~gone
    low8[alive[keeps]] = (low - alive)[keeps]
    high8[alive[keeps]] = (alive + window - high)[keeps]
    # Words that no window needs any more become one nameless symbol.
    steps = np.zeros(n + 1, np.int64)
    open_ = np.flatnonzero(flag)
    np.add.at(steps, open_, 1)
    np.add.at(steps, open_ + window, -1)
    needed = (np.cumsum(steps)[:-1] > 0)[pos] if n else np.zeros(0, bool)
    sym = np.where(needed, sym, U(0))
    first_of = np.ones(len(sym), bool)
    first_of[1:] = needed[1:] | needed[:-1]
    return State(state.bounds, sym[first_of], pos[first_of], flag, low8, high8)


def picks(state: State, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, symbol) of all windows that may stand elsewhere: of the longest symbols of its interior the
    one of the highest name, or 0 where it has no interior."""
    at = np.flatnonzero(state.flag)
    out = np.zeros(len(at), U)
    alive = state.flag[at] == ALIVE
    if not alive.any():
        return at, out
    index = np.zeros(state.n + 1, np.int64)
    index[state.pos] = np.arange(len(state.pos))
    index[state.n] = len(state.pos)
    a, b = index[(at + state.low[at])[alive]], index[(at + window - state.high[at])[alive]]
    key = (state.length().astype(U) << U(56)) | (state.sym & U((1 << 56) - 1))
    best, span = [np.arange(len(key))], 1
    while span * 2 <= window and span * 2 <= len(key):
        x, y = best[-1][: len(key) - 2 * span + 1], best[-1][span : len(key) - span + 1]
        best.append(np.where(key[x] >= key[y], x, y))
        span *= 2
    level = np.frexp(b - a)[1] - 1
    found = np.zeros(len(a), U)
    for k in np.unique(level):
        m = level == k
        x, y = best[k][a[m]], best[k][b[m] - (1 << int(k))]
        found[m] = np.maximum(key[x], key[y])
    out[alive] = found
    return at, out


def equal_windows(ids: np.ndarray, at: np.ndarray, digest: np.ndarray, window: int, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(permutation, heads): windows at ``at`` sorted by group and then ``order``, and which of them begin a group.

    Windows of one group have equal ``ids``, word by word; the digest only brings them together.
    """
    digest = digest.copy()
    while True:
        by = np.lexsort((*order[::-1], digest))
        head = np.ones(len(by), bool)
        head[1:] = digest[by][1:] != digest[by][:-1]
        first = np.flatnonzero(head)
        of = at[by[np.repeat(first, np.diff(np.append(first, len(by))))]]
        differs = np.zeros(len(by), bool)
        for k in range(window):
            differs |= ids[at[by] + k] != ids[of + k]
        if not differs.any():
            return by, head
        digest[by[differs]] = mix(digest[by[differs]] + U(1))
