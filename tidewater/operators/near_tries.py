"""Pairs of two lots of texts of one length each within an edit distance: both tries are walked together.

A pair of prefixes is a row (node of x, node of y, state); the state stands for
the cells of the edit matrix at the border of the two prefixes that can still
lead to a pair.  All pairs of children come from the letters they have in
common with the last letters of the other, through one table, and those without
such a cell are dropped with all that begins so.  So the work is near the number
of pairs found, and no more than SLICE rows are made at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Most edits (the table has a column for each 2 ** (2 * edits + 1) letters in common), rows made at once, and bytes of the tables of two lots.
EDITS, SLICE, TABLES = 6, 1 << 18, 1 << 26
#: Letters that fill up the shorter text; none is a letter of a text or the other.
FILL_X, FILL_Y = 0xFFFFFFFF, 0xFFFFFFFE


@lru_cache(maxsize=64)
def machine(k: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next state by state and letters in common, what can follow, distance by state) of texts within k edits of which the second is t letters longer.

    What can follow a state and the common letters of the diagonals below the middle one: 0 nothing, 1 the same letter only, 2 any.  A state has a cell for each diagonal from -k (the second text behind) to k; cells that lead to more than k edits are k + 1. State 0 has no other cells, 1 is the start.
    """
    width, over = 2 * k + 1, k + 1
    unlike = 1 - (np.arange(1 << width)[:, None] >> np.arange(width) & 1).astype(np.int8)
    aside = np.abs(np.arange(-k, k + 1) - t)
    base = (k + 2) ** np.arange(width, dtype=np.int64)
    start = np.full(width, over, np.int8)
    start[k] = 0
    states, known, following = [np.full(width, over, np.int8), start], {int(base.sum() * over): 0, int(start @ base): 1}, [np.zeros((1, 1 << width), np.uint16)]
    done = 1
    while done < len(states):
        old = np.array(states[done : done + 16])[:, None, :]
        done += old.shape[0]
        new = old + unlike
        for q in (*range(k), *range(2 * k, k, -1)):  # from the outer diagonals to the middle one
            inner, outer = (q + 1, q - 1) if q < k else (q - 1, q + 1)
            new[..., q] = np.minimum(new[..., q], old[..., inner] + 1)
            if 0 <= outer < width:
                new[..., q] = np.minimum(new[..., q], new[..., outer] + 1)
        if k:
            new[..., k] = np.minimum(new[..., k], np.minimum(new[..., k - 1], new[..., k + 1]) + 1)
        new[new + aside > k] = over
        codes, first, place = np.unique(new @ base, return_index=True, return_inverse=True)
        for code, at in zip(codes.tolist(), first.tolist()):
            if code not in known:
                known[code] = len(states)
                states.append(new.reshape(-1, width)[at])
        following.append(np.array([known[c] for c in codes.tolist()], np.uint16)[place].reshape(-1, 1 << width))
    table = np.concatenate(following)
    lives = (table > 0).reshape(-1, 1 << k, 2, 1 << k).any(axis=1)  # by the middle diagonal and those below
    follows = np.zeros(table.shape, np.int8)
    follows[:, : 1 << k] = np.where(lives[:, 0], 2, lives[:, 1])
    return table.ravel(), follows.ravel(), np.array(states)[:, k + t]


class _Trie:
    """Of sorted, different rows of letters: for each depth the first row, children and letter of each node."""

    def __init__(self, letters: np.ndarray):
        size, depth = letters.shape
        parted = np.logical_or.accumulate(letters[1:] != letters[:-1], axis=1)
        self.first = [np.zeros(1, np.int64)] + [np.flatnonzero(np.r_[True, parted[:, d]]) for d in range(depth)]
        self.start, self.count, self.letter, self.kinds = [], [], [None], [None]
        for d in range(depth):
            start = np.searchsorted(self.first[d + 1], self.first[d])
            self.start.append(start)
            self.count.append(np.diff(start, append=len(self.first[d + 1])))
            kinds, letter = np.unique(letters[self.first[d + 1], d], return_inverse=True)
            self.letter.append(letter)
            self.kinds.append(kinds)

    def bytes_with(self, other: _Trie) -> int:
        return 6 * sum(len(f) * len(k) for f, k in zip(self.first[1:], other.kinds[1:]))

    def child(self, d: int, letters: np.ndarray) -> np.ndarray:
        """For each node at depth d - 1 and each of the letters the child, or -1."""
        out = np.full((len(self.first[d - 1]), len(letters)), -1, np.int32)
        at = np.searchsorted(letters, self.kinds[d]).clip(max=len(letters) - 1)
        at = np.where(letters[at] == self.kinds[d], at, -1)[self.letter[d]]
        own = np.flatnonzero(at >= 0)
        out[np.repeat(np.arange(len(out)), self.count[d - 1])[own], at[own]] = own
        return out.ravel()


def _in_common(letters: np.ndarray, first: np.ndarray, others: np.ndarray, d: int, back: range, bits: list[int]) -> np.ndarray:
    """For each node and each letter of the other trie at depth d: a bit for each of the node's letters so many places before d that is the same."""
    out = np.zeros((len(first), len(others)), np.uint16)
    for b, bit in zip(back, bits):
        if d - b >= 1:
            out |= (letters[first, d - b - 1][:, None] == others).astype(np.uint16) << np.uint16(bit)
    return out.ravel()


def near(x: np.ndarray, y: np.ndarray, k: int, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of x, rows of y and their distances, for pairs within k edits; x and y are sorted, different rows of letters. same: y is x, and a pair comes once."""
    if not len(x) or not len(y):
        return
    t = y.shape[1] - x.shape[1]
    if abs(t) > k:
        return
    end = 0
    while end < min(x.shape[1], y.shape[1]) and (x[:, -1 - end] == x[0, -1 - end]).all() and (y[:, -1 - end] == x[0, -1 - end]).all():
        end += 1  # an end that all have changes no distance
    depth = max(x.shape[1], y.shape[1]) - end
    fill = lambda rows, letter: np.pad(rows[:, : rows.shape[1] - end], ((0, 0), (0, depth + end - rows.shape[1])), constant_values=letter)
    a, b = fill(x, FILL_X), fill(y, FILL_Y)
    p = _Trie(a)
    q = p if same else _Trie(b)
    if max(len(x), len(y)) > 256 and p.bytes_with(q) + q.bytes_with(p) > TABLES:
        yield from _halves(x, y, k, same)
        return
    following, follows, distance = machine(k, t)
    width = 2 * k + 1
    tables = [None] * (depth + 1)
    todo = [(0, np.zeros(1, np.intp), np.zeros(1, np.intp), np.ones(1, np.uint16))]
    while todo:
        d, u, v, state = todo.pop()
        if d == depth:
            far = distance.take(state)
            good = np.flatnonzero((far <= k) & (u < v) if same else far <= k)
            if len(good):
                yield u[good], v[good], far[good]
            continue
        of_u, of_v = p.count[d].take(u), q.count[d].take(v)
        until = np.cumsum(of_u * of_v)
        if until[-1] > SLICE and len(u) > 1:
            cuts = np.unique(np.searchsorted(until, np.arange(SLICE, until[-1], SLICE), side="right").clip(1, len(u) - 1))
            todo += [(d, *part) for part in zip(*(np.split(c, cuts) for c in (u, v, state)))]
            continue
        d += 1
        if tables[d] is None:
            before = _in_common(b, q.first[d - 1], p.kinds[d], d, range(1, k + 1), [k - i for i in range(1, k + 1)])
            tables[d] = before, _in_common(a, p.first[d], q.kinds[d], d, range(k + 1), [k + i for i in range(k + 1)]), q.child(d, p.kinds[d])
        before, after, child = tables[d]
        # each child of u; with it each child of v, or only that of the same letter where no other can follow
        uu = np.arange(of_u.sum()) + np.repeat(p.start[d - 1].take(u) - (np.cumsum(of_u) - of_u), of_u)
        met = np.repeat(v * len(p.kinds[d]), of_u) + p.letter[d].take(uu)
        key = np.repeat(state.astype(np.intp) << width, of_u) | before.take(met)
        which = follows.take(key)
        one, any_ = np.flatnonzero(which == 1), np.flatnonzero(which == 2)
        vv = child.take(met[one])
        there = np.flatnonzero(vv >= 0)
        one, vv = one[there], vv[there].astype(np.intp)
        each = np.repeat(of_v, of_u)[any_]
        more = np.repeat(np.repeat(q.start[d - 1].take(v), of_u)[any_] - (np.cumsum(each) - each), each)
        more += np.arange(len(more))
        for uu, key, vv in ((uu[one], key[one], vv), (np.repeat(uu[any_], each), np.repeat(key[any_], each), more)):
            new = following.take(key | after.take(uu * len(q.kinds[d]) + q.letter[d].take(vv)))
            live = np.flatnonzero((new > 0) & (uu <= vv) if same else new > 0)
            if len(live):
                todo.append((d, uu[live], vv[live], new[live]))


def _halves(x: np.ndarray, y: np.ndarray, k: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same in parts whose tables are smaller."""
    cut = lambda rows: [(0, rows)] if len(rows) <= 256 else [(0, rows[: len(rows) // 2]), (len(rows) // 2, rows[len(rows) // 2 :])]
    for i, left in cut(x):
        for j, right in cut(y):
            if same and i > j:
                continue
            for u, v, distance in near(left, right, k, same and i == j):
                yield u + i, v + j, distance
