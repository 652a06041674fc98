"""Matching-block similarity of many pairs of texts at once, in numpy.

The ratio is twice the characters in matching blocks over all characters. Blocks are found by
taking the longest common run (the first of equals), then looking left and right of it. Every
place where two texts of a pair agree is a point, and knows how long the run is that ends in
it; all open stretches of a batch of pairs are searched together, and each search halves the
points. Where every character may start a run, runs of a few characters are searched first:
they have far fewer points than single characters, and of texts that are alike they leave only
short stretches open. As in the form that fixes the score, a character that makes up over one
hundredth of a second text of 200 characters or more starts no run, but a run may grow over it.
"""

from __future__ import annotations

import numpy as np

#: Characters of a batch of pairs, about (one pair may need more), and points held at once.
CHARACTERS, POINTS = 1 << 19, 1 << 21
#: Length from which frequent characters of the second text start no run, and their share.
LONG, SHARE = 200, 100
#: Characters that a run needs in the first search.
GRAM = 4


class _Side:
    """The texts of one side of a batch: characters by number, one text after the other."""

    def __init__(self, ids: np.ndarray, size: np.ndarray):
        self.ids, self.size = ids, size
        self.begin = np.cumsum(size) - size
        self.of = np.repeat(np.arange(len(size)), size)
        self.at = np.arange(len(ids)) - self.begin[self.of]

    def part(self, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> _Side:
        """Stretches of the texts as texts of their own."""
        size = high - low
        ends = np.cumsum(size)
        where = np.repeat(self.begin[of] + low - (ends - size), size) + np.arange(int(size.sum()))
        return _Side(self.ids[where], size)

    def texts(self, of: np.ndarray) -> _Side:
        """Some of the texts, in order; all of them as they are."""
        return self if len(of) == len(self.size) else self.part(of, np.zeros(len(of), np.int64), self.size[of])

    def grams(self, letters: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place of the last character, key) of every k characters that stand together; keys tell texts apart."""
        last = np.flatnonzero(self.at >= k - 1)
        key = self.of[last]
        for back in range(k - 1, -1, -1):
            key = key * letters + self.ids[last - back]
        return self.of[last], self.at[last], key


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where a sorted array has a new value."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _points(in_a: tuple[np.ndarray, ...], in_b: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """(pair, i, j, run): places where k characters that end there agree, in that order, and the length of the run that ends there; of places and keys as grams() gives them."""
    pair_a, at_a, key_a = in_a
    _, at_b, key_b = in_b
    order = np.argsort(key_b, kind="stable")
    key_b, at_b = key_b[order], at_b[order]
    first = _firsts(key_b)
    kinds, times = key_b[first], np.diff(np.append(first, len(key_b)))
    if not len(kinds):
        return (np.zeros(0, np.int64),) * 4
    which = np.minimum(np.searchsorted(kinds, key_a), len(kinds) - 1)
    met = np.flatnonzero(kinds[which] == key_a)
    which = which[met]
    many = times[which]
    ends = np.cumsum(many)
    j = at_b[np.repeat(first[which] - (ends - many), many) + np.arange(int(many.sum()))]
    pair, i = np.repeat(pair_a[met], many), np.repeat(at_a[met], many)
    line = np.argsort((pair << 40) + ((j - i) << 1), kind="stable")  # by diagonal, then by i
    p, d, x = pair[line], (j - i)[line], i[line]
    new = np.ones(len(line), bool)
    new[1:] = (p[1:] != p[:-1]) | (d[1:] != d[:-1]) | (x[1:] != x[:-1] + 1)
    begin = np.flatnonzero(new)
    run = np.empty(len(line), np.int64)
    run[line] = np.arange(len(line)) - np.repeat(begin, np.diff(np.append(begin, len(line)))) + k
    return pair, i, j, run


def _agree(a: _Side, b: _Side, at_a: np.ndarray, at_b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many characters agree from these places of the two arrays on, going by step, at most `most`."""
    out, todo, width = np.zeros(len(most), np.int64), np.flatnonzero(most > 0), 8
    while len(todo):
        go = np.arange(width)
        off = out[todo, None] + go
        inside = off < most[todo, None]
        off = np.where(inside, off, 0) * step
        good = inside & (a.ids[at_a[todo, None] + off] == b.ids[at_b[todo, None] + off])
        whole = good.all(1)
        out[todo] += np.where(whole, width, good.argmin(1))
        todo, width = todo[whole], min(width * 4, 512)
    return out


def _search(a: _Side, b: _Side, points: tuple[np.ndarray, ...], same: np.ndarray, least: int, grow: bool, pairs: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Adds the characters in matching blocks of at least `least` to `same`; gives the stretches (pair, bounds in a, bounds in b) that hold no such block.

    pairs are the ones searched, in order, by default all.
    """
    pair, i, j, run = points
    of = np.arange(len(same)) if pairs is None else pairs
    none = np.zeros(len(of), np.int64)
    la, ha, lb, hb = none, a.size[of], none, b.size[of]  # stretches; a point knows its stretch
    at = np.searchsorted(of, pair)
    rest = []
    while len(of):
        value = np.minimum(run, np.minimum(i - la[at], j - lb[at]) + 1)
        size = np.zeros(len(of), np.int64)
        first = _firsts(at)
        if len(first):
            size[at[first]] = np.maximum.reduceat(value, first)
        top = np.flatnonzero(value == size[at])
        top = top[_firsts(at[top])]
        start_a, start_b = la.copy(), lb.copy()
        start_a[at[top]], start_b[at[top]] = i[top] - size[at[top]] + 1, j[top] - size[at[top]] + 1
        if grow:  # also from the start of a stretch where no run was found
            x, y = a.begin[of] + start_a, b.begin[of] + start_b
            back = _agree(a, b, x - 1, y - 1, np.minimum(start_a - la, start_b - lb), -1)
            on = _agree(a, b, x + size, y + size, np.minimum(ha - start_a, hb - start_b) - size, 1)
            start_a, start_b, size = start_a - back, start_b - back, size + back + on
        found = size >= least
        size = np.where(found, size, 0)
        np.add.at(same, of, size)
        gone = np.flatnonzero(~found)
        rest.append(np.stack([of[gone], la[gone], ha[gone], lb[gone], hb[gone]]))
        left = found & (la < start_a) & (lb < start_b)
        right = found & (start_a + size < ha) & (start_b + size < hb)
        number = np.cumsum(np.stack([left, right], 1).ravel()).reshape(-1, 2) - 1
        goes_left = left[at] & (i < start_a[at]) & (j < start_b[at])
        goes_right = right[at] & (i >= (start_a + size)[at]) & (j >= (start_b + size)[at])
        then = np.where(goes_left, number[at, 0], number[at, 1])
        keep = np.flatnonzero(goes_left | goes_right)
        keep = keep[np.argsort(then[keep], kind="stable")]
        i, j, run, at = i[keep], j[keep], run[keep], then[keep]
        both = np.stack([left, right], 1).ravel()
        mix = lambda x, y: np.stack([x, y], 1).ravel()[both]
        of, la, ha, lb, hb = mix(of, of), mix(la, start_a + size), mix(start_a, ha), mix(lb, start_b + size), mix(start_b, hb)
    return tuple(np.concatenate(rest, 1)) if rest else (none[:0],) * 5


def _few_points(weight: np.ndarray, most: int):
    """Bounds of neighbours whose weights sum up to `most`, about."""
    total, k = np.cumsum(weight), 0
    while k < len(weight):
        end = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + most, "right")))
        yield k, end
        k = end


def _dense(a: _Side, b: _Side, letters: int) -> np.ndarray:
    """Characters in matching blocks where every character may start a run: long runs first, then what they leave open."""
    same, k = np.zeros(len(a.size), np.int64), GRAM
    while k > 1 and len(a.size) * letters**k >= 1 << 62:
        k -= 1
    of, la, ha, lb, hb = _search(a, b, _points(a.grams(letters, k), b.grams(letters, k), k), same, k, False)
    if k == 1:
        return same
    open_ = np.flatnonzero((la < ha) & (lb < hb))
    of, la, ha, lb, hb = (x[open_] for x in (of, la, ha, lb, hb))
    for x, y in _few_points(1 + (ha - la) * (hb - lb) // 4, POINTS):
        c, d = a.part(of[x:y], la[x:y], ha[x:y]), b.part(of[x:y], lb[x:y], hb[x:y])
        more = np.zeros(y - x, np.int64)
        _search(c, d, _points(c.grams(letters, 1), d.grams(letters, 1), 1), more, 1, False)
        np.add.at(same, of[x:y], more)
    return same


def _matched(a: _Side, b: _Side, letters: int, frequent: bool) -> np.ndarray:
    """Characters in matching blocks of each pair."""
    pairs = len(a.size)
    key_a, key_b = (x.of * letters + x.ids for x in (a, b))
    times = np.bincount(key_b, minlength=pairs * letters).reshape(pairs, letters)
    barred = (times > (b.size // SHARE + 1)[:, None]) & (b.size >= LONG)[:, None] if frequent else np.zeros(times.shape, bool)
    same, sparse = np.zeros(pairs, np.int64), barred.any(1)
    of = np.flatnonzero(~sparse)
    if len(of):
        same[of] = _dense(a.texts(of), b.texts(of), letters)
    if sparse.any():
        # places in texts with frequent characters where a run may start
        may = (~barred & sparse[:, None] & (times > 0)).ravel()
        starts = [(x.of[at], x.at[at], key[at]) for x, key in ((a, key_a), (b, key_b)) for at in [np.flatnonzero(may[key])]]
        meet = np.bincount(starts[0][0], times.ravel()[starts[0][2]], pairs)
        for x, y in _few_points(1 + meet, POINTS):
            c, d = ([v[slice(*np.searchsorted(side[0], (x, y)))] for v in side] for side in starts)
            _search(a, b, _points(c, d, 1), same, 1, True, x + np.flatnonzero(sparse[x:y]))
    return same


def ratios(first: list[str], second: list[str], frequent: bool = True) -> np.ndarray:
    """The ratio of each pair of texts; two empty texts have 1."""
    size_a, size_b = (np.array([len(t) for t in side], np.int64) for side in (first, second))
    same = np.zeros(len(first), np.int64)
    for x, y in _few_points(1 + size_a + size_b, CHARACTERS):
        codes = np.frombuffer("".join([*first[x:y], *second[x:y]]).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            continue
        there = np.zeros(int(codes.max()) + 1, bool)
        there[codes] = True
        ids, kinds = (np.cumsum(there) - 1)[codes], int(there.sum())
        cut = int(size_a[x:y].sum())
        a, b = _Side(ids[:cut], size_a[x:y]), _Side(ids[cut:], size_b[x:y])
        for u, v in _few_points(np.full(y - x, kinds), 1 << 22):  # a table of letters by pairs
            of = np.arange(u, v)
            same[x + of] = _matched(a.texts(of), b.texts(of), kinds, frequent)
    total = size_a + size_b
    return np.where(total > 0, 2.0 * same / np.maximum(total, 1), 1.0)
