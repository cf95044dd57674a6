"""Ratcliff-Obershelp similarity of many pairs of texts at once, in numpy.

The ratio is twice the letters that match over the letters of both texts: the longest common block (of equals the
first in the left text, then in the right), and so on in what lies left and right of it. All pairs of a batch take each
step together: one sweep over the left texts finds the longest block of every open stretch.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: From this length of the right text on, the standard library leaves out popular letters; from the second on, texts go through it one by one.
POPULAR, HUGE = 200, 4_000
#: Letters of the right sides of one sweep, about; classes of letters for bounds; pairs of a step.
WIDTH, CLASSES, STEP = 1 << 16, 64, 8_192
#: Words of bits of the longest right text whose letters are compared in order for bounds.
WORDS = 4
#: Numbers of a letter that bounds tell apart: all up to 16, then each a quarter above the one before.
LEVELS = np.unique(np.concatenate([np.arange(1, 17), np.ceil(16 * 1.25 ** np.arange(1, 90))])).astype(np.int64)


class Texts:
    """Distinct texts as one row of letters each, and the place of each given text among them."""

    def __init__(self, texts: list[str]):
        place: dict[str, int] = {}
        self.place = np.array([place.setdefault(x, len(place)) for x in texts], np.int64)
        self.known = list(place)
        self.length = np.array([len(x) for x in self.known], np.int64)
        self.letters = np.frombuffer("".join(self.known).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.start = np.cumsum(self.length) - self.length

    def rows(self, of: np.ndarray) -> np.ndarray:
        """Letters of the texts `of` as a matrix, zeros at the end."""
        length = self.length[of]
        out = np.zeros((len(of), length.max(initial=0)), self.letters.dtype)
        inside = np.arange(out.shape[1]) < length[:, None]
        out[inside] = self.letters[np.repeat(self.start[of] - (np.cumsum(length) - length), length) + np.arange(length.sum())]
        return out

    def bags(self) -> np.ndarray:
        """Number of letters of each class, text by text."""
        out = np.zeros((len(self.known), CLASSES), np.int32)
        np.add.at(out, (np.repeat(np.arange(len(self.known)), self.length), self.letters % CLASSES), 1)
        return out


def _joined(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places where a rare letter of the right text stands in both, in order: pair, place in the left text, place in the right one, and letters of the run of such places that ends there.

    Rare letters are those that the standard library does not leave out as popular.
    """
    of, pair_b = np.unique(j, return_inverse=True)
    text = np.repeat(np.arange(len(of)), b.length[of])
    place = np.arange(len(text)) - np.repeat(np.cumsum(b.length[of]) - b.length[of], b.length[of])
    letter = b.letters[b.start[of][text] + place].astype(np.int64)
    _, kind, often = np.unique(text << 32 | letter, return_inverse=True, return_counts=True)
    rare = np.flatnonzero(often[kind] <= b.length[of][text] // 100 + 1)
    text, place, letter = text[rare], place[rare], letter[rare]
    start, count = np.searchsorted(text, np.arange(len(of))), np.bincount(text, minlength=len(of))

    def each(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(count)), count)
        return row, np.arange(len(row)) - (np.cumsum(count) - count - start)[row]

    pair, at = each(start[pair_b], count[pair_b])
    mine, pair_a = np.unique(i, return_inverse=True)
    owner = np.repeat(np.arange(len(mine)), a.length[mine])
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(a.length[mine]) - a.length[mine], a.length[mine])
    key = owner << 32 | a.letters[a.start[mine][owner] + inside].astype(np.int64)
    order = np.argsort(key, kind="stable")
    asked = pair_a[pair] << 32 | letter[at]
    low, high = np.searchsorted(key[order], asked), np.searchsorted(key[order], asked, "right")
    row, found = each(low, high - low)
    pair, x, y = pair[row], inside[order[found]], place[at[row]]
    key = (pair * HUGE + x) * HUGE + y
    order = np.argsort(key, kind="stable")
    pair, x, y, key = pair[order], x[order], y[order], key[order]
    before = np.minimum(np.searchsorted(key, key - HUGE - 1), max(len(key) - 1, 0))
    before = np.where((x > 0) & (y > 0) & (key[before] == key - HUGE - 1), before, -1) if len(key) else before
    run, on, last = np.ones(len(key), np.int64), np.flatnonzero(before >= 0), before[before >= 0]
    while len(on):
        run[on] += 1
        last = before[last]
        on, last = on[last >= 0], last[last >= 0]
    return pair, x, y, run


def _matched_rare(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> np.ndarray:
    """As _matched, for right texts of POPULAR letters and more: a block starts from rare letters, or else where both stretches begin, and goes on as far as letters are equal."""
    la, lb = a.length[i], b.length[j]
    total = np.zeros(len(i), np.int64)
    of, x, y, run = _joined(a, b, i, j)
    pair, al, ah, bl, bh = np.arange(len(i)), np.zeros(len(i), np.int64), la, np.zeros(len(i), np.int64), lb
    while len(pair):
        size, at, to = np.zeros(len(pair), np.int64), al.copy(), bl.copy()
        length = np.minimum(run, np.minimum(x - al[of], y - bl[of]) + 1)
        order = np.lexsort((y, x, -length, of))
        first = order[np.flatnonzero(np.append(True, np.diff(of[order]) > 0))] if len(order) else order
        best = of[first]
        size[best], at[best], to[best] = length[first], x[first] - length[first] + 1, y[first] - length[first] + 1
        p, q = a.start[i[pair]], b.start[j[pair]]
        on = np.flatnonzero((at > al) & (to > bl))
        while len(on := on[(at[on] > al[on]) & (to[on] > bl[on])]):
            on = on[a.letters[p[on] + at[on] - 1] == b.letters[q[on] + to[on] - 1]]
            at[on], to[on], size[on] = at[on] - 1, to[on] - 1, size[on] + 1
        on = np.arange(len(pair))
        while len(on := on[(at[on] + size[on] < ah[on]) & (to[on] + size[on] < bh[on])]):
            on = on[a.letters[p[on] + at[on] + size[on]] == b.letters[q[on] + to[on] + size[on]]]
            size[on] += 1
        np.add.at(total, pair, size)
        # what lies left and right of the blocks, and the places there
        parts = [(al, at, bl, to), (at + size, ah, to + size, bh)]
        open_ = [(size > 0) & (n[0] < n[1]) & (n[2] < n[3]) for n in parts]
        most = sum(np.bincount(pair[o], np.minimum(n[1] - n[0], n[3] - n[2])[o], len(i)) for n, o in zip(parts, open_, strict=True))
        alive = (2.0 * (total + most) / (la + lb) >= least)[pair]
        rows, places, n = [], [], 0
        for (lo, hi, lo_b, hi_b), o in zip(parts, open_, strict=True):
            o = o & alive
            number = np.cumsum(o) - 1 + n
            inside = o[of] & (x >= lo[of]) & (x < hi[of]) & (y >= lo_b[of]) & (y < hi_b[of])
            places.append((number[of[inside]], x[inside], y[inside], run[inside]))
            rows.append((pair[o], lo[o], hi[o], lo_b[o], hi_b[o]))
            n += int(o.sum())
        pair, al, ah, bl, bh = (np.concatenate(c) for c in zip(*rows, strict=True))
        of, x, y, run = (np.concatenate(c) for c in zip(*places, strict=True))
    return total


class Both:
    """Left and right texts, whose letters are numbered from 2 on, in as few bytes as do."""

    def __init__(self, left: list[str], right: list[str]):
        self.a, self.b = Texts(left), Texts(right)
        self.bag_a, self.bag_b, self.masks = self.a.bags(), self.b.bags(), None
        place = {x: n for n, x in enumerate(self.a.known)}
        #: The left text that is equal to each right one, or none (-1).
        self.equal = np.array([place.get(x, -1) for x in self.b.known], np.int64)
        there = np.zeros(0x110000, bool)
        there[self.a.letters] = there[self.b.letters] = True
        known = np.flatnonzero(there)
        number = np.zeros(len(there), np.uint8 if len(known) < 250 else np.uint16 if len(known) < 65_000 else np.uint32)
        number[known] = np.arange(2, len(known) + 2)
        self.a.letters, self.b.letters = number[self.a.letters], number[self.b.letters]

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Twice the letters that the left texts i and the right texts j have in common, in whatever order, over the letters of both: no ratio is higher."""
        out = np.zeros(len(i))
        for low in range(0, len(i), 10_000):
            x, y = i[low : low + 10_000], j[low : low + 10_000]
            out[low : low + 10_000] = 2.0 * np.minimum(self.bag_a[x], self.bag_b[y]).sum(1) / np.maximum(self.a.length[x] + self.b.length[y], 1)
        return out

    def ordered(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """As shared, of letters in one order (their longest common subsequence) where the right text has at most 256: no ratio is higher."""
        words = -(-self.b.length // 64)
        if self.masks is None:
            # bits of the places where a right text has each class of letters
            wide = np.where(words <= WORDS, words, 0)
            self.first = np.cumsum(wide) - wide
            self.masks = np.zeros((int(wide.sum()), CLASSES + 1), np.uint64)
            text = np.repeat(np.arange(len(self.b.known)), self.b.length)
            place = np.arange(len(text)) - np.repeat(self.b.start, self.b.length)
            told = wide[text] > 0
            text, place, letter = text[told], place[told], self.b.letters[told].astype(np.int64) % CLASSES
            np.bitwise_or.at(self.masks, (self.first[text] + place // 64, letter), np.uint64(1) << (place % 64).astype(np.uint64))
        out = np.ones(len(i))
        la, lb, words = self.a.length[i], self.b.length[j], words[j]
        for wide in range(1, WORDS + 1):
            todo = np.flatnonzero((words == wide) & (la < HUGE))
            todo = todo[np.argsort(-la[todo], kind="stable")]
            for low in range(0, len(todo), 1 << 14):
                some = todo[low : low + (1 << 14)]
                start, row, length = self.a.start[i[some]], self.first[j[some]], la[some]
                state = np.full((wide, len(some)), ~np.uint64(0))
                for step in range(int(length.max(initial=0))):
                    n = int(np.searchsorted(-length, -step))  # texts that go on
                    letter, over = self.a.letters[start[:n] + step].astype(np.int64) % CLASSES, None
                    for w in range(wide):
                        now = state[w, :n]
                        hit = now & self.masks[row[:n] + w, letter]
                        up = now + hit
                        if wide > 1:
                            carry = up < now
                            if over is not None:
                                up += over
                                carry |= up < over
                            over = carry.astype(np.uint64)
                        state[w, :n] = up | (now ^ hit)
                out[some] = 2.0 * np.bitwise_count(~state).sum(0, dtype=np.int64) / np.maximum(length + lb[some], 1)
        return out

    def ratios(self, i: np.ndarray, j: np.ndarray, least: float | np.ndarray = 0.0) -> np.ndarray:
        """The ratio of the left texts i and the right texts j, as ratios gives it; `least` is one number, or one for each pair."""
        pairs, back = np.unique(i * len(self.b.known) + j, return_inverse=True)
        asked = np.full(len(pairs), np.inf)
        np.minimum.at(asked, back, least)
        i, j = pairs // max(len(self.b.known), 1), pairs % max(len(self.b.known), 1)
        a, b, la, lb = self.a, self.b, self.a.length[i], self.b.length[j]
        out = np.where((la == 0) | (lb == 0), np.nan, 0.0)
        todo = np.flatnonzero((la > 0) & (lb > 0) & (2 * np.minimum(la, lb) >= asked * (la + lb)))
        if np.any(least):
            todo = todo[self.shared(i[todo], j[todo]) >= asked[todo]]
        same = np.array([a.known[i[k]] == b.known[j[k]] for k in todo], bool)
        out[todo[same]] = 1.0
        todo = todo[~same]
        huge = (lb[todo] >= POPULAR) & ((lb[todo] >= HUGE) | (la[todo] >= HUGE)) | (la[todo] >= HUGE)
        long, matcher, last = todo[huge], SequenceMatcher(None), -1
        for k in long[np.argsort(j[long], kind="stable")]:  # what the matcher prepares for a right text serves all its pairs
            if j[k] != last:
                last = j[k]
                matcher.set_seq2(b.known[last])
            matcher.set_seq1(a.known[i[k]])
            out[k] = matcher.ratio()
        todo = todo[~huge]
        popular = lb[todo] >= POPULAR
        for rest, weight in ((todo[~popular], None), (todo[popular], la * lb // 2_500 + 1)):
            rest = rest[np.argsort(la[rest] * lb[rest], kind="stable")]
            load = np.arange(1, len(rest) + 1) if weight is None else np.cumsum(weight[rest])
            for some in np.split(rest, np.searchsorted(load, np.arange(STEP, load[-1], STEP), "right") if len(rest) else []):
                if not len(some):
                    continue
                if weight is None:
                    match = _matched(a.rows(i[some]), b.rows(j[some]), la[some], lb[some], asked[some])
                else:
                    match = _matched_rare(a, b, i[some], j[some], asked[some])
                out[some] = 2.0 * match / (la[some] + lb[some])
        return out[back]


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters that each bag of a has in common with each of b, or some more where a letter is often there: a matrix."""
    most = np.minimum(a.max(0, initial=0), b.max(0, initial=0))
    letter, level = np.nonzero(LEVELS <= most[:, None])
    # a step of levels counts whole as soon as it is reached, half on either side of the product
    weight = np.sqrt(np.diff(LEVELS)[level]).astype(np.float32)
    reached = lambda x: (x[:, letter] >= LEVELS[level]) * weight
    return reached(a) @ reached(b).T


def _longest(a: np.ndarray, b: np.ndarray, al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and places of the longest common block of a[al:ah] and b[bl:bh], row by row."""
    # letters by place, so that each operation runs along all pairs
    columns = bl + np.arange((bh - bl).max())[:, None]
    rows = np.arange(len(al))
    right = np.where(columns < bh, b[rows, np.minimum(columns, b.shape[1] - 1)], b.dtype.type(1))
    run = np.zeros((right.shape[0] + 1, len(al)), np.uint8 if right.shape[0] < 250 else np.uint16)
    size, at, to = (np.zeros(len(al), np.int64) for _ in range(3))
    for step in range((ah - al).max()):
        letter = np.where(al + step < ah, a[rows, np.minimum(al + step, a.shape[1] - 1)], a.dtype.type(0))
        longer = run[:-1] + run.dtype.type(1)
        longer *= right == letter
        run[1:] = longer
        new = np.flatnonzero(longer.max(0) > size)
        if len(new):
            end = longer[:, new].argmax(0) + 1
            found = longer[end - 1, new].astype(np.int64)
            size[new], at[new], to[new] = found, (al[new] + step + 1 - found), bl[new] + end - found
    return size, at, to


def _matched(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Letters that match, row by row of two matrices of letters of lengths la and lb, or fewer where what is open can't reach the ratio `least`."""
    total, none = np.zeros(len(la), np.int64), np.zeros(len(la), np.int64)
    open_ = np.stack([np.arange(len(la)), none, la, none, lb], 1)
    while len(open_):
        # stretches of like sizes together, so that little is filled up
        high, wide = (open_[:, 2] - open_[:, 1] + 3) // 4, open_[:, 4] - open_[:, 3]
        order, rest = np.lexsort((wide, high)), []
        open_, letters = open_[order], np.cumsum(wide[order])
        bounds = np.searchsorted(letters, np.arange(1, letters[-1] // WIDTH + 1) * WIDTH)
        for part in np.split(open_, bounds):
            if len(part):
                row, al, ah, bl, bh = part.T
                size, at, to = _longest(a[row], b[row], al, ah, bl, bh)
                np.add.at(total, row, size)
                rest += [np.stack([row, al, at, bl, to], 1)[size > 0], np.stack([row, at + size, ah, to + size, bh], 1)[size > 0]]
        open_ = np.concatenate(rest)
        open_ = open_[(open_[:, 1] < open_[:, 2]) & (open_[:, 3] < open_[:, 4])]
        most = np.bincount(open_[:, 0], np.minimum(open_[:, 2] - open_[:, 1], open_[:, 4] - open_[:, 3]), len(la))
        open_ = open_[(2.0 * (total + most) / (la + lb) >= least)[open_[:, 0]]]
    return total


def bounds(left: list[str], right: list[str]) -> np.ndarray:
    """A number that the ratio of each two texts can't exceed; NaN where one is empty."""
    x = Both(left, right)
    i, j = x.a.place, x.b.place
    return np.where((x.a.length[i] == 0) | (x.b.length[j] == 0), np.nan, x.shared(i, j))


def ratios(left: list[str], right: list[str], least: float = 0.0) -> np.ndarray:
    """The ratio of each two texts; NaN where one is empty. Below `least` any lower number may stand in its place.

    Letters that both texts have bound what can match: with `least`, pairs that don't reach it so are not compared.
    """
    x = Both(left, right)
    return x.ratios(x.a.place, x.b.place, least)
