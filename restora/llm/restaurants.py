"""Chinese-restaurant seating of a tree of byte contexts (hierarchical Pitman-Yor), on arrays of one task.

A gram is up to eight bytes in a number: the lowest is a symbol, the next its preceding byte, and so on.
Level k holds grams of a symbol and k context bytes; a context is a restaurant, a symbol a dish, and a
context's parent is the context without its earliest byte.  Customers of a level are the tables of the
level above it (and the counts of the corpus at the top level).

The state kept for every dish of a restaurant is its customers c and at which of them a new table was
opened; the first customer always opens one.  A Gibbs sweep removes all customers of a dish and seats
them one after another again: with s seated at t tables the next opens one with odds a = (strength +
discount (T + t)) p to s - discount t, where T counts the restaurant's other tables and p is the parent's
probability.  How many sit down before that happens is drawn at once: it is geometric with a success rate
drawn from Beta(a, s - discount t), exactly.  Seating one after another ignores how likely later
customers' dish becomes, so the new seating is accepted by Metropolis-Hastings with the ratio of the
products of (a + s - discount t) over customers.  Dishes of a restaurant are reseated in two turns, each
turn's at the same time.  When a level's customers change, the last ones leave, or new ones sit down.
"""

from __future__ import annotations

import numpy as np


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for positive x, by Stirling's series at x + 8."""
    product = x.copy()
    for k in range(1, 8):
        product *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y - np.log(product)


def opened(rng: np.random.Generator, seated: np.ndarray, tables: np.ndarray, goal: np.ndarray, p: np.ndarray, other: np.ndarray, discount: float, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """(item, customer) of every table opened while customers seated..goal-1 sit down; by item, then customer."""
    at = np.flatnonzero(seated < goal)
    s, t = seated[at].astype(float), tables[at].astype(float)
    items, places = [], []
    while len(at):
        a = (strength + discount * (other[at] + t)) * p[at]
        rate = rng.beta(a, s - discount * t)
        with np.errstate(divide="ignore"):
            wait = np.floor(-rng.standard_exponential(len(at)) / np.log1p(-rate))
        s += wait
        on = s < goal[at]  # also false where the rate is next to 0 and nobody opens a table
        at, s, t = at[on], s[on], t[on]
        items.append(at)
        places.append(s.astype(np.int64))
        s, t = s + 1, t + 1
        more = s < goal[at]
        at, s, t = at[more], s[more], t[more]
    if not items:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    item, place = np.concatenate(items), np.concatenate(places)
    order = np.argsort(item, kind="stable")
    return item[order], place[order]


def log_weights(many: int, item: np.ndarray, place: np.ndarray, goal: np.ndarray, p: np.ndarray, other: np.ndarray, discount: float, strength: float) -> np.ndarray:
    """Sum over customers 1..goal-1 of the log of (a + s - discount t), for each of `many` items with tables opened at (item, place)."""
    opened_ = np.bincount(item, minlength=many)
    segments = opened_ + 1
    first = np.cumsum(segments) - segments
    owner = np.repeat(np.arange(many), segments)
    tables = np.arange(len(owner)) - first[owner] + 1.0
    begin, end = np.ones(len(owner)), np.empty(len(owner))
    inner = np.ones(len(owner), dtype=bool)
    inner[first] = False
    begin[inner] = place + 1
    last = np.zeros(len(owner), dtype=bool)
    last[first + opened_] = True
    end[~last], end[last] = place + 1, goal
    shift = (strength + discount * (other[owner] + tables)) * p[owner] - discount * tables
    return np.bincount(owner, weights=log_gamma(shift + end) - log_gamma(shift + begin), minlength=many)


class Level:
    """Grams of one level, sorted, and their seating."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        context = grams >> np.uint64(8)
        new = np.r_[True, context[1:] != context[:-1]] if len(grams) else np.zeros(0, bool)
        self.house = np.cumsum(new) - 1
        self.houses = int(new.sum())
        begin = np.flatnonzero(new)
        self.turn = (np.arange(len(grams)) - begin[self.house]) % 2 if len(grams) else self.house
        self.c = np.zeros(len(grams), dtype=np.int64)
        self.item, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.discount = 0.5

    def tables(self) -> np.ndarray:
        return (self.c > 0) + np.bincount(self.item, minlength=len(self.grams))

    def admit(self, c: np.ndarray, p: np.ndarray, rng: np.random.Generator, strength: float) -> None:
        """Customers are c from now on."""
        old, self.c = self.c, c
        stay = self.place < c[self.item]
        self.item, self.place = self.item[stay], self.place[stay]
        grown = np.flatnonzero((old > 0) & (c > old))
        if len(grown):
            t = self.tables()
            other = np.bincount(self.house, weights=t, minlength=self.houses)[self.house] - t
            item, place = opened(rng, old[grown], t[grown], c[grown], p[grown], other[grown], self.discount, strength)
            self._merge(self.item, self.place, grown[item], place)

    def _merge(self, item: np.ndarray, place: np.ndarray, more: np.ndarray, places: np.ndarray) -> None:
        item, place = np.r_[item, more], np.r_[place, places]
        order = np.argsort(item, kind="stable")  # a dish's later tables come later
        self.item, self.place = item[order], place[order]

    def reseat(self, p: np.ndarray, rng: np.random.Generator, strength: float) -> None:
        """One Gibbs sweep over the dishes of two customers or more."""
        for turn in (0, 1):
            pick = np.flatnonzero((self.c > 1) & (self.turn == turn))
            if not len(pick):
                continue
            t = self.tables()
            other = (np.bincount(self.house, weights=t, minlength=self.houses)[self.house] - t)[pick]
            goal, base, n = self.c[pick], p[pick], len(pick)
            item, place = opened(rng, np.ones(n), np.ones(n), goal, base, other, self.discount, strength)
            number = np.full(len(self.grams), -1, dtype=np.int64)
            number[pick] = np.arange(n)
            own = number[self.item]
            mine = own >= 0
            # weights differ only where one of the two seatings has a second table
            some = np.zeros(n, dtype=bool)
            some[item] = some[own[mine]] = True
            which = np.flatnonzero(some)
            small = np.cumsum(some) - 1
            args = goal[which], base[which], other[which], self.discount, strength
            new = log_weights(len(which), small[item], place, *args)
            old = log_weights(len(which), small[own[mine]], self.place[mine], *args)
            taken = np.ones(n, dtype=bool)
            taken[which] = -rng.standard_exponential(len(which)) < new - old
            keep = ~mine
            keep[mine] = ~taken[own[mine]]
            use = taken[item]
            self._merge(self.item[keep], self.place[keep], pick[item[use]], place[use])

    def predictive(self, p: np.ndarray, strength: float) -> np.ndarray:
        """The probability of each gram's symbol after its context, given the parent's p."""
        t = self.tables()
        whole = np.bincount(self.house, weights=t, minlength=self.houses)[self.house]
        served = np.bincount(self.house, weights=self.c, minlength=self.houses)[self.house]
        return (self.c - self.discount * t + (strength + self.discount * whole) * p) / (strength + served)

    def counted(self) -> tuple[int, int]:
        """Dishes of one and of two customers."""
        return int((self.c == 1).sum()), int((self.c == 2).sum())


def discount_of(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))


class Tree:
    """Levels root..top over the grams (sorted, unique, of level top) with counts; base is the probability of each gram's symbol at level root - 1."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, top: int, root: int, rng: np.random.Generator, strength: float):
        self.root, self.top, self.rng, self.strength = root, top, rng, strength
        self.levels, self.parent = {top: Level(grams)}, {}
        for k in range(top - 1, root - 1, -1):
            short, self.parent[k + 1] = np.unique(self.levels[k + 1].grams & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            self.levels[k] = Level(short)
        self.counts = counts.astype(np.int64)
        for k in range(top, root - 1, -1):
            self.levels[k].c = self._arriving(k)
            self.levels[k].discount = discount_of(*self.levels[k].counted())

    def _arriving(self, k: int) -> np.ndarray:
        if k == self.top:
            return self.counts
        return np.bincount(self.parent[k + 1], weights=self.levels[k + 1].tables(), minlength=len(self.levels[k].grams)).astype(np.int64)

    def root_grams(self) -> np.ndarray:
        """Each root gram without its earliest context byte."""
        return self.levels[self.root].grams & np.uint64((1 << 8 * self.root) - 1)

    def descend(self, base: np.ndarray) -> None:
        """Parents' probabilities of all levels, from the root's."""
        self.p = {self.root: base}
        for k in range(self.root, self.top):
            self.p[k + 1] = self.levels[k].predictive(self.p[k], self.strength)[self.parent[k + 1]]

    def sweep(self, base: np.ndarray) -> None:
        self.descend(base)
        for k in range(self.top, self.root - 1, -1):
            if k < self.top:
                self.levels[k].admit(self._arriving(k), self.p[k], self.rng, self.strength)
            self.levels[k].reseat(self.p[k], self.rng, self.strength)

    def predictive(self, base: np.ndarray) -> np.ndarray:
        self.descend(base)
        return self.levels[self.top].predictive(self.p[self.top], self.strength)
