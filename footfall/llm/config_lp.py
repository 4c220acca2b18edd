"""The configuration linear program of bin packing, on a histogram of lengths.

A configuration says how many items of each length fill one bin.  The program asks for the
fewest bins, in fractions, that cover the histogram:

    min sum x_C   with   sum x_C copies_C(l) >= count(l)   for every length l

It is solved by multiplicative weights.  Every length has a weight that shrinks exponentially
with how far it is covered; a weight per item is a price; the knapsack, by dynamic
programming, finds the configurations that are worth most at these prices, and they are used a
little.  Prices over the knapsack's value are a solution of the dual program, so every round
also gives a lower bound for the bins of *any* packing.  The averaged configurations are
rounded to whole bins, and what is left goes best-fit decreasing into their free room and new
bins.  The histogram has at most ``capacity`` entries, whatever the number of items.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

ROUNDS = 250
GAP = 0.002
# By which factor a length's weight shrinks at most in a round is exp(-rate): RATE at first, and
# less and less from about round COOLING on.  Configurations worth less than the best by up to
# SLACK are used as well.
RATE, COOLING, SLACK = 0.3, 30, 0.005
CHECK_EVERY = 20


@dataclass(frozen=True)
class Configuration:
    """``bins`` bins that each hold ``copies`` items of every length."""

    copies: dict[int, int]
    bins: int


@dataclass(frozen=True)
class Cover:
    """A fractional cover: bins of each configuration (pairs of length and copies), their sum
    ``value``, and ``bound``, below which no packing can be."""

    amounts: dict[tuple[tuple[int, int], ...], float]
    value: float
    bound: float


@dataclass(frozen=True)
class Packing:
    """Whole bins that hold exactly the items, and the dual bound for their number."""

    configurations: list[Configuration]
    bound: int

    @property
    def bins(self) -> int:
        return sum(c.bins for c in self.configurations)


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The most that every room is worth, and the length to take first (0: leave one free).

    ``prices[l - 1]`` is the price of length l, -inf if there is none.
    """
    value = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, dtype=np.int64)
    backwards = np.zeros(capacity + 1)  # values again, from the right, so that slices are plain
    for room in range(1, capacity + 1):
        offers = backwards[capacity + 1 - room :] + prices[:room]
        best = int(offers.argmax())
        if offers[best] > value[room - 1]:
            value[room], choice[room] = offers[best], best + 1
        else:
            value[room] = value[room - 1]
        backwards[capacity - room] = value[room]
    return value, choice


def _filled(first: int, choice: np.ndarray, capacity: int) -> tuple[tuple[int, int], ...]:
    copies = {first: 1}
    room = capacity - first
    while room:
        length = int(choice[room])
        if length:
            copies[length] = copies.get(length, 0) + 1
        room -= max(length, 1)
    return tuple(sorted(copies.items(), reverse=True))


def solve_program(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, gap: float = GAP) -> Cover:
    """A cover within ``gap`` of the best, or what ``rounds`` rounds of weights give.

    Weights begin at the lengths' share of all there is to pack, as prices in proportion to
    length are never far off.  Amounts are averaged over the later half of the rounds.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[int(l)] for l in lengths], dtype=np.float64)
    if not len(lengths):
        return Cover({}, 0.0, 0.0)
    log_weights = np.log(counts * lengths)
    place = {int(l): i for i, l in enumerate(lengths)}
    history: list[tuple[dict, np.ndarray]] = []
    best = Cover({}, math.inf, 0.0)
    for number in range(1, rounds + 1):
        weights = np.exp(log_weights - log_weights.max())
        prices = np.full(capacity, -np.inf)
        prices[lengths - 1] = weights / counts
        value, choice = knapsack(prices, capacity)
        bound = max(best.bound, float(weights.sum() / value[capacity]))
        worth = prices[lengths - 1] + value[capacity - lengths]
        used: dict[tuple, float] = {}
        gain = np.zeros(len(lengths))
        for length in lengths[worth >= (1 - SLACK) * value[capacity]]:
            filled = _filled(int(length), choice, capacity)
            if filled not in used:
                used[filled] = min(counts[place[l]] / n for l, n in filled)
                for l, n in filled:
                    gain[place[l]] += used[filled] * n / counts[place[l]]
        scale = 1 / gain.max()
        gain *= scale
        log_weights -= RATE / (1 + number / COOLING) * gain
        history.append(({c: a * scale for c, a in used.items()}, gain))
        best = Cover(best.amounts, best.value, bound)
        if number % CHECK_EVERY == 0 or number == rounds:
            late = history[len(history) // 2 :]
            whole = sum(g for _, g in late)
            if whole.min() > 0:
                total = sum(a for u, _ in late for a in u.values()) / whole.min()
                if total < best.value:
                    amounts: dict[tuple, float] = {}
                    for u, _ in late:
                        for c, a in u.items():
                            amounts[c] = amounts.get(c, 0.0) + a / whole.min()
                    best = Cover(amounts, total, bound)
            if best.value <= (1 + gap) * best.bound:
                break
    return best


class _Bins:
    """Bins in groups of equal content, to be filled best-fit."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, dict[tuple, int]] = {}

    def add(self, copies: tuple, bins: int) -> None:
        room = self.capacity - sum(l * n for l, n in copies)
        group = self.by_room.setdefault(room, {})
        group[copies] = group.get(copies, 0) + bins

    def put(self, length: int, items: int) -> None:
        """Each item goes where the least room is left that it fits into.

        After that the same bin has less room, so it is filled as far as it goes.
        """
        for room in sorted(r for r in self.by_room if r >= length):
            each = room // length
            group = self.by_room[room]
            for copies in list(group):
                if not items:
                    return
                full = min(group[copies], items // each)
                rest = items - full * each if full < group[copies] else 0
                moved = full + (rest > 0)
                group[copies] -= moved
                if not group[copies]:
                    del group[copies]
                if full:
                    self.add((*copies, (length, each)), full)
                if rest:
                    self.add((*copies, (length, rest)), 1)
                items -= full * each + rest
            if not group:
                del self.by_room[room]
        each = self.capacity // length
        if items // each:
            self.add(((length, each),), items // each)
        if items % each:
            self.add(((length, items % each),), 1)

    def configurations(self) -> list[Configuration]:
        found = []
        for group in self.by_room.values():
            for copies, bins in group.items():
                merged: dict[int, int] = {}
                for length, n in copies:
                    merged[length] = merged.get(length, 0) + n
                found.append(Configuration(merged, bins))
        return found

    def count(self) -> int:
        return sum(sum(g.values()) for g in self.by_room.values())


def best_fit_decreasing(histogram: dict[int, int], capacity: int, bins: _Bins | None = None) -> _Bins:
    bins = bins or _Bins(capacity)
    for length in sorted(histogram, reverse=True):
        if histogram[length]:
            bins.put(length, histogram[length])
    return bins


def _rounded(cover: Cover, histogram: dict[int, int], capacity: int) -> _Bins:
    """Whole bins of the cover's configurations, as far as the items reach, then best fit.

    Fractions are carried from one configuration to the next, so that together they make as
    many bins as the cover has.
    """
    left = dict(histogram)
    bins = _Bins(capacity)
    carry = 0.0
    for copies, amount in sorted(cover.amounts.items(), key=lambda x: (-x[1], x[0])):
        carry += amount
        whole = min(int(carry + 1e-9), *(left[l] // n for l, n in copies))
        if whole:
            bins.add(copies, whole)
            for l, n in copies:
                left[l] -= n * whole
        carry = min(carry - whole, 1.0)
    return best_fit_decreasing(left, capacity, bins)


def solve(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, gap: float = GAP) -> Packing:
    """Bins that hold exactly the items of ``histogram`` (length to count).

    Never more than best-fit decreasing needs: where rounding loses more, that is taken.
    """
    for length in histogram:
        if not 1 <= length <= capacity:
            raise ValueError(f"a length of {length} does not fit")
    items = {int(l): int(n) for l, n in histogram.items() if n}
    alone = {l: items.pop(l) for l in list(items) if l == capacity}
    cover = solve_program(items, capacity, rounds, gap)
    found = min((_rounded(cover, items, capacity), best_fit_decreasing(items, capacity)), key=_Bins.count)
    full = [Configuration({l: 1}, n) for l, n in alone.items()]
    bound = math.ceil(cover.bound - 1e-6) + sum(alone.values())
    return Packing([*full, *found.configurations()], bound)
