"""A packing plan from a length histogram: the configuration linear program by multiplicative weights, then rounding.

Everything here works on counts per length, so its cost depends on the capacity and never on the number of pieces.
A configuration is a tuple of lengths, the longest first, that fit one sequence together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Ways to set prices, of which the plan with the fewest sequences stays: how often the whole program is walked, the steps in
#: which the served share of every length rises, knapsack programs at each step, how strongly a length that lags behind
#: gains in price, for the moment and for good, and the least value of a configuration as a share of the best.
SETTINGS = ((1, 12, 4, 0.5, 0.0, 0.0), (2, 20, 2, 0.0, 0.1, 0.9))
#: The share of a sequence that may stay free, raised when a program places less than ``PROGRESS`` of what is left.
FREE, PROGRESS = (0.0, 0.002, 0.02), 0.2


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total price within each room up to ``capacity``, any number of each length, and the length index that ends it (-1: a place left free).

    ``lengths`` ascend.
    """
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if k := fitting[room]:
            values = best[room - lengths[:k]] + prices[:k]
            top = int(values.argmax())
            if values[top] > best[room]:
                best[room], last[room] = values[top], top
    return best, last


def filled(lengths: np.ndarray, last: np.ndarray, room: int) -> Iterator[int]:
    """Length indexes of the best filling of ``room``."""
    while room > 0:
        i = int(last[room])
        if i < 0:
            room -= 1
        else:
            yield i
            room -= int(lengths[i])


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, setting: tuple) -> dict[tuple[int, ...], float]:
    """Configurations (of length indexes) and how often each is used, serving no length beyond its demand.

    Multiplicative weights: the price of a length is its size times a weight that rises exponentially with what its
    served share lacks of the level reached.  A length ahead of the level is out of the market until the level has risen.
    Each pass at a level prices configurations by one knapsack program: the best filling around each
    length is a candidate, the best values are used first, each as often as the level allows.
    """
    walks, levels, passes, sharpness, learning, near = setting
    learnt = np.zeros(len(lengths))
    for _ in range(walks):
        served, used = np.zeros(len(lengths)), {}
        for level, _ in np.ndindex(levels, passes):
            level = (level + 1) / levels
            open_ = np.flatnonzero(served < level * demand * (1 - 1e-9))
            if not open_.size:
                continue
            sizes, want = lengths[open_], level * demand[open_] - served[open_]
            prices = sizes / capacity * np.exp(sharpness * (want / demand[open_] * levels - 1) + learnt[open_] - learnt.max())
            best, last = knapsack(sizes, prices, capacity)
            value = prices + best[capacity - sizes]
            least = near * value.max() if level < 1 else 0.0
            for i in np.argsort(-value, kind="stable"):
                if value[i] < least:
                    break
                if want[i] <= 0:
                    continue
                column = [int(i), *filled(sizes, last, capacity - int(sizes[i]))]
                index, times = np.unique(column, return_counts=True)
                amount = float((want[index] / times).min())
                if amount > 0:
                    want[index] -= amount * times
                    key = tuple(sorted((int(open_[c]) for c in column), reverse=True))
                    used[key] = used.get(key, 0.0) + amount
            served[open_] = level * demand[open_] - want
            learnt += learning / passes * np.minimum((level - served / demand) * levels, 3)
    return used


def best_fit(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> dict[tuple[int, ...], int]:
    """Best fit by falling length, over groups of equally filled sequences instead of single ones."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        size, left = int(lengths[i]), int(demand[i])
        while left:
            room = min((r for r in open_ if r >= size), default=None)
            if room is None:
                each = min(capacity // size, left)
                group, take, rest = (i,) * each, left // each, capacity - each * size
            else:
                content, number = next(iter(open_[room].items()))
                each = min(room // size, max(1, left // number))
                take, rest, group = min(number, left // each), room - each * size, content + (i,) * each
                del open_[room][content]
                if number > take:
                    open_[room][content] = number - take
                if not open_[room]:
                    del open_[room]
            left -= each * take
            slot = open_.setdefault(rest, {})
            slot[group] = slot.get(group, 0) + take
    return {group: number for groups in open_.values() for group, number in groups.items()}


def rounded(lengths: np.ndarray, demand: np.ndarray, capacity: int, setting: tuple) -> dict[tuple[int, ...], int]:
    """Whole numbers of configurations that serve exactly the demand.

    The linear program's amounts are rounded down, fullest configurations only, and the program is solved again for
    the pieces that are left.  When that places little more, full ones are no longer insisted on, step by step; best fit takes
    what then remains, a number of pieces bounded by the configurations.
    """
    left, plans = demand.astype(np.int64).copy(), {}

    def take(column: tuple[int, ...], number: int) -> None:
        plans[column] = plans.get(column, 0) + number

    for free in FREE:
        while (some := np.flatnonzero(left)).size:
            sizes, before, placed = lengths[some], left[some], 0
            for column, amount in fractional(sizes, before, capacity, setting).items():
                index, times = np.unique(column, return_counts=True)
                number = min(int(amount), int((left[some[index]] // times).min()))
                total = int((sizes[index] * times).sum())
                if number and capacity - total <= free * capacity:
                    left[some[index]] -= number * times
                    placed += number * total
                    take(tuple(int(sizes[i]) for i in column), number)
            if placed < PROGRESS * int((sizes * before).sum()):
                break
    for column, number in best_fit(lengths, left, capacity).items():
        take(tuple(int(lengths[i]) for i in column), number)
    return plans


def plan(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(configuration of lengths, number of sequences): together exactly ``demand`` pieces of each of ``lengths`` (ascending)."""
    plans = (rounded(lengths, demand, capacity, s) for s in SETTINGS)
    return sorted(min(plans, key=lambda p: sum(p.values())).items(), reverse=True)
