"""Bin completion on counts of lengths: which fillings, and how many sequences of each, hold all pieces."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import combinations

import numpy as np

#: Fillings of one largest piece that are tried, steps of their enumeration, and fillings that a whole search takes up.
#: They bound the search, not the packing: at their end the best complete packing so far stands.
BRANCHES, STEPS, NODES = 12, 4000, 20_000

#: A filling: lengths with how often each stands in a sequence, largest first; and the number of sequences.
Filling = tuple[tuple[tuple[int, int], ...], int]


class Plan:
    """Where the rank-th piece of each length goes."""

    SHIFT = 42

    def __init__(self, fillings: list[Filling]):
        rows, met, base = [], {}, 0
        for items, times in fillings:
            offset = 0
            for length, copies in items:
                first = met.get(length, 0)
                rows.append((length, first, copies, base, offset))
                met[length] = first + copies * times
                offset += length * copies
            base += times
        self.n_sequences, self.held = base, met
        rows.sort()
        self.length, self.first, self.copies, self.base, self.offset = np.array(rows, np.int64).reshape(-1, 5).T
        self.keys = (self.length << self.SHIFT) + self.first

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and rank among the pieces of that length."""
        length = length.astype(np.int64)
        at = np.searchsorted(self.keys, (length << self.SHIFT) + rank, "right") - 1
        nth = rank - self.first[at]
        return self.base[at] + nth // self.copies[at], self.offset[at] + nth % self.copies[at] * length


def least_sequences(counts: np.ndarray, capacity: int) -> int:
    """A number of sequences below which no packing goes: by all tokens, and by pieces that can't stand together."""
    sizes = np.arange(len(counts))
    tokens = counts * sizes
    n_up, t_up = (np.concatenate([np.cumsum(x[::-1])[::-1], [0]]) for x in (counts, tokens))
    half = capacity // 2
    best = -(-int(tokens.sum()) // capacity)
    for k in range(half + 1):
        big, middle = n_up[capacity - k + 1], n_up[half + 1] - n_up[capacity - k + 1]
        room = middle * capacity - (t_up[half + 1] - t_up[capacity - k + 1])
        small = t_up[k] - t_up[half + 1]
        best = max(best, int(big + middle + max(0, -(-(small - room) // capacity))))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[Filling]:
    """Best fit, longest first, with equal sequences taken together: the incumbent that the search has to beat."""
    open_at: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, items: tuple, times: int) -> None:
        if times:
            if room not in open_at:
                open_at[room] = []
                insort(rooms, room)
            open_at[room].append([items, times])

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        at = bisect_left(rooms, length)
        while left and at < len(rooms):
            room = rooms[at]
            fit, moved = room // length, []
            while left and open_at[room]:
                items, times = open_at[room][-1]
                full = min(times, left // fit)
                rest = left - full * fit if full < times else 0
                moved += [(room - fit * length, (*items, (length, fit)), full)] if full else []
                moved += [(room - rest * length, (*items, (length, rest)), 1)] if rest else []
                left -= full * fit + rest
                open_at[room][-1][1] -= full + bool(rest)
                if not open_at[room][-1][1]:
                    open_at[room].pop()
            if not open_at[room]:
                del open_at[room], rooms[at]
            else:
                at += 1
            for new in moved:
                put(*new)
            at = bisect_left(rooms, max(length, room + 1))
        if left:
            fit = capacity // length
            put(capacity - fit * length, ((length, fit),), left // fit)
            if left % fit:
                put(capacity - left % fit * length, ((length, left % fit),), 1)
    return [(items, times) for held in open_at.values() for items, times in held]


def _dominated(items: list[int], slack: int, counts: list[int], following: list[int]) -> bool:
    """Whether a piece that is left could replace some of the filling's without making it smaller: a longer one, or one for
    several. Fillings of many pieces are asked about one and two of them."""
    for size in range(1, len(items) + 1 if len(items) <= 6 else 3):
        for some in set(combinations(items, size)):
            total = sum(some)
            t = following[total + (size == 1)] if total + (size == 1) < len(following) else 0
            if t and t <= total + slack and counts[t] > items.count(t) - some.count(t):
                return True
    return False


def completions(room: int, waste: int, counts: list[int], sizes: list[int], following: list[int]) -> list[tuple[int, list[int]]]:
    """(slack, pieces) of undominated fillings of a room with pieces that are left, the ones with the least slack first and
    among those the ones of the longest pieces; none leaves more than waste empty. sizes: lengths left, ascending;
    following: by length the next one left, itself included."""
    found: list[tuple[int, list[int]]] = []
    steps = 0
    # Each entry: room left, how far the lengths may go, pieces so far.
    trail: list[tuple[int, int, tuple[int, ...]]] = [(room, bisect_left(sizes, room + 1), ())]
    exact = 0
    while trail and steps < STEPS and exact < BRANCHES:
        steps += 1
        left, top, items = trail.pop()
        while top and sizes[top - 1] > left:
            top = bisect_left(sizes, left + 1, 0, top)
        while top and items.count(sizes[top - 1]) >= counts[sizes[top - 1]]:
            top -= 1
        if not top or not left:
            if left <= waste and not _dominated(list(items), left, counts, following):
                found.append((left, list(items)))
                exact += not left
            continue
        s = sizes[top - 1]
        # Without this length, as long as something can still fill the room; then, first to be tried, with it.
        if top > 1:
            trail.append((left, top - 1, items))
        trail.append((left - s, top, (*items, s)))
    found.sort(key=lambda f: (f[0], [-x for x in f[1]]))
    return found[:BRANCHES]


def solve(counts: np.ndarray, capacity: int) -> Plan:
    """A plan for counts[length] pieces of each length up to capacity, with as few sequences as the search finds.

    The longest piece that is left is completed by undominated fillings; a filling is taken for as many sequences as the
    counts allow at once. A branch ends where its waste leaves no better packing than the incumbent, the first of which
    is best fit's; the search ends at a packing that meets the lower bound, or at its limits."""
    best = best_fit(counts, capacity)
    n_best, least = sum(t for _, t in best), least_sequences(counts, capacity)
    if n_best <= least:
        return Plan(best)
    left = [int(n) for n in counts]
    tokens = int((counts * np.arange(len(counts))).sum())
    sizes = [s for s in range(1, capacity + 1) if left[s]]
    taken: list[Filling] = []
    waste = bins = 0

    def options() -> Iterator[Filling]:
        largest = sizes[-1]
        left[largest] -= 1
        following, near = [0] * (capacity + 2), 0
        for s in range(capacity, 0, -1):
            near = s if left[s] else near
            following[s] = near
        allowed = (n_best - 1) * capacity - tokens - waste
        found = completions(capacity - largest, allowed, left, sizes, following)
        left[largest] += 1
        for slack, items in found:
            own = {}
            for s in [largest, *items]:
                own[s] = own.get(s, 0) + 1
            times = min(left[s] // n for s, n in own.items())
            if slack:
                times = min(times, ((n_best - 1) * capacity - tokens - waste) // slack)
            if times > 0:
                yield tuple(own.items()), times

    trail = [options()]
    nodes = 0
    while trail and nodes < NODES and n_best > least:
        nodes += 1
        step = next(trail[-1], None)
        if step is None:
            trail.pop()
            if taken:
                items, times = taken.pop()
                bins -= times
                waste -= times * (capacity - sum(s * n for s, n in items))
                for s, n in items:
                    if not left[s]:
                        insort(sizes, s)
                    left[s] += n * times
            continue
        items, times = step
        taken.append(step)
        bins += times
        waste += times * (capacity - sum(s * n for s, n in items))
        for s, n in items:
            left[s] -= n * times
            if not left[s]:
                del sizes[bisect_left(sizes, s)]
        if not sizes:
            if bins < n_best:
                best, n_best = list(taken), bins
            trail.append(iter(()))
        elif tokens + waste > (n_best - 1) * capacity:
            trail.append(iter(()))
        else:
            trail.append(options())
    return Plan(best)
