"""Alignment of two texts by the lengths of their sentences: exact, and in memory that does not grow with the table of costs.

A row of the table is worked out from the two rows before it at once. Costs are whole numbers, so that a sum has one
value in whatever order it is taken and equal ways are told apart by the order of the moves alone.
"""

from __future__ import annotations

import math

import numpy as np

# Fixed values of Gale and Church (1993): characters of one language for each of the other, variance per character, and priors.
RATIO, VARIANCE = 1.0, 6.8
PRIORS = {(1, 1): 0.89, (1, 0): 0.0099, (0, 1): 0.0099, (2, 1): 0.089, (1, 2): 0.089, (2, 2): 0.011}
MOVES = tuple(PRIORS)
#: Costs are in parts of a natural logarithm's unit; tails below LEAST count as LEAST.
UNIT, LEAST = 10_000, 1e-300
#: Half the width of the first band, and cells whose ways back are kept together.
BAND, HELD = 32, 4_000_000
NEVER = np.int64(1) << 60

#: Step, values and slopes of -log(erfc(x)), between which a cubic gives it to eleven digits.
_STEP = 1 / 256
_X = np.arange(0, 26.3, _STEP)
_TAIL = np.array([max(math.erfc(x), LEAST) for x in _X])
_LOG = -np.log(_TAIL)
_SLOPE = 2 / math.sqrt(math.pi) * np.exp(-_X * _X) / _TAIL * _STEP


def log_tail(x: np.ndarray) -> np.ndarray:
    """-log(erfc(x)), at most that of LEAST."""
    k = np.minimum((x / _STEP).astype(np.int64), len(_X) - 2)
    t = np.minimum(x / _STEP - k, 1.0)
    u = 1 - t
    inside = (1 + 2 * t) * u * u * _LOG[k] + t * u * u * _SLOPE[k] + t * t * (3 - 2 * t) * _LOG[k + 1] - t * t * u * _SLOPE[k + 1]
    return np.minimum(inside, -math.log(LEAST))


def cost(a: int, b: np.ndarray, move: tuple[int, int]) -> np.ndarray:
    """What it costs to face ``a`` characters with each of ``b``, a whole number."""
    b = np.asarray(b, dtype=np.float64)
    delta = np.abs(b - a * RATIO) / np.sqrt(np.maximum((a + b / RATIO) / 2, 1e-9) * VARIANCE)
    tail = np.where((b == 0) & (a == 0), 0.0, log_tail(delta / math.sqrt(2)))
    return np.floor((tail - math.log(PRIORS[move])) * UNIT + 0.5).astype(np.int64)


class Table:
    """The rows of costs of two texts within columns ``low[i]`` to ``high[i]``."""

    def __init__(self, src, hyp, low: np.ndarray, high: np.ndarray):
        self.a, self.b = (np.concatenate([[0], np.cumsum(np.asarray(x, dtype=np.int64))]).astype(np.int64) for x in (src, hyp))
        self.low, self.high = low, high

    def begin(self):
        return (np.full(1, NEVER), 0), (np.full(1, NEVER), 0)

    def row(self, i: int, before: tuple, last: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Costs and ways of row ``i``; ``before`` and ``last`` are (costs, first column) of the rows i - 2 and i - 1."""
        lo, hi = int(self.low[i]), int(self.high[i])
        js = np.arange(lo, hi + 1)

        def earlier(rows, dj):
            costs, first = rows
            out = np.full(len(js), NEVER)
            start, stop = max(lo - dj, first, 0), min(hi - dj, first + len(costs) - 1)
            if start <= stop:
                out[start + dj - lo : stop + dj - lo + 1] = costs[start - first : stop - first + 1]
            return out

        best, way = np.full(len(js), NEVER), np.zeros(len(js), dtype=np.uint8)
        if i == 0 and lo == 0:
            best[0] = 0
        for k, (di, dj) in enumerate(MOVES):
            if di == 0 or di > i:
                continue
            from_ = earlier(last if di == 1 else before, dj)
            if dj == 0:
                there = from_ + cost(int(self.a[i] - self.a[i - di]), np.zeros(1), (di, dj))[0]
            else:
                there = from_ + cost(int(self.a[i] - self.a[i - di]), self.b[js] - self.b[np.maximum(js - dj, 0)], (di, dj))
            better = there < best
            best[better], way[better] = there[better], k
        # a move along the row: the least of what stands before, plus what lies between
        k = MOVES.index((0, 1))
        step = cost(0, self.b[js] - self.b[np.maximum(js - 1, 0)], (0, 1))
        upto = np.cumsum(step)
        full = np.minimum.accumulate(best - upto) + upto
        along = np.full(len(js), NEVER)
        along[1:] = full[:-1] + step[1:]
        better = (along < best) | ((along == best) & (way > k) & (along < NEVER))
        best[better], way[better] = along[better], k
        return np.minimum(best, NEVER), way

    def solve(self, held: int = HELD) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int]]]:
        """(cost, moves from the end, costs of the cells at the edge): the ways of a block of rows at a time are kept, and the two
        rows before each block, from which it is worked out anew on the way back."""
        n = len(self.a) - 1
        width = int((self.high - self.low).max()) + 1
        block = max(2, min(n + 1, max(held // width, math.isqrt(8 * n) + 1)))
        marks, edge = [], []
        before, last = self.begin()
        for i in range(n + 1):
            if i % block == 0:
                marks.append((before, last))
            costs, _ = self.row(i, before, last)
            before, last = last, (costs, int(self.low[i]))
            for k in {0, 1, len(costs) - 2, len(costs) - 1} & set(range(len(costs))):
                edge.append((i, int(self.low[i]) + k, int(costs[k])))
        total, path = int(last[0][-1]), []
        i, j = n, len(self.b) - 1
        for mark in range(len(marks) - 1, -1, -1):
            (before, last), ways = marks[mark], []
            for r in range(mark * block, min(n + 1, (mark + 1) * block)):
                costs, way = self.row(r, before, last)
                before, last = last, (costs, int(self.low[r]))
                ways.append(way)
            while (i or j) and i >= mark * block:
                move = MOVES[ways[i - mark * block][j - int(self.low[i])]]
                path.append(move)
                i, j = i - move[0], j - move[1]
        return total, path, edge


def band(n: int, m: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last column of each row within ``half`` of the line from corner to corner."""
    at = np.arange(n + 1) * m // max(n, 1)
    slope = -(-m // max(n, 1))
    low, high = np.maximum(at - half - slope, 0), np.minimum(at + half + slope, m)
    low[0], high[-1] = 0, m
    return low, high


def proven(total: int, n: int, m: int, edge, edge_back) -> bool:
    """Whether no way that leaves the band is as cheap as ``total``.

    Such a way is last inside before it leaves at one cell of the edge and first inside again at another. It costs at least what
    the first has from the start and the second to the end, and between them the cheapest prior of each step.
    """
    each = min(math.floor(-math.log(p) * UNIT) // (di + dj) for (di, dj), p in PRIORS.items())
    leave = sorted((i, c - each * (i + j)) for i, j, c in edge if c < NEVER)
    again = sorted((n - i, c + each * (n - i + m - j)) for i, j, c in edge_back if c < NEVER)
    if not leave or not again:
        return True
    rows = np.array([i for i, _ in again])
    least = np.minimum.accumulate(np.array([c for _, c in again])[::-1])[::-1]
    for i, c in leave:
        k = int(np.searchsorted(rows, i))
        if k < len(rows) and c + int(least[k]) <= total:
            return False
    return True


def moves(src, hyp, half: int = BAND, held: int = HELD) -> list[tuple[int, int]]:
    """The moves of the cheapest alignment, from the start; of equally cheap ways the one whose last move comes first in MOVES.

    A band round the line from corner to corner widens until nothing outside it can be as cheap; where that cannot be shown before it
    covers half of the table, the whole table is gone through, a row at a time.
    """
    n, m = len(src), len(hyp)
    while 4 * half < m:
        low, high = band(n, m, half)
        total, path, edge = Table(src, hyp, low, high).solve(held)
        if total < NEVER:
            mirrored = (m - high)[::-1], (m - low)[::-1]
            _, _, back = Table(list(src)[::-1], list(hyp)[::-1], *mirrored).solve(held)
            outer = lambda cells, lo, hi: [(i, j, c) for i, j, c in cells if j - lo[i] < 2 and lo[i] > 0 or hi[i] - j < 2 and hi[i] < m]
            if proven(total, n, m, outer(edge, low, high), outer(back, *mirrored)):
                return path[::-1]
        half *= 4
    whole = np.zeros(n + 1, dtype=np.int64), np.full(n + 1, m, dtype=np.int64)
    return Table(src, hyp, *whole).solve(held)[1][::-1]


def align_lengths(src: list[int], hyp: list[int], half: int = BAND, held: int = HELD) -> list[tuple[int, int]]:
    """Links (i, j) of the cheapest alignment; sentences without a counterpart get none."""
    links, i, j = [], 0, 0
    for di, dj in moves(src, hyp, half, held):
        links += [(x, y) for x in range(i, i + di) for y in range(j, j + dj)]
        i, j = i + di, j + dj
    return links
