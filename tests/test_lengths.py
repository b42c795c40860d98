import math
import random

import numpy as np
import pytest

from lexigrid.operators import lengths


def full_table(src, hyp):
    """Links by the whole table, a cell at a time."""
    n, m = len(src), len(hyp)
    a, b = [0], [0]
    for x in src:
        a.append(a[-1] + x)
    for x in hyp:
        b.append(b[-1] + x)

    def cost(x, y, prior):
        if x == y == 0:
            return math.floor(-math.log(prior) * lengths.UNIT + 0.5)
        delta = (y - x) / math.sqrt((x + y) / 2 * lengths.VARIANCE)
        return math.floor((-math.log(max(math.erfc(abs(delta) / math.sqrt(2)), 1e-300)) - math.log(prior)) * lengths.UNIT + 0.5)

    best, way = {(0, 0): 0}, {}
    for i in range(n + 1):
        for j in range(m + 1):
            for move, prior in lengths.PRIORS.items():
                before = (i - move[0], j - move[1])
                if before in best:
                    c = best[before] + cost(a[i] - a[before[0]], b[j] - b[before[1]], prior)
                    if (i, j) not in best or c < best[i, j]:
                        best[i, j], way[i, j] = c, move
    links, i, j = [], n, m
    while i or j:
        di, dj = way[i, j]
        links = [(x, y) for x in range(i - di, i) for y in range(j - dj, j)] + links
        i, j = i - di, j - dj
    return links


def noisy(rng, n):
    """Lengths of a text and of its translation, with sentences joined, split, left out and of equal lengths."""
    src = [rng.choice([0, 12, 12, 30, rng.randint(1, 200)]) for _ in range(n)]
    hyp = []
    for x in src:
        y = max(0, x + rng.randint(-x // 6, x // 6)) if rng.random() < 0.7 else x
        kind = rng.random()
        if kind < 0.08:
            continue
        if kind < 0.2 and y > 4:
            hyp += [y // 2, y - y // 2]
        elif kind < 0.3 and hyp:
            hyp[-1] += y
        else:
            hyp.append(y)
    return src, hyp


def test_equal_to_the_full_table_on_random_pairs():
    rng = random.Random(7)
    for k in range(200):
        src, hyp = noisy(rng, rng.randint(0, 20))
        want = full_table(src, hyp)
        assert lengths.align_lengths(src, hyp) == want
        assert lengths.align_lengths(src, hyp, half=1, held=1) == want  # bands from the narrowest, blocks of a few rows
    src, hyp = noisy(rng, 16)
    assert lengths.align_lengths(src, hyp * 4, half=1) == full_table(src, hyp * 4)


def test_a_band_is_accepted_only_where_it_holds_the_best():
    n = 400
    same = [10 + k % 7 for k in range(n)]
    calls = []

    class Counting(lengths.Table):
        def solve(self, held):
            calls.append(int((self.high - self.low).max()))
            return super().solve(held)

    whole, lengths.Table = lengths.Table, Counting
    try:
        assert lengths.align_lengths(same, same, half=8) == [(k, k) for k in range(n)]
        assert max(calls) < 40  # proven in the first band
        moved = same[200:] + same[:200]
        got = lengths.align_lengths(same, moved, half=8)
    finally:
        lengths.Table = whole
    low, high = np.zeros(n + 1, dtype=np.int64), np.full(n + 1, n, dtype=np.int64)
    path = lengths.Table(same, moved, low, high).solve()[1][::-1]
    assert sum(di * dj for di, dj in path) == len(got)


def test_memory_is_linear_in_the_texts():
    import tracemalloc

    peaks = []
    for n in (400, 1600):
        src = [20 + k * 7 % 90 for k in range(n)]
        tracemalloc.start()
        links = lengths.align_lengths(src, src[: n // 2] + src[n // 2 + 60 :], held=20_000)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(links) >= n - 70
    assert peaks[1] < 9 * peaks[0]  # sixteen times the cells


@pytest.mark.parametrize("x", [0.0, 0.001, 0.5, 1.7, 4.0, 12.3, 25.9, 26.2, 40.0, 1e6])
def test_tail(x):
    assert lengths.log_tail(np.array([x]))[0] == pytest.approx(-math.log(max(math.erfc(x), 1e-300)), abs=1e-9)
