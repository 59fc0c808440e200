"""The cuts against every choice of cuts on small streams, and the padding of real ones."""

from functools import lru_cache

import numpy as np

from loamgraph.llm.packing import Packing, candidates, least_cost_cuts, pack
from loamgraph.runtime import ship, table

SMALL = Packing(window=16, gap=4, sentence_penalty=1.0, hard_penalty=3.0, least_power=4)


def cost_of(p, at, pay, cuts):
    powers = {1 << k for k in range(p.window.bit_length()) if p.least_power <= 1 << k < p.window}
    out, where = 0.0, {int(x): i for i, x in enumerate(at)}
    for a, b in zip(cuts[:-1], cuts[1:]):
        assert 0 < b - a <= p.window
        out += (0 if b - a in powers else p.window - (b - a)) + pay[where[int(b)]]
    return out


def test_least_cost_against_every_choice():
    rng = np.random.default_rng(6)
    for _ in range(80):
        total = int(rng.integers(1, 90))
        ends = np.unique(rng.integers(1, total + 1, int(rng.integers(1, 8))))
        sentences = np.unique(rng.integers(1, total + 1, int(rng.integers(0, 10))))
        at, pay = candidates(SMALL, ends, sentences, total)
        assert at[0] == 0 and at[-1] == total and (np.diff(at) <= SMALL.gap).all()

        @lru_cache(maxsize=None)
        def best(j):
            if j == 0:
                return 0.0
            return min(best(i) + cost_of(SMALL, at, pay, [at[i], at[j]]) for i in range(j) if at[j] - at[i] <= SMALL.window)

        cuts = least_cost_cuts(SMALL, at, pay, True)
        assert cuts[0] == 0 and cuts[-1] == total
        assert abs(cost_of(SMALL, at, pay, cuts) - best(len(at) - 1)) < 1e-9


def test_padding_is_small(spark, sf):
    ship(spark)
    rows = pack(table(spark, sf, "documents").coalesce(1)).groupBy("sequence_id").sum("length").collect()
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in (r[1] for r in rows))
    assert padding <= 0.02 * sum(r[1] for r in rows)
