import random
from collections import Counter

import numpy as np
import pytest

from maskwright.llm import jaccard_join as module

from .test_dedup import _jaccard


def _near_copies(n, edits, seed):
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(60)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = f"v{r.randrange(5000)}"
        rows.append((i, " ".join(w)))
    return rows


def test_turns_do_not_grow_with_a_region(spark, monkeypatch):
    """Hundreds of texts of one origin, most of them too far from each other: a few turns, not one for each few pivots."""
    monkeypatch.setattr(module, "LOCAL_SETS", 60)
    monkeypatch.setattr(module, "PIVOTS", 4)
    turns, measure = [], module._measure
    monkeypatch.setattr(module, "_measure", lambda *a: turns.append(1) or measure(*a))
    rows = _near_copies(300, 8, 4)
    got = Counter(tuple(x) for x in module.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, num=80).collect())
    assert got == _jaccard(rows, 2, 80, 100) and len({c for _, _, c in got}) > 40
    assert len(turns) <= 3


@pytest.mark.parametrize("seed", range(6))
def test_chunks_find_all_links(monkeypatch, seed):
    """One or two sides, with and without members of the main component, against all pairs."""
    monkeypatch.setattr(module, "PIVOTS", 3)
    dice = np.random.default_rng(seed)
    base = dice.choice(4000, 50, replace=False)
    sets = []
    for i in range(40):
        own = np.setdiff1d(base, dice.choice(base, dice.integers(0, 12))) if i % 5 else dice.choice(4000, 5)
        sets.append(np.unique(np.append(own, dice.choice(4000, dice.integers(0, 6)))).astype(np.uint64))
    limit, side = module.Limit(80, 100), dice.integers(0, 1 + seed % 2, 40)
    comps = np.arange(100, 140)
    main = [100, 7][seed % 3 == 0]
    want = np.arange(40)
    for a in range(40):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if (side[a] != side[b] or side.max() == 0) and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                want[want == want[a]] = want[b]
    got = module._join_chunks(sets, side, comps, main, limit)
    assert len({*zip(got.tolist(), want.tolist(), strict=True)}) == len({*got.tolist()}) == len({*want.tolist()}) < 40


@pytest.mark.parametrize("most", [500_000, 10])
def test_texts_are_shuffled_once(spark, monkeypatch, most):
    """Nodes beyond a broadcast: blocks find their sets' rows without a join of texts, with the same result."""
    from maskwright.llm import spark_util

    monkeypatch.setattr(spark_util.is_small, "__defaults__", (most,))
    plans, deal = [], module._candidates

    def seen(texts, *rest):
        plans.append(texts._jdf.queryExecution().optimizedPlan().toString())
        return deal(texts, *rest)

    monkeypatch.setattr(module, "_candidates", seen)
    rows = _near_copies(60, 8, 5) + [(None, "no id but a text"), (None, "no id but another text"), (99, None), (100, "w1"), (101, "w1")]
    rows += [(200 + i, t) for i, t in rows[:30]]
    got = Counter(tuple(x) for x in module.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, num=80).collect())
    assert got == _jaccard(rows, 2, 80, 100)
    assert ("Join" in plans[0]) == (most > 10)
