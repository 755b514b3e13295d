import random

import numpy as np
import pytest

from maskwright.operators import phrase_search as module
from maskwright.operators import spans as S


@pytest.mark.parametrize("bits, most", [(16, 1 << 19), (1, 1 << 19), (1, 3)])
def test_blocks_are_neither_written_nor_shuffled(spark, monkeypatch, bits, most):
    """Phrases beyond one automaton: a tight sieve, a loose one, and one that lets too much through to be broadcast."""
    monkeypatch.setattr(module, "SIEVE_BITS", bits)
    monkeypatch.setattr(module, "FALSE_TEXTS", most)
    written, write, let = [], module.kept, []
    monkeypatch.setattr(module, "kept", lambda df: written.append(df.columns) or write(df))
    found = module._no_phrases
    monkeypatch.setattr(module, "_no_phrases", lambda *a: let.append(found(*a)) or let[-1])
    if bits == 1:
        monkeypatch.setattr(module, "PHRASE_HASHES", 1)
        monkeypatch.setattr(module, "MOST_BITS", 1 << 13)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh日") for _ in range(rng.choice([1, 2, 3, 6, 11])))
    words = [word() for _ in range(300)]
    rows = [(i, [rng.choice([*words, None, "a\0b", ", "]) for _ in range(rng.randrange(40))]) for i in range(120)] + [(500, None), (501, [])]
    terms = sorted({f"{rng.choice(words)} {rng.choice(words)}" for _ in range(2500)})
    df = spark.createDataFrame(rows, "b int, units array<string>").repartition(3)
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    for full in (False, True):
        got = {r.b: r.user_kept for r in module.with_phrases(df, table, full, most=100).collect()}
        for b, units in rows:
            if units is None:
                assert got[b] is None
                continue
            breaks = np.append(1, np.zeros(max(len(units) - 1, 0), np.int64))[: len(units)]
            assert got[b] == S.protected([u or "" for u in units], S._phrases(tuple(terms)), full, breaks).tolist()
    assert all((x is None) == (most == 3) for x in let) and (bits == 16 or most == 3 or let[0])
    assert any("units" in columns for columns in written) == (most == 3)
