from collections import Counter

from maskwright.llm import jaccard_join as module

from .test_dedup import _jaccard


def test_every_region_has_a_pivot(spark, monkeypatch):
    """Many small regions, each beyond the bounds and with one pivot a turn: none is lost when the dice draw nobody."""
    monkeypatch.setattr(module, "LOCAL_SETS", 2)
    monkeypatch.setattr(module, "PIVOT_SHINGLES", 1)
    rows = []
    for g in range(40):
        base = [f"g{g}w{k}" for k in range(40)]
        rows += [(4 * g + i, " ".join([*base[: 39 - i], f"g{g}v{i}", *base[40 - i :]])) for i in range(4)]
    got = Counter(tuple(x) for x in module.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, num=70).collect())
    assert got == _jaccard(rows, 2, 70, 100)
