import hashlib
import re
from collections import Counter, defaultdict

import pytest

from maskwright.llm import queries as Q
from maskwright.llm.exact_dedup import exact_dedup
from maskwright.llm.jaccard_join import jaccard_join
from maskwright.llm.substring_dedup import substring_dedup

from .conftest import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        first = True
        for i in sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True):
            out.append((i, keep, len(ids), first and i == keep, hashlib.sha256(t.encode()).hexdigest()))
            first = False
    return Counter(out)


@pytest.mark.parametrize("block", [4, 4096])
def test_exact_dedup_small_blocks(odd, block):
    got = Counter(tuple(r) for r in exact_dedup(odd, block_chars=block).collect())
    assert got == _exact([(r.doc_id, r.text) for r in odd.collect()])


def test_op6_brute_force(spark, documents, empty):
    got = Counter(tuple(r) for r in Q.op6_exact_dedup(spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == _exact([(r.doc_id, r.text) for r in documents.collect()])
    assert exact_dedup(empty).count() == 0


def _substring(rows, size):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + size]) for _, w in split for k in range(len(w) - size + 1))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept))
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [2000, 8 << 20])
def test_op5_brute_force(documents, block_bytes):
    got = Counter(tuple(r) for r in substring_dedup(documents, block_bytes=block_bytes, range_bytes=block_bytes).collect())
    assert got == _substring([(r.doc_id, r.text) for r in documents.collect()], 35)


def test_substring_odd_rows(odd, empty):
    assert Counter(tuple(r) for r in substring_dedup(odd, window=4).collect()) == _substring([(r.doc_id, r.text) for r in odd.collect()], 4)
    assert substring_dedup(empty).count() == 0


def _jaccard(rows, size, num, den):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append((i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, s) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return Counter((i, len(s), least.get(find(a), i)) for a, (i, s) in enumerate(sets))


def test_op9_brute_force(spark, documents):
    got = Counter(tuple(r) for r in Q.op9_jaccard_join(spark, SF).collect())
    assert got == _jaccard([(r.doc_id, r.text) for r in documents.collect()], 4, 85, 100)


def test_jaccard_odd_rows(odd, empty):
    got = Counter(tuple(r) for r in jaccard_join(odd, shingle=3).collect())
    assert got == _jaccard([(r.doc_id, r.text) for r in odd.collect()], 3, 80, 100)
    assert jaccard_join(empty).count() == 0


@pytest.mark.parametrize("local", [1 << 14, 8])
def test_jaccard_many_near_copies(spark, monkeypatch, local):
    """Regions beyond the bounds go through pivots, within a task or over several; every link counts."""
    import random

    from maskwright.llm import jaccard_join as module

    monkeypatch.setattr(module, "LOCAL_SETS", local)
    monkeypatch.setattr(module, "PIVOTS", 5)
    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"v{r.randrange(50)}"
        rows.append((i, " ".join(w)))
    got = Counter(tuple(x) for x in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, num=70).collect())
    assert got == _jaccard(rows, 2, 70, 100)


def test_jaccard_rows_without_ids(spark):
    """Thousands of different texts under one null id, and repeated rows."""
    rows = [(None, f"text number {i} of many that share {i % 7} words") for i in range(3000)] + [(5, "one row twice over here")] * 2 + [(5, "one row twice over there")]
    got = Counter(tuple(x) for x in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, num=95).collect())
    assert got == Counter({(None, 8, None): 3000, (5, 4, 5): 3})


@pytest.mark.parametrize("local", [1 << 13, 300])
def test_jaccard_distant_sets_in_one_region(spark, monkeypatch, local):
    """A chain of rare passages draws hundreds of unrelated texts into one region; few of them are linked."""
    import random

    from maskwright.llm import jaccard_join as module

    monkeypatch.setattr(module, "LOCAL_SETS", local)
    r = random.Random(8)
    rows, n = [], 700
    for i in range(n):
        own = [f"w{r.randrange(10**6)}" for _ in range(12)]
        rows.append((i, " ".join([f"link{i}", f"link{i}b", *own, f"link{(i + 1) % n}", f"link{(i + 1) % n}b"])))
    rows += [(n + i, rows[37 * i][1] + " more") for i in range(15)]
    got = Counter(tuple(x) for x in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, num=85).collect())
    want = _jaccard(rows, 2, 85, 100)
    assert got == want and sum(i != c for i, _, c in got) == 15
