"""Prefix tries against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

from maskwright.llm import queries as Q
from maskwright.llm.prefix_trie import forked, number_turns, prefix_trie, sizes

from .conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth string, times string"


def _own(rows):
    """conv_id -> its turns in order, equal numbers by digest of (role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, key, (role, text)))
    return {c: [x[3] for x in sorted(turns)] for c, turns in own.items()}


def _forked(own):
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return built


def _trie(built):
    members, kids = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, leaves, saved = set(), {}, {}
    for p in sorted(members, key=len, reverse=True):
        m = sorted(members[p])
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(m) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in m if len(built[c]) == len(p))
        out.add((m[0], len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _found(turns, conversations):
    rows = [tuple(r) for r in prefix_trie(turns, conversations).drop("turn_key").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in Q.op11_prefix_trie(spark, SF).collect()]
    assert set(got) == _trie(_forked(_own(rows))) and len(got) == len(set(got))


def test_generated_conversations(spark):
    """Few texts, so that many conversations share long beginnings; absent bases, nulls, ties, repeated rows, copies."""
    rng = random.Random(7)
    rows = [(None, 0, "user", "no conversation")]
    for c in rng.sample(range(400), 160):
        for turn in range(rng.choice([1, 2, 5, 9, 12])):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", None, ""]), rng.choice(["a", "é" * 40, "", None])))
    rows += rng.choices(rows, k=60)
    rows += [(1000 + i, turn, "user", f"copied {turn}") for i in range(40) for turn in range(11)]
    rows += [(2001, 0, "user", "x" * 300_000), (2002, 0, "user", "x" * 300_000)]
    df = _frame(spark, rows)
    turns = number_turns(df)
    own = _own(rows)
    assert _found(turns, sizes(turns)) == _trie(own)
    built = _forked(own)
    # some have no turns left: they are members of the root alone
    assert any(not turns for turns in built.values())
    assert _found(*forked(turns)) == _trie(built)


def test_one_conversation_over_many_tasks(spark):
    """A conversation that holds most rows is numbered without gaps, however it is dealt."""
    rows = [(5, i, "user", f"turn {i % 7}") for i in range(3000)] + [(6, i, "user", "other") for i in range(20)]
    own = _own(rows)
    turns = number_turns(_frame(spark, rows).repartition(8))
    assert sorted(r.pos for r in turns.where("conv_id = 5").collect()) == list(range(1, 3001))
    assert _found(turns, sizes(turns)) == _trie(own)


def test_no_conversations(spark):
    turns = number_turns(_frame(spark, []))
    assert _found(*forked(turns)) == set() and _found(turns, sizes(turns)) == set()
