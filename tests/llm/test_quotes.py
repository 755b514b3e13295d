"""Quotation linking against plain Python on generated threads."""

import random

from maskwright.llm.quotes import link_quotes, without_quotes

TABLE, PROMPT, CODE = "| a | b |\n|---|---|\n| 1 | 2 |", ">>> x = 1\n>>> y", "```\n> not a quote\n```"


def _conversation(rng, n):
    """Messages with the earlier one that each quotes (None: none), and what is left of their texts."""
    out = []
    for turn in range(n):
        said = f"Message {turn} says {rng.random()}."
        extra = rng.choice(["", "", TABLE, PROMPT, CODE, "ok", "> nobody said {0}".format(rng.random())])
        own = said + ("\n" + extra if extra else "")
        target = rng.randrange(turn) if turn and rng.random() < 0.5 else None
        if target is None:
            out.append((None, own, own, said))
        else:
            intro = rng.choice(["", "On Monday, A wrote:\n"])
            out.append((target, f"{intro}> {out[target][3]}\n\n{own}", own, said))
    return out


def _depth_first(parents):
    children = {}
    for turn, p in enumerate(parents):
        children.setdefault(p, []).append(turn)
    order, stack = [], list(reversed(children.get(None, [])))
    while stack:
        turn = stack.pop()
        order.append(turn)
        stack += reversed(children.get(turn, []))
    return order


def test_threads_by_brute_force(spark):
    rng = random.Random(5)
    threads = {c: _conversation(rng, n) for c, n in enumerate((1, 2, 7, 40, 120))}
    rows = [(c, t, "u", m[1]) for c, messages in threads.items() for t, m in enumerate(messages)]
    rng.shuffle(rows)
    got = {(r.conv_id, r.turn): r for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(rows)
    for c, messages in threads.items():
        parents = [m[0] if m[0] is not None else t - 1 if t else None for t, m in enumerate(messages)]
        assert [got[(c, t)].reply_to for t in range(len(messages))] == parents
        assert [got[(c, t)].text for t in range(len(messages))] == [m[2] for m in messages]
        order = _depth_first(parents)
        assert sorted(range(len(messages)), key=lambda t: got[(c, t)].position) == order
        depths = {}
        for t in order:
            depths[t] = 0 if parents[t] is None else depths[parents[t]] + 1
        assert all(got[(c, t)].depth == d and got[(c, t)].thread == 0 for t, d in depths.items())


def test_what_is_no_quotation_stays():
    for text in (TABLE, PROMPT, CODE, "> said by nobody", "a\n> b\n\n> c", "> ", "", "Alice wrote:\n>>> print(1)"):
        assert without_quotes(text, set()) == text
    mail = "Hi\n\nOn 3 May 2020 at 10:11, Ann Fox wrote:\n> old\n> text\n\nBye"
    assert without_quotes(mail, set()) == "Hi\n\n\nBye" and without_quotes("Ann <ann@fox.org> wrote:\n> old\nnew", set()) == "new"


def test_long_sparse_and_repeated_messages(spark):
    long = "word " * 200_000
    rows = [(1, 10**12 * t, "u", f"number {t}") for t in range(300)] + [(1, 10**12 * 300, "u", long), (1, 10**12 * 301, "u", f"> {long}\nyes"), (2, 0, "u", "same"), (2, 0, "u", "same"), (2, 1, "u", "> same\n> same\nno"), (2, 1, "u", "> same\nno")]
    got = link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = got.collect()
    assert len(found) == len(rows) and sorted(r.position for r in found if r.conv_id == 1) == list(range(302))
    assert [r.text for r in found if r.turn == 10**12 * 301] == ["yes"] and {r.text for r in found if (r.conv_id, r.turn) == (2, 1)} == {"no"}


def test_no_messages_and_clashing_columns(spark):
    """An empty table, nulls in every column, and other columns of names that are used inside."""
    from pyspark.sql import functions as F

    rows = [(1, 0, "user", "A passage that is said first."), (1, 1, "bot", "> A passage that is said first.\n\nAnd answered."), (1, None, None, None), (None, 0, "user", ""), (None, 1, "user", "> nobody said this")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("rid", "hash", "quotes", "passages", "thread", "position", "depth", "explicit", "origin", "linked_quotes")})
    got = {(r.conv_id, r.turn): r for r in link_quotes(df).collect()}
    assert len(got) == 5 and got[1, 1].reply_to == 0 and got[1, 1].text == "And answered." and got[1, 1].linked_quotes == 1
    assert got[None, 1].text == "> nobody said this" and got[1, None].text == "" and got[None, 0].role == "user"
    assert link_quotes(df.where("false")).count() == 0
