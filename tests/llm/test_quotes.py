import random
from pathlib import Path

import pytest

from paperloom.llm import quotes

TABLES = Path("/root/testdata/sf0.01")

MESSAGES = [
    (1, 0, "user", "Shall we meet on Monday?\n\nThe room is free."),
    (1, 1, "assistant", "> shall we  meet on MONDAY?\n>\n> The room is free.\nYes, Monday works."),
    (1, 2, "user", ">> Shall we meet on Monday?\n> Yes, Monday works.\nGood, I will book it."),
    (1, 3, "user", "> The room is free.\nIs it large?"),
    (1, 4, "user", "> never said here\nOdd quote."),
    (2, 0, "user", "> Good, I will book it.\nForwarding this."),
    (2, 1, "user", None), (None, 1, "user", "> x\ny"), (2, None, None, "z"), (2, 1, "user", None), (3, 0, "user", "> > \n>\nonly marks"), (3, 1, "user", "word " * 30000),
]


def frame(spark):
    return spark.createDataFrame([(*m, "extra") for m in MESSAGES], "conv_id long, turn long, role string, text string, parent_turn string")


def test_threads(spark):
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(frame(spark)).collect()}
    reply = lambda k: (got[k].parent_turn, got[k].thread_turn, got[k].depth)
    assert reply((1, 0)) == (None, 0, 0) and reply((1, 1)) == (0, 0, 1) and reply((1, 2)) == (1, 0, 2) and reply((1, 3)) == (0, 0, 1) and reply((1, 4)) == (None, 4, 0)
    assert got[1, 2].text == "Good, I will book it." and got[1, 2].quote_level == 2 and got[1, 2].n_quotes == 2 and got[1, 2].n_linked == 2
    assert got[2, 0].n_elsewhere == 1 and got[2, 0].parent_turn is None and got[2, 1].text == ""
    assert got[3, 0].text == "only marks" and got[3, 0].n_quotes == 0
    assert ">" not in "".join(r.text for r in got.values())


def test_positions_number_each_conversation(spark):
    rows = quotes.conversations(frame(spark)).collect()
    assert len(rows) == len(MESSAGES)
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r.conv_id, []).append(r)
    assert all(r.position is None for r in by_conv.pop(None))
    for rs in by_conv.values():
        assert sorted(r.position for r in rs) == list(range(len(rs)))
        order = [(r.thread_turn is not None, r.thread_turn or 0, r.turn or 0) for r in sorted(rs, key=lambda r: r.position)]
        assert order == sorted(order)


def test_blocks_of_turns_and_long_chains(spark):
    rows = [(7, i, "u", (f"> say number {i - 1}\n" if i else "") + f"say number {i}") for i in range(700)]
    got = {r.turn: r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(r.thread_turn == 0 and r.depth == t == r.position for t, r in got.items())


def test_empty(spark):
    assert quotes.conversations(frame(spark).limit(0)).count() == 0


def brute_links(messages):
    """(conversation, turn) -> {passage: origin} by trying every message for every grain."""
    stated = [(c, t, {h for _, h in quotes.grains(quotes.own_text(quotes.blocks(x or "")))}) for c, t, _, x in messages if c is not None and t is not None]
    out = {}
    for c, t, _, x in messages:
        if c is None or t is None:
            continue
        for seq, (level, body) in enumerate(quotes.blocks(x or "")):
            best = None
            for grain, h in quotes.grains(body) if level else ():
                here = min((u for d, u, s in stated if d == c and h in s), default=None)
                if here is not None and here < t:
                    origin = (c, here)
                else:
                    origin = min(((d, u) for d, u, s in stated if d != c and h in s), default=None)
                if origin is not None:
                    best = min(filter(None, (best, ((grain, origin[0] != c, -origin[1], h), origin))))
            if best:
                out[c, t, seq] = best[1]
    return out


def test_links_equal_brute_force(spark):
    rng = random.Random(6)
    phrases = [f"phrase number {i} of the corpus" for i in range(12)]
    rows = []
    for c in range(9):
        for t in range(8):
            own = "\n".join(rng.sample(phrases, rng.randrange(3)))
            quoted = "\n".join(f"> {p}" for p in rng.sample(phrases, rng.randrange(3)))
            rows.append((c, t, "u", f"{quoted}\n{own}" if quoted else own))
    rows += MESSAGES
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn, r.seq): (r.origin_conv, r.origin_turn) for r in quotes.links(quotes.parse(table)).collect()}
    assert got == brute_links(rows) and len(got) > 20


def test_own_later_turn_does_not_hide_another_conversation(spark):
    rows = [(1, 2, "u", "> shared words\nwhat of it"), (1, 5, "u", "shared words"), (2, 0, "u", "shared words")]
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 2].n_linked == got[1, 2].n_elsewhere == 1


@pytest.mark.skipif(not TABLES.exists(), reason="the supplied tables are not here")
def test_derived_replies_of_a_whole_table(spark):
    """The supplied conversations quote nothing; here every turn but the first
    quotes the one before, every fourth one also a message of the conversation before."""
    table = {(r.conv_id, r.turn): r for r in spark.read.parquet(str(TABLES / "conversations.parquet")).where("conv_id is not null and turn is not null").collect()}
    stated = {k: "\n".join(x.strip() for x in (r.text or "").split("\n")).strip() for k, r in table.items()}
    owners = {}
    for k, t in stated.items():
        for _, h in quotes.grains(t):
            owners.setdefault(h, set()).add(k)
    quoting = lambda t: "\n".join(f"> {x}" for x in t.split("\n"))
    rows, replies = [], {}
    for (c, t), own in stated.items():
        parts = []
        if stated.get((c, t - 1)):
            parts.append(quoting(stated[c, t - 1]))
            replies[c, t] = t - 1
        if t % 4 == 3 and stated.get((c - 1, 0)):
            parts.append(f"> {quoting(stated[c - 1, 0])}".replace("\n>", "\n> >"))
        rows.append((c, t, table[c, t].role, "\n".join([*parts, own])))
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(rows) > 100 and len(replies) > 50
    for k, r in got.items():
        assert r.text == stated[k]
        if k in replies:
            whole = quotes.digest(stated[k[0], replies[k]])
            earliest = min(t for c, t in owners[whole] if c == k[0])
            assert r.parent_turn == earliest and r.n_linked >= 1
