import random

from spotflow.llm.chat import conversations, link_quotes, parse_message, reply_order, with_quotes

KIND = "conv_id long, turn long, role string, text string, reply_to int, hash string"


def test_parse_levels():
    body, quotes = parse_message("Ann wrote:\n> > deep one\n> > more\n> Not so.\nMy answer\n\nlast")
    assert body == "My answer\n\nlast"
    assert quotes == [(2, "deep one\nmore"), (1, "Not so.")]
    assert parse_message(None) == ("", []) and parse_message("") == ("", [])


def test_links_and_order(spark):
    rows = [
        (1, 0, "user", "First question here"),
        (1, 1, "user", "Second thing\n\nwith two paragraphs"),
        (1, 2, "assistant", "> first   QUESTION here.\nan answer to the first"),
        (1, 3, "assistant", "Bob said:\n> with two paragraphs\nan answer to the second"),
        (1, 4, "user", ">> First question here\n> an answer to the first\nthanks"),
        (1, 5, "user", "> nobody said this\nhm"),
        (2, 0, "user", "> First question here\nother conversation"),
        (2, 1, "user", None),
        (2, 1, "user", None),
        (3, 600, "user", "> early\nlate " + "x" * 100_000),
        (3, 0, "user", "early"),
        (None, 0, "user", "a"),
        (4, None, None, "> a\nb"),
    ]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], KIND)
    linked = {(r.conv_id, r.turn): r for r in link_quotes(df).collect()}
    assert [linked[1, t].reply_to for t in range(6)] == [None, None, 0, 1, 2, None]
    assert linked[1, 4].quoted_turns == [0, 2]
    assert linked[2, 0].reply_to is None and linked[3, 600].reply_to == 0
    assert link_quotes(df).count() == len(rows)
    made = {(r.conv_id, r.part): r for r in conversations(link_quotes(df)).collect()}
    assert made[1, 0].turns == [0, 2, 4, 1, 3, 5] and ">" not in made[1, 0].chat.replace("|>", "")
    assert (made[1, 0].n_messages, made[1, 0].n_linked) == (6, 3)
    assert made[2, 0].n_messages == 3 and {k for k in made if k[0] == 3} == {(3, 0), (3, 2)}
    assert sum(r.n_messages for r in made.values()) == len(rows)


def test_repeated_passage_and_empty(spark):
    rows = [(1, t, "user", "same line" if t % 2 else "> same line\nanswer") for t in range(400)]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], KIND)
    linked = link_quotes(df).collect()
    assert all(r.reply_to == (1 if r.turn % 2 == 0 and r.turn > 1 else None) for r in linked) and len(linked) == 400
    assert conversations(link_quotes(df.where("false"))).collect() == []


def test_order_of_a_whole_conversation(spark):
    """Replies far from what they answer, deep chains, repeated and null turns; parts follow one another in one order."""
    rng = random.Random(5)
    rows = []
    for conv, n, reach in (("a", 700, 700), ("b", 60, 1), ("c", 90, 9), ("d", 3, 3), (None, 30, 0)):
        for t in range(n):
            asked = rng.choice([None, max(0, t - rng.randint(1, reach)), max(0, t - 1)]) if reach and t else None
            asked = t - 1 if conv == "b" and t else asked
            rows += [(conv, t * (3 if conv == "c" else 1), rng.choice(["user", "bot"]), f"{conv} {t} {k}", None if asked is None else asked * (3 if conv == "c" else 1)) for k in range(2 if t % 50 == 7 else 1)]
    rows += [("a", None, "user", "no turn", None)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, content string, reply_to long").repartition(3)
    for block in (8, 256):
        made = sorted(conversations(df, block).collect(), key=lambda r: r.part)
        for conv in {r[0] for r in rows}:
            own = sorted(([t is not None, t or 0, role, text, to] for c, t, role, text, to in rows if c == conv), key=str)
            own = sorted(own, key=lambda m: m[:4])
            want = reply_order([{"turn": m[1] if m[0] else None, "role": m[2], "content": m[3], "reply_to": m[4]} for m in own])
            parts = [r for r in made if r.conv_id == conv]
            assert [t for r in parts for t in r.turns] == [m["turn"] for m in want]
            assert "\n".join(r.chat for r in parts) == "\n".join(f"<|{m['role']}|>\n{m['content']}" for m in want)
            assert sum(r.n_linked for r in parts) == sum(m["reply_to"] is not None for m in want)
            assert all(r.n_messages == len(r.turns) <= 1.1 * block + 2 for r in parts)


def test_quoted_paragraphs_with_wrapped_lines(spark):
    rows = [
        (1, 0, "user", "something else"),
        (1, 1, "user", "one two three four\n\nfive six seven eight\n\nnine ten"),
        (1, 2, "assistant", "> one two\n> three four\n>\n> five six\n> seven eight\nyes"),
    ]
    linked = link_quotes(spark.createDataFrame([(*r, 1, "h") for r in rows], KIND)).collect()
    assert {r.turn: r.reply_to for r in linked} == {0: None, 1: None, 2: 1}


def test_quotes_that_are_put_in_lead_back(spark):
    """Each turn links to the one before it, or to the first that said the same, and quotes as deep as its turn says."""
    rows = [(c, t, "user", f"message {t if t != 5 else 2} of {c}\nsecond line {t} {c}") for c in range(3) for t in range(9)]
    linked = link_quotes(with_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert len(linked) == len(rows)
    for r in linked:
        depth = min(r.turn % 4, r.turn)
        assert r.n_quotes == depth and r.content == rows[r.conv_id * 9 + r.turn][3]
        if depth:
            assert r.reply_to == r.turn - 1
        assert set(r.quoted_turns) >= {r.turn - k for k in range(1, depth + 1)}
    assert sum(r.reply_to is not None for r in linked) == 3 * 6


def test_conversation_of_100_000_turns(spark):
    rng = random.Random(12)
    asked = [None] + [rng.choice([None, rng.randrange(t), t - 1 if t % 7 else None]) for t in range(1, 100_000)]
    df = spark.createDataFrame([(1, t, "u", str(t), a) for t, a in enumerate(asked)], "conv_id long, turn long, role string, content string, reply_to long").repartition(4)
    got = [t for r in conversations(df).orderBy("part").collect() for t in r.turns]
    assert got == [m["turn"] for m in reply_order([{"turn": t, "reply_to": a} for t, a in enumerate(asked)])]


def test_crowded_turns_come_in_bounded_rows(spark):
    """A third of all rows without a conversation, and one turn that is repeated very often."""
    rows = [(None, 0, "u", f"n{i:04}", None) for i in range(500)] + [(1, 3, "u", f"r{i:04}", None) for i in range(500)] + [(2, t, "u", "x", None) for t in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, content string, reply_to long").repartition(3)
    made = conversations(df, 32).collect()
    assert all(r.n_messages <= 64 for r in made) and sum(r.n_messages for r in made) == len(rows)
    for conv in (None, 1, 2):
        parts = sorted((r for r in made if r.conv_id == conv), key=lambda r: r.part)
        assert "\n".join(r.chat for r in parts) == "\n".join(f"<|u|>\n{r[3]}" for r in rows if r[0] == conv)
