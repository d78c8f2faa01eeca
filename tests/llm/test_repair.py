import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest

from spotflow.llm import repair as rp
from spotflow.llm.queries import ORACLES, QUERIES
from spotflow.llm.repair import damaged, messages, repair, repaired_parts, summaries

SCHEMA = "conv_id long, turn long, role string, text string"


def spoiled(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(conv, turn, "user" if way == 4 else role, text)] * {0: 0, 3: 2}.get(way, 1)
    return out


def brute(rows):
    """The result for one conversation's rows by recursion over all edits."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        chars = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, said, run):
        """(cost, audit, messages) from row i on, after role initials `said`, shortened to what matters."""
        found = []
        if i == len(rows):
            if said in ("", "a"):
                found.append((0, "", ()))
        else:
            _, _, role, text = rows[i]
            cost, audit, out = best(i + 1, said, 0)
            found.append((cost + 4, "D" + audit, out))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] == "truncated" else 0
                for new, letter, price in ((role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                    if new and said + new[:1] in ("s", "u", "su", "ua", "au"):
                        cost, audit, out = best(i + 1, new[:1], 0)
                        found.append((cost + price + extra, letter + audit, ((new, text), *out)))
        if run < 3:
            for new in ("user", "assistant"):
                if said + new[:1] in ("u", "su", "ua", "au"):
                    cost, audit, out = best(i, new[:1], run + 1)
                    found.append((cost + 3, "I" + audit, ((new, ""), *out)))
        return min(found, default=(1 << 50, "", ()))

    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    cost, audit, out = best(0, "", 0)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    text = "\n".join(f"{a}:{b}" for a, b in out)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    after = spoiled(rows)
    return {c: brute([r for r in after if r[0] == c]) for c in {r[0] for r in rows}}


def results(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def make(n, seed, longest=12):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "Well?!", "", " \t", "a b c.", "été !\x0b", "x ", "cut", "Yes."]
    rows = []
    for c in range(n):
        conv = None if c == 3 else c
        for _ in range(rng.randint(1, longest)):
            turn = None if rng.random() < 0.08 else rng.randint(0, 9)
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "u", None])
            rows.append((conv, turn, role, rng.choice(texts + [None, f"own {rng.random()}."])))
    return rows


@pytest.mark.parametrize("size", [1024, 2])
def test_against_recursion(spark, monkeypatch, size):
    """Small segments make every conversation a long one: the folds of matrices give what the whole gives."""
    rows = make(250, size)
    rows += [rows[5]] * 3 + [rows[9]] * 2
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", cost int").repartition(3)
    if size == 1024:
        assert results(summaries(*repaired_parts(damaged(df)))) == expected(rows)
    else:
        monkeypatch.setattr(rp, "SEGMENT_ROWS", size)
        one = df.where("conv_id is null or conv_id < 60")
        short, long = repaired_parts(damaged(one))
        got = results(summaries(short, long))
        want = expected([r for r in rows if r[0] is None or r[0] < 60])
        assert got == want
        assert long.groupBy("conv_id").count().where("count > 3").count() > 20


def test_long_conversation_and_copies(spark):
    """A third of all rows in one conversation, most of them repeated, over many segments."""
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"text {t}" + rng.choice([".", "", "!"])) for t in range(3000)] + [(7, 5, "user", "same.")] * 500
    rows += [(100 + i % 500, i // 500, "user" if i // 500 % 2 == 0 else "assistant", f"t {i}.") for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = results(summaries(*repaired_parts(damaged(df))))
    after = spoiled(rows)
    small = {c: brute([r for r in after if r[0] == c]) for c in (100, 333, 599)}
    assert len(got) == 501 and {c: got[c] for c in small} == small
    own = sorted((r for r in after if r[0] == 7), key=lambda r: (r[1], r[2], r[3]))
    assert got[7][2] == len(own) - len({r[2:] for r in own if r[3].strip()}) - sum(not r[3].strip() for r in own)
    # the plain program over the whole conversation, without segments
    fresh, seen = [], set()
    for r in own:
        fresh.append(r[2:] not in seen)
        seen.add(r[2:])
    tensor = rp.Tensor([rp.codes([r[2] for r in own], [r[3] for r in own], [1] * len(own), fresh)])
    assert got[7][5] == int(tensor.costs(rp.ending(1))[0, 0, 0])


def test_messages_follow_the_form(spark):
    rows = make(80, 4)
    out = {}
    for r in sorted(messages(repair(damaged(spark.createDataFrame(rows, SCHEMA)))).collect(), key=lambda r: (r.part, r.chunk, r.place)):
        out.setdefault(r.conv_id, []).append(r.role[:1])
    assert out and all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in out.values())


def test_empty_tables_and_conversations_that_lose_all(spark):
    assert summaries(*repaired_parts(damaged(spark.createDataFrame([], SCHEMA)))).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    got = results(summaries(*repaired_parts(damaged(spark.createDataFrame([(1, gone, "user", "Hm."), (2, None, None, None)], SCHEMA)))))
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1] == (0, 0, 0, 0, 0, 0, "", empty)
    assert got == expected([(1, gone, "user", "Hm."), (2, None, None, None)])


def test_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 600_000 + "?"), (1, 1, "assistant", "ok " * 500_000 + "."), (1, 2, "user", "x " * 700_000)]
    assert results(summaries(*repaired_parts(damaged(spark.createDataFrame(rows, SCHEMA))))) == expected(rows)


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op12_conversation_repair"](spark, folder)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    found = db.sql(ORACLES["op12_conversation_repair"])
    assert sorted(found.columns) == sorted(got.columns)
    assert sorted(found.select(*got.columns).fetchall()) == sorted(map(tuple, got.collect()))
