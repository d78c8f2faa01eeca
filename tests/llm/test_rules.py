import random
import re
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spotflow.llm.queries import ORACLES, QUERIES
from spotflow.llm.rules import repeated, repetition, suffixes


def brute(text, least):
    """All repeats by comparing all windows."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)

    def windows(k):
        seen = {}
        for i in range(n - k + 1):
            seen.setdefault(tuple(words[i : i + k]), []).append(i)
        return {w: at for w, at in seen.items() if len(at) > 1}

    def cover(k):
        return {p for at in windows(k).values() for i in at for p in range(i, i + k)}

    count, longest = 0, 0
    for k in range(least, n):
        found = windows(k)
        if not found:
            break
        longest = k
        for at in found.values():
            before = {words[i - 1] if i else None for i in at}
            behind = {words[i + k] if i + k < n else None for i in at}
            count += len(before) > 1 and len(behind) > 1
    marks = sorted(cover(least))
    spans = [[p, p + 1] for p in marks]
    for i in range(len(spans) - 1, 0, -1):
        if spans[i][0] == spans[i - 1][1]:
            spans[i - 1][1] = spans[i][1]
            del spans[i]
    return n, len(cover(3)), count, longest, len(marks), spans


def check(texts, least):
    got = repeated(texts, least)
    for i, t in enumerate(texts):
        spans = [[s["begin"], s["end"]] for s in got["spans"][i]]
        own = tuple(got[c][i] for c in ("n_words", "n_repeat_words", "n_repeats", "longest_repeat", "n_covered"))
        assert (*own, spans) == brute(t, least)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n", max_size=60)), max_size=5), st.integers(3, 5))
def test_against_windows(texts, least):
    check(texts, least)


def test_longer_texts_and_periods():
    rng = random.Random(5)
    texts = ["a " * 70, "a b " * 40 + "c " + "a b " * 20, None, "", "x y z " * 30, "a b c d e f g h\n" * 12]
    texts += [" ".join(rng.choice("abc") for _ in range(90)) for _ in range(4)]
    texts += [texts[0]] * 2
    check(texts, 3)
    check(texts, 8)


def test_suffix_array():
    rng = np.random.default_rng(2)
    for size in (0, 1, 2, 300):
        words, owner = rng.integers(0, 3, size), np.sort(rng.integers(0, 3, size))
        sa, lcp = suffixes(words, owner)
        tail = lambda i: tuple(words[i:][owner[i:] == owner[i]])  # noqa: E731, B023
        assert sorted(sa.tolist()) == list(range(size)) and sa.tolist() == sorted(range(size), key=lambda i: (owner[i], tail(i)))
        for p in range(1, size):
            a, b = tail(sa[p - 1]), tail(sa[p])
            same = 0
            while owner[sa[p]] == owner[sa[p - 1]] and same < min(len(a), len(b)) and a[same] == b[same]:
                same += 1
            assert lcp[p] == (same if same >= 2 else 0)


def test_a_long_text_of_one_line():
    got = repeated(["one two three four five\n" * 60_000], 8)
    assert got["longest_repeat"] == [5 * 59_999] and got["n_covered"] == got["n_repeat_words"] == [300_000]


def test_columns_and_verdict(spark):
    rng = random.Random(1)
    plain = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(300))
    part = " ".join(f"p{i}" for i in range(70))
    rows = [(1, plain), (2, f"{plain}\n{part}\nx\n{part}"), (3, "short"), (4, None), (5, ""), (6, (plain + "\n") * 3), (7, "a | b é<\n a\n\na | b é<\n \t\na | b é<" + " x" * 5), (None, plain), (1, plain)]
    df = spark.createDataFrame([(*r, "k", 3) for r in rows], "doc_id long, text string, kept string, N_words int").drop("N_words").repartition(3)
    got = repetition(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].kept and by[None].kept and by[1].spans == [] and by[1].word_chars == len(plain.replace(" ", ""))
    assert not by[2].base_failed and by[2].longest_repeat > 60 and not by[2].kept
    assert all(by[k].base_failed and not by[k].kept for k in (3, 4, 5, 6, 7))
    assert by[6].n_dup_lines == 2 and by[6].n_covered == 900 and (by[7].n_symbols, by[7].n_dup_lines, by[7].n_words) == (6, 1, 18)
    assert repetition(df.where("false")).collect() == []


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op13_quality_rules"](spark, folder)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = db.sql(ORACLES["op13_quality_rules"])
    rows = got.collect()
    assert sorted(found.select(*got.columns).fetchall()) == sorted(map(tuple, rows))
    assert Counter(r.kept for r in rows)[True] > 100
