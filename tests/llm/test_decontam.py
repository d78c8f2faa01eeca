import hashlib
import random
import re
import tracemalloc

import pytest

from spotflow.llm.decontam import Benchmark, contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, items, window=10):
    words = WORD.findall((text or "").translate(LOWER))
    hit, names = set(), set()
    for name, t in items:
        iw = WORD.findall((t or "").translate(LOWER))
        n = min(window, len(iw))
        for i in range(len(iw) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == iw[i : i + n]:
                    hit.update(range(j, j + n))
                    names.add(name)
    names = sorted(x for x in names if x is not None)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("item_bytes", [2 << 20, 150])
def test_against_brute_force(spark, item_bytes):
    rng = random.Random(5)
    vocab = ["a", "b", "Ça", "dé", "e1", "F"]
    text = lambda n: rng.choice(["", " ", "!"]) + "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n"]) for _ in range(n))
    items = [("1", text(12)), ("10", text(30)), ("2", "e1 F"), ("3", None), ("4", "..."), (None, text(11)), ("10", "dé dé dé dé")]
    docs = [(0, None), (1, ""), (2, text(300)), (2, text(300)), (None, items[1][1]), (5, "x " + items[0][1] + items[1][1]), (6, text(5000)), (7, "??")]
    df = spark.createDataFrame([(i, t, 7, "z") for i, t in docs], "doc_id long, text string, n_hit int, name string")
    got = contamination(df, spark.createDataFrame(items, "item_id string, text string"), item_bytes=item_bytes)
    rows = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()), key=str)
    assert rows == sorted(((i, *brute(t, items)) for i, t in docs), key=str)
    assert {r.name for r in got.collect()} == {"z"}


def test_a_large_benchmark(spark):
    """3 MB of items in groups: tables stay small, and each planted window is found."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(20_000)]
    items = [(f"i{k}", " ".join(rng.choice(vocab) for _ in range(300))) for k in range(1700)]
    words = {k: t.split() for k, t in items}
    planted = rng.sample(sorted(words), 60)
    docs = [(n, " ".join(["x"] * n + words[k][n % 200 : n % 200 + 10] + ["y"])) for n, k in enumerate(planted)]
    df = spark.createDataFrame(docs + [(1000 + i, " ".join(rng.choice(vocab) for _ in range(500))) for i in range(40)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in contamination(df, spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert len(got) == 100 and all(got[n]["items"] == [k] and got[n].n_hit == 10 for n, k in enumerate(planted))
    assert not any(r.contaminated for i, r in got.items() if i >= 1000)


def test_tables_are_some_forty_times_as_large_as_the_items():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(20_000)]
    items = [(str(k), " ".join(rng.choice(vocab) for _ in range(300))) for k in range(550)]
    tracemalloc.start()
    made = Benchmark(items, 10)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert made.tables and size < 60 * sum(len(t) for _, t in items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in contamination(docs, none).select("n_words", "contaminated").collect()] == [(2, False)]
    assert contamination(docs.where("false"), none).collect() == []


def test_a_benchmark_beyond_the_workers_against_sql(spark):
    """With 1 kB of items in a worker at most, windows are joined; the SQL of op3 has the same result."""
    import duckdb

    from spotflow.llm.queries import ORACLES

    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = sorted(map(tuple, contamination(docs.select("doc_id", "text"), items, item_bytes=1 << 10).select(*columns).collect()))
    db = duckdb.connect()
    for n in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
    assert got == sorted(db.sql(ORACLES["op3_decontaminate"]).select(*columns).fetchall()) and any(r[5] for r in got)
