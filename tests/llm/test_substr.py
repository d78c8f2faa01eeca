import hashlib
import random
import re

import pytest

from spotflow.llm.substr import deduplicate, divided

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window):
    words = [WORD.findall(t or "") for _, t in docs]
    low = {}
    for (i, _), ws in zip(docs, words, strict=True):
        for p in range(len(ws) - window + 1):
            if i is not None:
                low[tuple(ws[p : p + window])] = min(i, low.get(tuple(ws[p : p + window]), i))
    for (i, _), ws in zip(docs, words, strict=True):
        gone = {q for p in range(len(ws) - window + 1) if i is not None and low[tuple(ws[p : p + window])] < i for q in range(p, p + window)}
        kept = " ".join(w for q, w in enumerate(ws) if q not in gone)
        yield i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize(("window", "gram", "gather", "sort"), [(13, 4, 48 << 20, 48 << 20), (4, 2, 2000, 300), (4, 2, 30_000, 900)])
def test_against_brute_force(spark, window, gram, gather, sort):
    rng = random.Random(window)
    vocab = ["a", "bb", "é", "d e", "ff"] if window == 4 else [f"w{i}" for i in range(30)]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", "\n", "\t ", "\x0b"]) for _ in range(n))
    shared = [text(20) for _ in range(4)]
    docs = [(i, text(rng.randint(0, 30)) + rng.choice([*shared, ""]) + text(rng.randint(0, 30)) + rng.choice([*shared, ""])) for i in rng.sample(range(200), 120)]
    docs += [(300, None), (301, ""), (302, "   "), (None, shared[0]), (303, shared[0] * 300), (5, shared[1]), (5, shared[1]), (304, text(3)), *((400 + i, docs[0][1]) for i in range(40))]
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, n_words int, _row string").repartition(3)
    got = deduplicate(df, window=window, gram=gram, gather_bytes=gather, sort_bytes=sort).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(docs, window), key=str)


def test_input_that_comes_out_of_a_join(spark):
    """Its rows come in another order, and in other partitions, each time that it is read."""
    rng = random.Random(2)
    shared = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(20)) for _ in range(30)]
    docs = [(i, " ".join(rng.choice(shared) for _ in range(rng.randint(1, 3))) + f" t{i}") for i in range(1500)]
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(40)
    right = spark.createDataFrame([(i, "x" * 3000) for i, _ in docs], "doc_id long, wide string").repartition(7)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        found = deduplicate(left.hint("merge").join(right, "doc_id"))
        got = found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, got)) == sorted(brute(docs, 13)) and "wide" in found.columns


def test_many_rows_of_one_key(spark):
    """A bucket that no dealing out makes smaller: the same windows under the same key."""
    rng = random.Random(9)
    passage = " ".join(rng.choice("abcdefgh") * 2 for _ in range(30))
    docs = [(7, f"{passage} u{i}" if i % 3 else passage) for i in range(300)] + [(3, passage[10:]), (9, passage)]
    got = deduplicate(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), window=5, gram=2, gather_bytes=4000, sort_bytes=500)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == sorted(brute(docs, 5))


def test_keys_have_to_be_numbers(spark):
    with pytest.raises(ValueError):
        deduplicate(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_empty(spark):
    assert deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def shuffled_bytes(spark):
    """Bytes that all stages so far have written for a shuffle."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_that_lose_nothing_are_not_shuffled(spark, tmp_path):
    """Texts of ten long words, with no window of 13, beside a few that repeat a passage."""
    rng = random.Random(4)
    passage = " ".join(f"w{i}" for i in range(20))
    docs = [(i, " ".join(rng.randbytes(100).hex() for _ in range(10))) for i in range(500)] + [(1000 + i, f"{passage} {i}") for i in range(5)] + [(None, passage)]
    spark.createDataFrame(docs, "doc_id int, text string").write.parquet(str(tmp_path / "docs"))
    before = shuffled_bytes(spark)
    got = deduplicate(spark.read.parquet(str(tmp_path / "docs"))).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert shuffled_bytes(spark) - before < 200_000  # the texts are 1,000,000 bytes
    assert sorted(map(tuple, got), key=str) == sorted(brute(docs, 13), key=str)


@pytest.mark.parametrize("most", [1 << 25, 64])
def test_documents_divided_by_bits(spark, monkeypatch, most):
    monkeypatch.setattr("spotflow.llm.substr.MOST_BITS", most)
    base = spark.createDataFrame([(i // 2 - 600,) for i in range(4000)] + [(None,)], "k long")
    runs = spark.createDataFrame([(i * 37 - 600,) for i in range(50)] * 3, "doc long")
    touched, whole = ([r.k for r in part.collect()] for part in divided(base, runs, "k", "doc"))
    key = lambda k: (k is None, k)
    assert sorted(touched + whole, key=key) == sorted((r.k for r in base.collect()), key=key)
    assert not {i * 37 - 600 for i in range(50)} & set(whole) and (most == 64 or len(touched) < 500)
