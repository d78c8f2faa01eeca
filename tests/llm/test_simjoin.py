import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotflow.graph import components
from spotflow.llm.simjoin import allocation, bands, candidates, jaccard_components, representatives, shingles, signatures

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text, k):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    n = min(k, len(ws))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else set()


def brute(docs, k=4, percent=85):
    own = [sets(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        if own[i] and own[j] and 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j]):
            root[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            low[find(i)] = min(key, low.get(find(i), key))
    return [(key, len(own[i]), low.get(find(i))) for i, (key, _) in enumerate(docs)]


def test_allocation_covers_the_limit():
    for percent in (85, 80, 50):
        for band, (low, high) in enumerate(bands(percent)[:60]):
            limit, m, near, spare = allocation(band, percent)
            assert limit == (100 - percent) * high // percent and (not limit or m >= near and m + near >= limit + 1 + spare)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(3)
    none = np.zeros(0, np.uint64)
    for _ in range(1500):
        n = int(rng.integers(6, 120))
        x = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64))
        common = np.sort(rng.choice(x, n // 3))
        y = x[rng.random(len(x)) > rng.choice([0, 0.05, 0.12])]
        y = np.unique(np.concatenate([y, rng.integers(1, 1 << 63, int(rng.integers(0, n // 10 + 2)), dtype=np.uint64)]))
        shared = len(np.intersect1d(x, y))
        if 100 * shared >= 85 * (len(x) + len(y) - shared) and shared < max(len(x), len(y)):
            for often in (none, common):
                assert len(np.intersect1d(signatures(x, often, 85), signatures(y, often, 85)))


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_against_brute_force(spark, k, percent):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    docs = []
    for _ in range(40):
        words = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 8, 14, 25, 60, 150]))] + rng.choice([[], passage])
        for _ in range(rng.randint(1, 5)):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append((len(docs) * 7 % 1009, rng.choice([" ", "\n"]).join(x.upper() if rng.random() < 0.1 else x for x in w)))
    docs += [(5000, None), (5001, ""), (5002, " \t"), (None, docs[0][1]), (None, "lonely words are here now"), docs[3], docs[3], (6000, "z " * 30_000), (6001, "z " * 29_000)]
    df = spark.createDataFrame([(*d, 3, "x") for d in docs], "doc_id long, text string, component_id int, label string").withColumn("set", F.lit(0)).repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, k=k, percent=percent).collect()]
    want = brute(docs, k, percent)
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = [(r.doc_id, r.text) for r in representatives(df, k=k, percent=percent).select("doc_id", "text", "set", "label").collect()]
    no_words = [d for d, w in zip(docs, want, strict=True) if not w[1]]
    assert len(kept) == len({w[2] for w in want if w[1] and w[2] is not None}) + 1 + len(no_words)  # one component has null keys only
    assert {k for k, t in kept if k is not None and t and t.split()} == {w[2] for w in want if w[1] and w[2] is not None}


def test_components_of_a_long_chain(spark):
    rows = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (3, 160), (None, 4), (500, 501), (501, 500)]
    got = {r.node: r.label for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert all(got[i] == 3 for i in range(100, 161)) and got[7] == 7 and got[501] == 500


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    names = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(400)]
    rows = [(rng.choice(names[:300]), rng.choice(names[:300])) for _ in range(220)] + list(zip(names[300:], names[301:], strict=False)) + [(names[299], names[299])]
    low = {n: n for e in rows for n in e}
    for _ in low:
        before = dict(low)
        for a, b in rows:
            low[a] = low[b] = min(low[a], low[b])
        if before == low:
            break
    assert {r.node: r.label for r in components(spark.createDataFrame(rows, "a long, b long")).collect()} == low
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_copies_linked_only_through_one_another(spark):
    """Copies that each differ from the next: no leader is similar to all, some are similar to none."""
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(3000)]
    base = [rng.choice(vocab) for _ in range(120)]
    docs = []
    for i in range(60):
        w = list(base)
        for j in rng.sample(range(120), rng.choice([1, 2, 3, 4, 5])):
            w[j] = rng.choice(vocab)
        docs.append((1000 - i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    want = sorted(brute(docs))
    for tiles in ({}, {"tile_rows": 7, "tile_bytes": 5000}):
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, k=4, percent=85, **tiles).collect()) == want


def test_rows_grow_with_a_group_and_not_with_its_square(spark):
    """2,000 near copies: what is stored about a set is bounded by its signatures."""
    rng = random.Random(1)
    vocab = [f"v{i}" for i in range(5000)]
    base = [rng.choice(vocab) for _ in range(60)]
    docs = []
    for i in range(2000):
        w = list(base)
        w[rng.randrange(60)] = rng.choice(vocab)
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    each = max(len(signatures(shingles(t, 4), np.zeros(0, np.uint64), 85)) for _, t in docs[:50])
    assert candidates(df, "text", 4, 85).count() <= each * len(docs)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, k=4, percent=85).collect()) == sorted(brute(docs))


def test_buckets_are_grouped_by_their_smallest_component(spark):
    """A row of buckets, each with a set of the one before: no group holds the row, and none reaches beyond what it met."""
    from spotflow.llm.simjoin import compared_groups, grouped_buckets, unsettled

    held = spark.createDataFrame([(100 + i, i + j) for i in range(0, 40, 2) for j in (0, 1, 2)] + [(200, 0), (200, 2), (300, 5), (300, 6), (300, 6)], "bucket long, node long")
    labels = spark.createDataFrame([(5, 5), (6, 5)], "node long, label long")
    left = unsettled(held, labels)
    assert {r.bucket for r in left.collect()} == {100 + i for i in range(0, 40, 2)} | {200}
    groups = {}
    for r in grouped_buckets(left).collect():
        groups.setdefault(r.group, set()).add(r.node)
    assert groups[0] == {0, 1, 2} and len(groups) == 20 and max(map(len, groups.values())) <= 4
    same = spark.createDataFrame([(n, "a b c d e f" if n in (1, 3) else "u v w x y z") for n in (1, 2, 3)], "node long, text string")
    rows = spark.createDataFrame([(5, 1, 1), (5, 2, 2), (6, 2, 2), (6, 3, 3)], "group long, node long, label long")
    assert compared_groups(rows, same, 4, 85, 100, 1 << 20).collect() == []  # 1 and 3 are alike, and share no group
    assert {tuple(r) for r in compared_groups(rows.withColumn("group", rows.group * 0), same, 4, 85, 100, 1 << 20).collect()} == {(1, 3)}


def test_links_rest_on_words(spark):
    """Equal hashes of unlike texts make no link."""
    from spotflow.llm.simjoin import similar

    assert similar("a b c d e", "A b c d\te", 4, 85) and similar("One two", "one TWO", 4, 85)
    assert not similar("a b c d e", "a b c d f", 4, 85) and not similar("a b", "a b c", 4, 85)


def test_input_that_comes_out_of_a_join(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(30))) for i in range(700)]
    docs += [(1000 + i, t + " zz") for i, t in docs[:400]]
    right = spark.createDataFrame([(i, "x" * 3000) for i, _ in docs], "doc_id long, wide string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        kept = representatives(spark.createDataFrame(docs, "doc_id long, text string").repartition(40).hint("merge").join(right, "doc_id")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r.doc_id, r.text) for r in kept) == sorted(docs[:700]) and kept[0].wide == "x" * 3000


def test_empty(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert representatives(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert len(shingles("a b")) == 1
