import random

import numpy as np

from spotflow.llm.quality import ENTRIES, FINE, SIZE, context_vectors, document_vectors, fit_network, index_entries, network_logits, quality_scores, sigmoid, token_counts, token_hashes, train, word_vectors

GOOD = ["the", "water", "of", "stone", "is", "cold", "and", "river"]


def make(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(GOOD) + str(rng.choice("abcdefgh")) for _ in range(rng.randint(5, 60))]
        y = int(rng.random() < 0.7)
        if not y:
            words = rng.choice([[w.upper() + "!!" for w in words], [w + "%%%" for w in words], [w for w in words for _ in range(9)]])
        rows.append((i, " ".join(words)))
        labels.append((i, y))
    return rows, labels


def test_tokens():
    a, owner = token_hashes(["The the  water!!", None, "", "the", "THE THE", "été ÉTÉ"])
    assert owner.tolist() == [0, 0, 0, 0, 3, 4, 4, 5, 5]
    assert a[0] == a[4] and a[1] != a[0] and a[5] != a[0] and a[6] == a[1]
    assert [x.tolist() for x in token_hashes([])] == [[], []] and token_hashes([" \n"])[0].tolist() == []


def test_a_long_tokens_order_counts():
    """Bytes behind any number of others still tell tokens apart."""
    a, b = "x" * 5000 + "ab" + "y" * 10, "x" * 5000 + "ba" + "y" * 10
    assert token_hashes([a])[0][0] != token_hashes([b])[0][0] == token_hashes(["z", b])[0][1]


def vectors_of(token):
    places, signs = index_entries(np.array([token], np.uint64))
    out = np.zeros(SIZE, np.int64)
    out[places[0]] = signs[0]
    return out


def brute_words(texts):
    """Index vector, and scaled context vector of tokens seen twice or more, by loops."""
    sums, seen = {}, {}
    for t in texts:
        own = token_hashes([t])[0].tolist()
        for i, token in enumerate(own):
            seen[token] = seen.get(token, 0) + 1
            for j in (i - 1, i + 1):
                if 0 <= j < len(own):
                    sums[token] = sums.get(token, np.zeros(SIZE, np.int64)) + vectors_of(own[j])
    none = np.zeros(SIZE, np.int64)
    return {k: np.round(sums.get(k, none) / max(np.linalg.norm(sums.get(k, none)), 1.0) * FINE).astype(int) for k, n in seen.items() if n >= 2}


def test_index_vectors():
    places, signs = index_entries(np.arange(5000, dtype=np.uint64) * np.uint64(977))
    assert all(len(set(p)) == ENTRIES for p in places.tolist()) and set(np.unique(places)) == set(range(SIZE)) and set(np.unique(signs)) == {-1, 1}
    assert len({(*p, *s) for p, s in zip(places.tolist(), signs.tolist())}) > 4500


def test_context_vectors(spark):
    rng = random.Random(2)
    texts = ["a b c", "c a", None, "", "b b", "a " * 300, "once"] + [" ".join(rng.choice("abcdefghijk") + rng.choice("xyz") for _ in range(40)) for _ in range(12)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = brute_words(texts)
    got = context_vectors(docs, "text", token_counts(docs, "text"))
    found = {r.token % (1 << 64): np.frombuffer(r.vector, np.int8).astype(int) for r in got.collect()}
    assert found.keys() == want.keys() and all((found[k] == want[k]).all() for k in want)


def test_many_tokens_are_gathered_in_parts(spark, monkeypatch):
    from spotflow.llm import quality

    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randint(0, 60)}" for _ in range(30)) for _ in range(40)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    want = {r.token: r.vector for r in word_vectors(docs)["table"].collect()}
    keys = np.array([5, 3, 5, 9, 3], np.uint64)
    rows = np.arange(10).reshape(5, 2)
    monkeypatch.setattr(quality, "HELD", 3)
    parts = list(quality.gathered((keys[i : i + 1], rows[i : i + 1]) for i in range(5)))
    total = {}
    for k, r in parts:
        for a, b in zip(k.tolist(), r.tolist()):
            total[a] = [x + y for x, y in zip(total.get(a, [0, 0]), b)]
    assert total == {3: [10, 12], 5: [4, 6], 9: [6, 7]} and len(want) >= 60


def test_held_out_accuracy_and_edges(spark):
    rows, labels = make(400, 1)
    rows += [(None, "x"), (1000, None), (1001, ""), (1002, "  "), (3, rows[3][1])]
    labels += [(None, 1), (5, None), (7, labels[7][1]), (9999, 0)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, score string")
    model = train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    more, truth = make(200, 2)
    more += [(2000, None), (2001, ""), (None, "the rivera " * 40_000), (5, more[5][1])]
    asked = spark.createDataFrame([(*r, "k") for r in more], "doc_id long, text string, score string")
    got = quality_scores(asked, model).collect()
    assert len(got) == len(more) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    want = dict(truth)
    assert np.mean([r.predicted == want[r.doc_id] for r in got if r.doc_id in want]) >= 0.95


def test_scores_against_loops(spark):
    """Scores are the network's at the plain mean of the tokens' vectors, sent or joined."""
    rows, labels = make(120, 5)
    rows += [(500, None), (501, ""), (502, "never seen before"), (3, rows[3][1]), (503, "the " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words = brute_words([t for _, t in rows])
    for common in (1 << 17, 5, 0):
        model = train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), common=common)
        assert len(model["words"]["tokens"]) == min(common, len(words))
        got = quality_scores(docs, model).collect()
        assert len(got) == len(rows)
        for i, text in [*rows[:20], *rows[-5:]]:
            own = token_hashes([text])[0].tolist()
            x = np.zeros(2 * SIZE)
            for t in own:
                x[:SIZE] += vectors_of(t) / np.sqrt(ENTRIES) / len(own)
                x[SIZE:] += words.get(t, np.zeros(SIZE)) / FINE / len(own)
            z = float(plain_network(model["net"], x)) / model["net"]["temperature"]
            assert all(abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 for r in got if r.doc_id == i)


def plain_network(net, x):
    """The network's logit by loops."""
    w, b, v, c = net["w"]
    hidden = [np.tanh(sum((x[i] - net["mean"][i]) / net["scale"][i] * w[i][k] for i in range(len(x))) + b[k]) for k in range(len(b))]
    return sum(h * v[k] for k, h in enumerate(hidden)) + c[0]


def test_document_vectors_keep_columns(spark):
    df = spark.createDataFrame([(None, "a b a", "x", 1), (2, None, None, 2), (2, "b", "y", None)], "key long, text string, vector string, _row int")
    made = document_vectors(df, word_vectors(df, common=1))
    assert made.columns[:3] == ["key", "vector", "_row"] and sorted((r.vector or "", r._row or 0) for r in made.collect()) == [("", 2), ("x", 1), ("y", 0)]


def test_labels_in_conflict_and_a_frequent_key(spark):
    """The majority of a key's labels counts, 1 if even; many rows of one key are one example."""
    rows, labels = make(200, 6)
    bad = [(i, 1 - y) for i, y in labels[:40]]
    docs = spark.createDataFrame(rows + [(3, f"REPEATED!! {i}") for i in range(300)], "doc_id long, text string")
    kind = "doc_id long, quality int"
    twice = spark.createDataFrame(labels * 2 + bad, kind)
    one, other = (train(docs, x) for x in (spark.createDataFrame(labels, kind), twice))
    assert np.allclose(one["net"]["w"][0], other["net"]["w"][0])
    even = train(docs, spark.createDataFrame([(1, 0), (1, 1), (2, 1)], kind))
    assert even["net"] is None and even["share"] == 1.0


def test_one_sort_of_label(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_scores(docs, train(docs, none)).collect()} == {0.5}
    assert quality_scores(docs.where("false"), train(docs.where("false"), none)).collect() == []


def test_temperature():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = (rng.random(2000) < sigmoid(2 * x[:, 0])).astype(float)
    net = fit_network(x, y)
    p = sigmoid(network_logits(net, x) / net["temperature"])
    assert abs(p[p > 0.8].mean() - y[p > 0.8].mean()) < 0.06
