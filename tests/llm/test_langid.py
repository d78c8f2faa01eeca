import random

import numpy as np

from spotflow.llm.langid import BINS, BUCKETS, cosines, identify, ngram_counts, share, train

PARTS = {"en": ["the", "ing", "tion", "er", "and", "wh"], "de": ["sch", "ung", "ein", "ü", "keit", "pf"], "es": ["ción", "ado", "que", "ñ", "os", "mente"]}


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda ps: "".join(rng.choice(ps) for _ in range(rng.randint(1, 3)))
    return [(i, " ".join(word(PARTS[lang]) for _ in range(rng.randint(5, 80))), lang) for i in range(n) for lang in [rng.choice(sorted(PARTS))]]


def test_held_out_accuracy_and_edges(spark):
    kind = "doc_id long, text string, lang string"
    taught = corpus(300, 1) + [(None, "the the", "en"), (9000, None, "en"), (9001, "the", None), (9002, "123 !!", "de"), (9003, "", "es")]
    model = train(spark.createDataFrame(taught, kind))
    assert model["langs"] == ["de", "en", "es"]
    asked = corpus(200, 2)
    asked += [(500, None, "en"), (501, "", None), (502, "12 %% 3", "x"), (None, "the ing " * 50_000, "y"), (500, None, "en"), (503, "日本語の文章です。" * 30, "ja")]
    df = spark.createDataFrame([(*r, "s", 1.0) for r in asked], kind + ", rejected string, score double")
    got = identify(df, model).collect()
    assert len(got) == len(asked)
    known = [r for r in got if r.doc_id is not None and r.doc_id < 500]
    assert sum(r.lang_pred == r.lang for r in known) >= 0.97 * len(known) and not any(r.rejected for r in known)
    rest = {r.text: r for r in got if r.doc_id is None or r.doc_id >= 500}
    for x in (None, "", "12 %% 3"):
        assert (rest[x].lang_pred, rest[x].score, rest[x].rejected) == ("und", 0.0, True)
    assert rest["the ing " * 50_000].lang_pred == "en"
    assert rest["日本語の文章です。" * 30].rejected
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = train(empty)
    assert identify(empty, model).collect() == []
    assert [r.lang_pred for r in identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).collect()] == ["und"]


def test_frequencies_and_threshold_are_of_all_rows(spark):
    rows = corpus(900, 7) + [(9000, "12 34", "en"), (None, "the the", "en")]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), per_language=20, slack=0.5)
    df = np.zeros(BUCKETS)
    for _, x, _ in rows[:900]:
        df[ngram_counts(x)[0]] += 1
    assert np.allclose(model["idf"], np.log(901 / (1 + df)) + 1, rtol=1e-6)
    own = np.sort([cosines(model, x)[model["owner"] == model["langs"].index(lang)].max() for _, x, lang in rows[:900]])
    assert abs(model["reject"] / 0.5 - own[4]) <= 2 / BINS


def test_against_brute_force(spark):
    """Nearest centroid by plain loops over byte n-grams; ties go to the first language."""
    model = train(spark.createDataFrame(corpus(200, 3), "doc_id long, text string, lang string"))
    texts = [x for _, x, _ in corpus(40, 4)] + ["Ä ö", "ß", "x"]
    got = {r.text: r for r in identify(spark.createDataFrame([(x,) for x in texts], "text string"), model).collect()}
    for x in texts:
        weights = np.zeros(BUCKETS)
        at, counts = ngram_counts(x)
        for a, c in zip(at, counts, strict=True):
            weights[a] = (1 + np.log(c)) * model["idf"][a]
        norm = np.sqrt((weights**2).sum())
        found = [(sum(weights * model["centroids"][:, j].astype(float)) / norm, -j) for j in range(model["centroids"].shape[1])]
        best, j = max(found)
        assert got[x].lang_pred == model["langs"][model["owner"][-j]] and abs(got[x].score - min(1, max(0, best))) < 1e-5
        assert got[x].rejected == (got[x].score < model["reject"])
    tied = {"langs": ["aa", "bb"], "owner": np.array([0, 1]), "centroids": np.ones((BUCKETS, 2), np.float32) / BUCKETS**0.5, "idf": np.ones(BUCKETS, np.float32), "reject": 0.0}
    assert {r.lang_pred for r in identify(spark.createDataFrame([("abc",)], "text string"), tied).collect()} == {"aa"}


def test_a_third_of_all_rows_has_one_key(spark):
    rows = corpus(300, 1) + [(5, f"the ing and {'tion ' * (i % 40)}", "en") for i in range(400)] + [(6, "the the ing", "en")] * 300
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), per_language=60)
    got = identify(spark.createDataFrame(corpus(90, 2), "doc_id long, text string, lang string"), model).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 85


def test_share_of_many_rows():
    assert share(10**10, 300) > 0 and share(10**12, 300) > 0
    assert share(10, 300) == 1 << 40 and share(10**9, 300) > 0 and abs(share(10**9, 300) * 10**9 / (1 << 40) - 300) < 1


def test_a_column_full_of_languages(spark):
    """Of more languages than a model holds, those with most rows are learned."""
    rows = corpus(200, 5) + [(1000 + i, f"rare words {i}", f"x{i}") for i in range(400)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=4)
    assert model["langs"] == ["de", "en", "es", "x0"]
