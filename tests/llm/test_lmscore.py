import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from spotflow.llm.lmscore import Lattices, hot_threshold, load_pieces, score_texts, word_log10

PATH = public_tokenizers.path("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def segmentations(known, text):
    """Every way to cut text, as lists of pieces; a character without a piece is its bytes."""
    if not text:
        yield []
    for j in range(1, len(text) + 1):
        head = [text[:j]] if text[:j] in known else ["<byte>"] * len(text[0].encode()) if j == 1 else None
        if head:
            for rest in segmentations(known, text[j:]):
                yield head + rest


def brute_marginal(logs, text):
    return sum(math.exp(sum(map(logs.__getitem__, s))) for s in segmentations(logs, text))


def brute_expected(logs, text):
    total, counts = brute_marginal(logs, text), Counter()
    for s in segmentations(logs, text):
        share = math.exp(sum(map(logs.__getitem__, s))) / total
        for p in s:
            counts[p] += share
    return counts


def brute_fit(pieces, words, texts, rounds):
    logs = pieces["pieces"] | {"<byte>": pieces["byte"], "<end>": pieces["end"]}
    weight = {p: math.exp(x) * (256 if p == "<byte>" else 1) for p, x in logs.items()}
    scale, size = sum(weight.values()), len(pieces["pieces"])
    for _ in range(rounds):
        counts = Counter({"<end>": texts})
        for w in words:
            counts.update(brute_expected(logs, "▁" + w))
        total = sum(counts.values())
        logs = {p: math.log((counts[p] + size * weight[p] / scale) / (total + size)) - (math.log(256) if p == "<byte>" else 0) for p in logs}
    return logs


def test_marginal_against_enumeration():
    pieces = load_pieces(PATH)
    logs = pieces["pieces"] | {"<byte>": pieces["byte"]}
    words = ["a", "the", "thanonre", "ción", "x\U000100aay", "!!", "▁q", "日本", "ß"]
    want = [math.log10(brute_marginal(logs, "▁" + w)) for w in words]
    assert [word_log10(pieces, w) for w in words] == pytest.approx(want, rel=1e-9)
    lattices = Lattices(pieces)
    both = lattices.marginals(words, lattices.logs, lattices.logs - 1.0)
    assert (both[0] / math.log(10)).tolist() == pytest.approx(want, rel=1e-9) and (both[1] < both[0]).all()
    assert sum(map(math.exp, pieces["pieces"].values())) + 257 * math.exp(pieces["byte"]) == pytest.approx(1.0)


def test_expected_counts_against_enumeration():
    pieces = load_pieces(PATH)
    logs = pieces["pieces"] | {"<byte>": pieces["byte"]}
    lattices = Lattices(pieces)
    words = ["the", "the", "ción", "x\U000100aa", "ththe", "q"]
    want = sum((brute_expected(logs, "▁" + w) for w in words), Counter())
    got = lattices.expected(words, lattices.logs)
    assert {n: got[i] for i, n in enumerate([*lattices.names, "<byte>", "<end>"]) if got[i]} == pytest.approx(dict(want), rel=1e-9)


def test_long_words_dont_underflow():
    lattices = Lattices(load_pieces(PATH))
    long, twice = lattices.marginals(["w" * 5000, "w" * 10_000], lattices.logs)[0]
    assert math.isfinite(twice) and twice == pytest.approx(2 * long, rel=1e-2)


@pytest.mark.parametrize("hot", [1 << 18, 3, 0])
def test_against_brute_force(spark, hot):
    rng = random.Random(4)
    vocab = ["The", "the", "ción", "a", "b,", "zz"] + [f"q{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(100, None), (101, ""), (None, "the unseen"), (102, "wwxw"), docs[5], docs[5], (103, "a\tb\x0bc\n")]
    pieces = load_pieces(PATH)
    out = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for _, t in docs]
    counts = Counter(w for (i, _), ws in zip(docs, words, strict=True) if not out(i) for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    plain = brute_fit(pieces, [], 0, 0)
    fitted = brute_fit(pieces, sorted(w for w in counts if w is not None), counts[None], 2)
    spelled, refit = ({w: brute_marginal(logs, "▁" + w) for ws in words for w in ws} | {None: math.exp(logs["<end>"])} for logs in (plain, fitted))
    want = []
    for (i, _), ws in zip(docs, words, strict=True):
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*ws, None])
        score, other = (sum(math.log10((counts[w] + v * s[w]) / (n + v)) for w in [*ws, None]) for s in (spelled, refit))
        lattice = sum(math.log10(spelled[w]) for w in [*ws, None])
        want.append((i, out(i), len(ws) + 1, sum(counts[w] > 0 for w in [*ws, None]), n, base, score, lattice, other))
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double")
    got = sorted(map(tuple, score_texts(df, PATH, hot_words=hot, rounds=2).collect()), key=str)
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_input_that_comes_out_of_a_join(spark):
    docs = [(i, " ".join(f"w{i}" for _ in range(i % 50))) for i in range(800)]
    right = spark.createDataFrame([(i, "x" * 3000) for i, _ in docs], "doc_id long, wide string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        joined = spark.createDataFrame(docs, "doc_id long, text string").repartition(40).hint("merge").join(right, "doc_id")
        got = score_texts(joined, PATH, rounds=1).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(i, i % 50 + 1) for i, _ in docs]


def test_fitting_helps_held_out_texts(spark):
    """Fitted weights score texts that weren't learned from higher than the vocabulary's; these stay the score."""
    rng = random.Random(6)
    stems = ["".join(rng.choice("bdlmnrt") + rng.choice("aeiou") for _ in range(3)) for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(40))) for i in range(300)], "doc_id long, text string")
    rows = [score_texts(docs, PATH, rounds=k).where("held_out").collect() for k in (0, 1, 3)]
    total = [sum(r.fitted_score for r in own) for own in rows]
    assert total[0] < total[1] < total[2] and all(r.score == r.fitted_score for r in rows[0])
    assert len({round(sum(r.score for r in own), 6) for own in rows}) == len({round(sum(r.lattice_score for r in own), 6) for own in rows}) == 1


def test_hot_words_are_bounded(spark):
    words = spark.createDataFrame([(f"w{i}", n) for i, n in enumerate([1] * 50 + [5] * 20 + [90, 90, 400])], "word string, n long")
    for most in (0, 1, 2, 3, 22, 23, 1000):
        assert words.where(words.n >= hot_threshold(words, most)).count() <= most
    assert hot_threshold(words, 1000) == 5 and np.isfinite(hot_threshold(words, 0))


def test_empty(spark):
    assert score_texts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
