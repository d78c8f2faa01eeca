import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from spotflow.llm import pieces
from spotflow.llm.pieces import decode, encode, load_model, merged_parts, parts_of, unit_cuts, viterbi_parts

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "   ", "Hello  world\n a\tb ", " lead", " " * 40 + "x" + " " * 17, "ﬁ ½ Å é é", "a▁b", "<s> x </s> <unk> <0x41>", "一\U0001f600 日本語 ", "\x00a", "thanonre! " * 3000, "x" * 500, "Ünïcödé123,45.6   e.g. don't", "abcdefghij" * 40 + " z", ")))((( ==>> --- ....", "áb̂ ​"]


def test_ids_match_the_library(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("abdeghinorst  ,.éß\n") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    df = spark.createDataFrame([(i if i else None, t, "c", 1) for i, t in enumerate(texts)] + [(7, texts[7], "c", 1)], "doc_id long, text string, unit string, ids int")
    got = encode(df, PATH)
    rows = got.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = library.encode(r.text or "")
        assert r.ids == want, r.text
        assert r.n_pieces == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<i4").tobytes()).hexdigest()
        assert r.round_trip == (r.text is not None and "▁" not in r.text)
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in decode(got, PATH).collect())


def test_units_are_forgotten_and_found_again(spark, monkeypatch):
    """Long texts and units, several crates and batches in a task, repeated rows, units that are forgotten on the way."""
    rng = random.Random(5)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    words = ["".join(rng.choice("aeinorsthé") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(60)] * 2 + ["ab" * 500_000, "the " * 100_000, " ".join(words) * 5, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    for name, value in (("REMEMBERED", 500), ("CRATE_ROWS", 7), ("COMMON", 300)):
        monkeypatch.setattr(pieces, name, value)
    got = {r.doc_id: r for r in encode(df, PATH).select("doc_id", "n_pieces", "ids_sha256").collect()}
    for i, t in enumerate(texts):
        want = np.array(library.encode(t or ""), "<i4")
        assert got[i].n_pieces == len(want) and got[i].ids_sha256 == hashlib.sha256(want.tobytes()).hexdigest()


def test_lost_units_raise():
    known = pieces.UnitIds(pieces.Codec(load_model(PATH)), np.zeros(0, np.int32), np.zeros(0, np.int64))
    known.add(np.array([0, 1]), pa.array(["▁the", "\x00"]), pa.array([0b10001, None], pa.int64()))
    assert known.of(np.array([1, 0, 1]))[0].tolist() == [3, *sentencepiece.SentencePieceProcessor(model_file=PATH).encode("the"), 3]
    with pytest.raises(RuntimeError):
        known.add(np.array([3]), pa.array(["x"]), pa.array([None], pa.int64()))


def test_merges_by_rank_and_again_and_again_are_alike(spark):
    model = load_model(PATH)
    assert model["disordered"] == {"▁" * 16}
    assert pieces.disordered({"ab": -5.0, "cd": -1.0, "abcd": -2.0, "bc": -9.0}) == {"abcd"}
    rng = random.Random(8)
    units = spark.createDataFrame([("▁" + "".join(rng.choice("aehinorst,") for _ in range(rng.randint(1, 30))),) for _ in range(2000)], "unit string").distinct().selectExpr("0 AS number", "unit", "CAST(NULL AS BINARY) AS whole")
    one = {r.unit: r.cuts for r in unit_cuts(units, model).collect()}
    assert one == {r.unit: r.cuts for r in unit_cuts(units, model | {"disordered": set(model["scores"])}).collect()}


def test_viterbi_of_a_vocabulary(spark):
    """The query's fold against the scalar best path over all words of a table."""
    from spotflow.llm.queries import QUERIES

    model = pieces.as_unigrams(load_model(PATH))
    price = lambda parts: sum(model["scores"].get(p, min(model["scores"].values()) - 10.0) for p in parts)
    rows = QUERIES["viterbi_units"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 1000
    for r in rows:
        got, want = parts_of(r.unit, r.cuts), viterbi_parts(r.unit, model["scores"], model["longest"])
        assert len(got) == r.n_pieces and abs(price(got) - price(want)) < 1e-9


def test_viterbi_of_words_of_any_length(spark, tmp_path):
    """Words whose cuts don't fit a long have their best path, too."""
    from spotflow.llm.queries import QUERIES

    words = ["thanonre" * k for k in (1, 7, 8, 9, 40)] + ["a" * 61, "a" * 62, "é\U0001f600x" * 30, "ab,1" * 5000, "x"]
    spark.createDataFrame([(" ".join(words[:6]),), (None,), (" \n".join(words[6:]),)], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(words[1],)], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = pieces.as_unigrams(load_model(PATH))
    unknown = min(model["scores"].values()) - 10.0
    rows = {r.unit[1:]: r for r in QUERIES["viterbi_units"](spark, str(tmp_path)).collect()}
    assert sorted(rows) == sorted(words)
    for word, r in rows.items():
        ends = list(itertools.accumulate(r.sizes))
        got = [r.unit[b - n : b] for n, b in zip(r.sizes, ends, strict=True)]
        want = viterbi_parts(r.unit, model["scores"], model["longest"])
        price = [sum(model["scores"].get(p, unknown) for p in parts if len(p) == 1 or p in model["scores"]) for parts in (got, want)]
        assert "".join(got) == r.unit and r.n_pieces == len(got) and all(len(p) == 1 or p in model["scores"] for p in got)
        assert price[0] == pytest.approx(price[1], abs=1e-6)
        assert (r.cuts is None) == (len(r.unit) > pieces.LONGEST)
        assert r.cuts is None or got == parts_of(r.unit, r.cuts)


def test_paths_without_edges(spark):
    """Of characters that no piece holds, each is one; units of several batches keep their sizes."""
    model = {"scores": {"a": -3.0, "ab": -4.0}, "merges": False, "disordered": set(), "longest": 2}
    units = ["xx", "aab", "ab" * 40, "x" * 62, "x" * 63, "a", "ba" * 40]
    found = pieces.unit_paths(spark.createDataFrame([(k, u, None) for k, u in enumerate(units)], "number int, unit string, whole binary"), model)
    got = {r.unit: r.sizes for r in found.collect()}
    assert got == {"xx": [1, 1], "aab": [1, 2], "ab" * 40: [2] * 40, "x" * 62: [1] * 62, "x" * 63: [1] * 63, "a": [1], "ba" * 40: [1] + [2] * 39 + [1]}


def test_null_and_empty_ids(spark):
    df = spark.createDataFrame([(None, 1), ([], 2), ([278], 3)], "ids array<int>, decoded int")
    assert [r.decoded for r in decode(df, PATH).collect()][:2] == [None, ""]


def test_empty(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_long_units_merge_alike():
    model = load_model(PATH)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for unit in ["▁" + "thanonreing" * 30, "▁" + "aab" * 50, "▁" * 70 + "x"]:
        assert merged_parts(unit, model["scores"]) == library.encode(unit[1:].replace("▁", " "), out_type=str)


def test_viterbi_against_enumeration(spark):
    scores = {"a": -3.0, "b": -3.5, "ab": -4.0, "ba": -4.1, "aba": -9.0, "bb": -6.5, "c": -2.0, "abc": -5.0}
    model = {"scores": scores, "merges": False, "disordered": set(), "longest": 3}
    units = ["".join(u) for n in (1, 2, 4, 6) for u in itertools.islice(itertools.product("abcx", repeat=n), 0, None, 1 + 7 * (n > 4))]
    got = {r.unit: r.cuts for r in unit_cuts(spark.createDataFrame([(k, u, None) for k, u in enumerate(units)], "number int, unit string, whole binary"), model).collect()}
    price = lambda parts: sum(scores.get(p, -19.0 if len(p) == 1 else -1e9) for p in parts)
    for u in units:
        best = max(price([u[i:j] for i, j in itertools.pairwise((0, *c, len(u)))]) for k in range(len(u)) for c in itertools.combinations(range(1, len(u)), k))
        assert abs(price(parts_of(u, got.get(u))) - best) < 1e-9, u
        assert abs(price(viterbi_parts(u, scores, 3)) - best) < 1e-9


def test_unigram_edges_come_by_character(spark):
    """The fold looks at each edge once: a list for each character, with an edge of its own where no piece is."""
    model = {"scores": {"a": -3.0, "ab": -4.0, "bé": -1.0}, "merges": False, "disordered": set(), "longest": 2}
    units = spark.createDataFrame([(0, "abé", None), (1, "xx", None), (2, None, None), (3, "a" * 70, None)], "number int, unit string, whole binary")
    got = {r.number: [sorted((e.start, e.size, e.cost) for e in ends) for ends in r.edges] for r in pieces.lattice(units, model).collect()}
    assert got == {0: [[(0, 1, 3.0)], [(0, 2, 4.0), (1, 1, 14.0)], [(1, 2, 1.0), (2, 1, 14.0)]], 1: [], 2: [], 3: []}
