import random
from collections import Counter
from itertools import combinations

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from test_decontam import brute as contaminated
from test_simjoin import brute as linked
from test_substr import brute as repeated

SF = "/root/testdata/sf0.001"


def test_each_stage_on_what_its_predecessor_kept(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    kind = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).schema
    docs += [(100_000, None, "en", "s", None), (100_001, "12 34 !", "en", "s", 7), (100_002, docs[3][1], "en", "s", docs[3][4])]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    apply = lambda name, rows: [tuple(r) for r in stages[name](spark, spark.createDataFrame(rows, kind), SF).collect()]

    kept = apply("language", docs)
    assert not {100_000, 100_001} & {d[0] for d in kept} and len(kept) >= 0.99 * (len(docs) - 2)
    assert set(kept) <= set(docs)

    one = apply("near_duplicates", kept)
    assert {d[0] for d in one} == {c for _, _, c in linked([(d[0], d[1]) for d in kept])} and set(one) <= set(kept)

    cut = apply("repeated_passages", one)
    found = {i: (n, gone) for i, n, gone, _ in repeated([(d[0], d[1]) for d in one], 13)}
    assert {d[0] for d in cut} == {i for i, (n, gone) in found.items() if not gone or gone < n}
    before = {d[0]: d for d in one}
    for d in cut:
        n, gone = found[d[0]]
        assert d == before[d[0]] if not gone else (len(d[1].split(" ")) == n - gone and d[4] == len(d[1]))

    clean = apply("decontaminate", cut)
    assert {d[0] for d in clean} == {d[0] for d in cut if not contaminated(d[1], items)[4]}

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    coded = stages["encode"](spark, spark.createDataFrame(clean, kind), SF).collect()
    texts = {d[0]: d[1] for d in clean}
    assert len(coded) == len(clean) and all(r.ids == library.encode(texts[r.doc_id]) and r.round_trip for r in coded)


def test_near_duplicates_of_five_words_and_four_fifths(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    docs = [" ".join(base), " ".join(base[:164]), " ".join(base[:150]), "one two three four", "one two three four"]
    for _ in range(25):
        words = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([7, 12, 30, 90, 240]))]
        for _ in range(rng.randint(1, 4)):
            w = words[: len(words) - rng.randrange(1 + len(words) // 5)]
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(5000)}"
            docs.append(" ".join(w))
    own = []
    for t in docs:
        ws = t.split(" ")
        own.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))})
    low = list(range(len(docs)))
    for i, j in combinations(range(len(docs)), 2):
        if 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]):
            a, b = sorted((low[i], low[j]))
            low = [a if x == b else x for x in low]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()}
    assert kept == set(low) and 1 not in kept


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, name):
    """Empty tables, rows that come three times, nulls, and extra columns with names that stages use themselves."""
    stage = dict(corpus_pipeline.STAGES)[name]
    full = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    kind = full.schema
    assert stage(spark, spark.createDataFrame([], kind), SF).collect() == []
    rows = [tuple(r) for r in full.where("doc_id < 25").collect()]
    odd = [(None, "the same words as ever " * 8, "en", "s", 1), (900, "plain text here", None, None, None)]
    df = spark.createDataFrame(rows * 3 + odd, kind)
    for extra in ("_row", "_tag", "_runs", "set", "label", "kept", "ids", "items", "n_words", "rejected"):
        df = df.withColumn(extra, F.lit("x"))
    got = stage(spark, df, SF)
    want = stage(spark, spark.createDataFrame(rows * 3 + odd, kind), SF)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    copies = Counter(r.doc_id for r in got.collect() if r.doc_id is not None and r.doc_id < 25)
    assert set(copies.values()) == ({1} if name == "near_duplicates" else {3})
