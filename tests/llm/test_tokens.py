import public_tokenizers
from tokenizers import Tokenizer

from spotflow.llm.tokens import count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "Hello  world\n\n a\tb ", "a<|endoftext|>b <|endoftext|>", "don't WE'LL  x", "é日本語 \U0001f600 z", "x" * 5000, "thanonre " * 3000, "12345 678,9!!! ...\r\n", "\x00\x01"]


def test_counts_match_the_library(spark):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(None, "abc", None), (1, "", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    library = Tokenizer.from_file(PATH)
    got = sorted(map(tuple, count_tokens(df, PATH, limit=1024).collect()), key=str)
    want = []
    for i, t, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
