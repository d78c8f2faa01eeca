"""Token counts of byte-level BPE vocabularies without encoding whole texts.

A vocabulary string that encodes alone as exactly one token needs no merging when it turns up as a
pre-token. Which strings those are is proved once, on the driver, with the tokenizer itself. Texts are
cut into pre-tokens; proven ones count one each, and only the rest are merged, each distinct one once
per task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_rows

#: Fixed value: the pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Merged pre-tokens that a task remembers; beyond it they are merged again, with the same result.
REMEMBERED = 400_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in -> byte: printable Latin-1 stands for itself, other bytes for 256, 257, ..."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """Merge ranks, special strings and the proven whole tokens of a byte-level BPE tokenizer file."""
    from tokenizers import Tokenizer

    spec = json.loads(open(path, encoding="utf-8").read())
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
    alphabet = byte_alphabet()
    raw = lambda s: bytes(alphabet[c] for c in s)
    ranks = {bytes([b]): b for b in range(256)}
    for pair in spec["model"]["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        ranks.setdefault(raw(left) + raw(right), len(ranks))
    special = [t["content"] for t in spec.get("added_tokens", [])]
    pattern, candidates = regex.compile(PRE_TOKEN), []
    for token in spec["model"]["vocab"]:
        if token in special:
            continue
        try:
            text = raw(token).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if pattern.fullmatch(text) and pattern.findall(text) == [text]:
            candidates.append(text)
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    encoded = library.encode_batch(candidates, add_special_tokens=False)
    whole = [t for t, e in zip(candidates, encoded, strict=True) if len(e.ids) == 1]
    return {"ranks": ranks, "special": special, "whole": whole}


class MergedCounts(dict):
    """Pre-token -> number of tokens; what isn't a proven whole token is merged when first asked for."""

    def __init__(self, vocabulary: dict):
        import tiktoken

        super().__init__(dict.fromkeys(vocabulary["whole"], 1))
        self._bpe = tiktoken.Encoding("counts", pat_str=PRE_TOKEN, mergeable_ranks=vocabulary["ranks"], special_tokens={})._core_bpe
        self._room = len(self) + REMEMBERED

    def __missing__(self, piece: str) -> int:
        n = len(self._bpe.encode_single_piece(piece.encode("utf-8")))
        if len(self) < self._room:
            self[piece] = n
        return n


_worker: dict = {}


def counter_for(vocabulary_broadcast) -> MergedCounts:
    """One counter for each Python worker, kept between its tasks."""
    key = vocabulary_broadcast.value["key"]
    if key not in _worker:
        _worker.clear()
        _worker[key] = MergedCounts(vocabulary_broadcast.value)
    return _worker[key]


def count_tokens(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = 1024) -> DataFrame:
    """Tokens of every text as the tokenizer library counts them (no added special tokens).

    Special strings inside a text count as one token, as is the library's default. Null texts count as
    empty: 0 bytes, 0 tokens. Null keys and repeated rows pass through, one result for each row. Other
    columns, whatever their names, are not read. Returns key, n_bytes, n_tokens, over_limit.
    """
    vocabulary = load_vocabulary(path)
    vocabulary["key"] = (path, len(vocabulary["ranks"]), len(vocabulary["whole"]))
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary file: of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter_for(sent)
        split = regex.compile(PRE_TOKEN).findall
        special = sent.value["special"]
        cut = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        get = counts.__getitem__
        for batch in batches:
            n_bytes, n_tokens = [], []
            for x in batch.column(1).to_pylist():
                x = x or ""
                n_bytes.append(len(x.encode("utf-8")))
                if cut is not None and any(s in x for s in special):
                    parts = cut.split(x)
                    n_tokens.append(len(parts) - 1 + sum(sum(map(get, split(p))) for p in parts))
                else:
                    n_tokens.append(sum(map(get, split(x))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], [key, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(df.dtypes)[key]
    return map_rows(df.select(key, text), run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
