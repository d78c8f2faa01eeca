"""Benchmark decontamination by Wu-Manber search over words.

A pattern is a window of `window` consecutive item words, or all words of a shorter item. For each pattern
length, a shift table over blocks of two words says how far the search may jump, a bucket for each last
block holds the patterns that end in it, and a candidate counts only after all its words have been compared.

Items whose tables fit a worker are searched for where the texts are read. Of more items, only the shift tables, whose slots
are hashes of blocks, go to the workers, with a filter of the windows' hashes: both are of fixed size. The places that
these let through meet the patterns of their bucket in a join, which compares all words: one pass over the texts, however many
items there are.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Members, free_name, map_rows, member_filter, numbered, once, send, stored
from .substr import mix, rolling

#: A-Z become a-z; every other ASCII byte that is no digit and no a-z separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def fold_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(FOLD).split() if text else []


class WuManber:
    """Search tables for patterns of one length.

    Words are numbers; a pattern is the place of its first word in the items' words, so that a window costs a
    few numbers and no copy of its words. A bucket is named by a pattern's last block and its first word.
    """

    def __init__(self, length: int, flat: list[int], starts: list[int], words: int):
        self.length, self.block, self.flat, self.words = length, min(2, length), flat, words
        self.jump = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, int | list[int]] = {}
        shift, bucket = self.shift, self.bucket
        for p in starts:
            for end in range(self.block, length + 1):
                key = flat[p + end - 1] if length == 1 else flat[p + end - 2] * words + flat[p + end - 1]
                if shift.get(key, self.jump) > length - end:
                    shift[key] = length - end
            key = key * words + flat[p]
            held = bucket.get(key)
            if held is None:
                bucket[key] = p
            elif isinstance(held, int):
                bucket[key] = [held, p]
            else:
                held.append(p)

    def find(self, words: list[int]) -> Iterator[tuple[int, list[int]]]:
        """First word of every occurrence and the places of the patterns that occur there; unknown words are -1."""
        length, n, shift, jump, bucket, flat, base = self.length, len(words), self.shift.get, self.jump, self.bucket.get, self.flat, self.words
        i = length - 1
        while i < n:
            b = words[i]
            if length == 1:
                key = b
            else:
                a = words[i - 1]
                key = a * base + b if a >= 0 <= b else -1
            step = shift(key, jump)
            if step:
                i += step
                continue
            start = i - length + 1
            held = bucket(key * base + words[start])
            if held is not None:
                here = words[start : i + 1]
                places = [p for p in ((held,) if isinstance(held, int) else held) if flat[p : p + length] == here]
                if places:
                    yield start, places
            i += 1


class Benchmark:
    """Search tables of items(name, text), one for each pattern length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.number: dict[bytes, int] = {}
        flat: list[int] = []
        self.names: list[str | None] = []
        self.ends: list[int] = []
        starts: dict[int, list[int]] = defaultdict(list)
        for name, text in items:
            words = fold_words(text)
            length = min(window, len(words))
            if length:
                starts[length] += range(len(flat), len(flat) + len(words) - length + 1)
                flat += [self.number.setdefault(w, len(self.number)) for w in words]
                self.names.append(name)
                self.ends.append(len(flat))
        self.tables = [WuManber(length, flat, own, len(self.number) + 1) for length, own in sorted(starts.items())]

    def search(self, text: str | None) -> tuple[int, list[int], list[str]]:
        """How many words the text has, which are hit, and the items found."""
        words = list(map(self.number.get, fold_words(text), repeat(-1)))
        marked: set[int] = set()
        seen: set[int] = set()
        for t in self.tables:
            for start, places in t.find(words):
                marked.update(range(start, start + t.length))
                seen.update(places)
        found = {self.names[bisect_right(self.ends, p)] for p in seen}
        return len(words), sorted(marked), sorted(n for n in found if n is not None)


#: Slots of a hashed shift table, a byte each, and how many of them travel in one row.
SLOTS, CHUNK = 1 << 20, 1 << 16
U = np.uint64


def block_slots(hashes: np.ndarray, length: int) -> np.ndarray:
    """Slot of the block that ends at each word, from the first word that ends one on."""
    keys = hashes if length == 1 else hashes[:-1] * U(0x9E3779B97F4A7C15) + hashes[1:]
    return (mix(keys) >> U(44)).astype(np.int64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_signs(hashes: np.ndarray, length: int) -> np.ndarray:
    return mix(rolling(hashes, length) + U(length)).view(np.int64)


def hashed_shifts(items: DataFrame, window: int) -> dict[int, np.ndarray]:
    """A shift table for each pattern length: how far a search may jump behind a block that hashes to a slot.

    Blocks that share a slot share the smaller jump, which finds no fewer patterns. Tasks fill tables of fixed size; the least counts.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                hashes = word_hashes(fold_words(text))
                if n := min(window, len(hashes)):
                    block = min(2, n)
                    table = tables.setdefault(n, np.full(SLOTS, min(n - block + 1, 255), np.uint8))
                    # a block is nearest to the end of the earliest window that holds it
                    np.minimum.at(table, block_slots(hashes, n), np.clip(n - 1 - np.arange(block - 1, len(hashes)), 0, 255).astype(np.uint8))
        rows = [(n, k, table[k * CHUNK : (k + 1) * CHUNK].tobytes()) for n, table in tables.items() for k in range(SLOTS // CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["n", "chunk", "shifts"])

    def least(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(CHUNK, 255, np.uint8)
        for batch in batches:
            for x in batch.column(2).to_pylist():
                table = np.minimum(table, np.frombuffer(x, np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([table.tobytes()], pa.binary())], ["n", "chunk", "shifts"])

    schema = "n int, chunk int, shifts binary"
    out: dict[int, list] = defaultdict(lambda: [b""] * (SLOTS // CHUNK))
    for r in map_rows(items.select("text"), fill, schema).groupBy("n", "chunk").applyInArrow(least, schema).collect():  # SLOTS bytes for each length
        out[r.n][r.chunk] = r.shifts
    return {n: np.frombuffer(b"".join(parts), np.uint8) for n, parts in sorted(out.items())}


def patterns_of(items: DataFrame, window: int) -> DataFrame:
    """name, n, sign, words: every pattern of items(name, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = fold_words(text)
                if n := min(window, len(words)):
                    rows += [(name, n, sign, b" ".join(words[i : i + n]).decode()) for i, sign in enumerate(window_signs(word_hashes(words), n).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int64(), pa.string()))], ["name", "n", "sign", "words"])

    return map_rows(items.select("name", "text"), run, "name string, n int, sign long, words string")


def candidate_places(text: str | None, shifts: dict[int, np.ndarray], known: Members) -> tuple[int, list[dict]]:
    """Number of words, and the places that the shift tables stop at and the filter lets through: start, n, sign, words."""
    words = fold_words(text)
    hashes = word_hashes(words)
    found = []
    for n, table in shifts.items():
        if len(words) < n:
            continue
        steps = table[block_slots(hashes, n)].tolist()  # of the block that ends at word i + block - 1
        block, i, stops = min(2, n), n - 1, []
        while i < len(words):
            step = steps[i - block + 1]
            if not step:
                stops.append(i - n + 1)
                step = 1
            i += step
        if stops:
            signs = window_signs(hashes, n)[stops]
            for k in np.flatnonzero(known.has(signs)).tolist():
                found.append({"start": stops[k], "n": n, "sign": int(signs[k]), "words": b" ".join(words[stops[k] : stops[k] + n]).decode()})
    return len(words), found


def _met(docs: DataFrame, named: DataFrame, window: int, text: str) -> DataFrame:
    """Every column of docs, then n_words, hit_words and items, by a join with the patterns of items of any size."""
    kept, row = docs.columns, free_name(docs, "_row")
    patterns = stored(patterns_of(named, window), "patterns")
    known, sent = member_filter(patterns, "sign"), send(docs.sparkSession, hashed_shifts(named, window))  # SLOTS bytes for each length
    pair = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("sign", pa.int64()), ("words", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [candidate_places(x, sent.value[1], known) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pair)], [*kept, "n_words", "_places"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    read = docs.select(*kept, F.col(text).alias(free_name(docs, "_text")))
    made = map_rows(read, run, ", ".join([*kinds, "n_words long, _places array<struct<start: int, n: int, sign: bigint, words: string>>"]))
    made = numbered(made, row, "places")
    places = made.select(F.col(row).alias("row"), F.explode("_places").alias("p")).select("row", "p.*")
    window_key = ["n", "sign", "words"]  # the words decide, the sign deals them out
    hits = stored(places.join(patterns.select(*window_key).distinct(), window_key, "left_semi"), "hits")
    marked = hits.select("row", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("word")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("word")).alias("hit_words"))
    found = hits.select("row", *window_key).distinct().join(patterns.where("name IS NOT NULL"), window_key).select("row", "name").distinct()
    names = found.groupBy("row").agg(F.array_sort(F.collect_list("name")).alias("items"))
    both = marked.join(names, "row", "left").withColumnRenamed("row", row)
    none = {"hit_words": F.coalesce("hit_words", F.array().cast("array<int>")), "items": F.coalesce("items", F.array().cast("array<string>"))}
    return made.drop("_places").join(both, row, "left").select(*kept, "n_words", *(c.alias(k) for k, c in none.items()))


def _search(docs: DataFrame, items: list, window: int, columns: list[str], text: str) -> DataFrame:
    """columns of docs, then n_words, hit_words and items."""
    sent = send(docs.sparkSession, (items, window))  # at most item_bytes of texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value = sent.value
        use = once(key, lambda: Benchmark(*value))
        for batch in batches:
            found = [use.search(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            made = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in columns), *made], [*columns, "n_words", "hit_words", "items"])

    # the text comes last, a second time if it is one of the columns
    read = docs.select(*columns, F.col(text).alias(free_name(docs, "_text")))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema]
    return map_rows(read, run, ", ".join([*kinds, "n_words long, hit_words array<int>, items array<string>"]))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_key: str = "item_id", item_text: str = "text", item_bytes: int = 2 << 20) -> DataFrame:
    """Every column of docs, then n_words, hit_words (positions), items (names, sorted), n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a pattern is hit. Null or empty texts have no words; null items and
    items without words have no pattern; an item whose id is null marks words but has no name to list;
    items with the same id count once. Repeated rows of docs give repeated results. Columns of docs that
    bear a result's name are replaced by the result. Items whose texts sum to `item_bytes` at most are searched for by tables
    in the workers, which take some forty times as much; of more items, windows are joined, and the rows of docs
    are numbered and stored once.
    """
    added = ["n_words", "hit_words", "items", "n_hit", "n_items", "items_sha256", "contaminated"]
    if text in added:
        raise ValueError(f"the text column can't be named {text}")
    named = items.select(F.col(item_key).cast("string").alias("name"), F.col(item_text).alias("text")).where(F.length("text") > 0)
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs = docs.drop(*added)
    if total <= item_bytes:
        df = _search(docs, [tuple(r) for r in named.collect()], window, docs.columns, text)
    else:
        df = _met(docs, named, window, text)
    return df.withColumns({
        "n_hit": F.size("hit_words").cast("long"),
        "n_items": F.size("items").cast("long"),
        "items_sha256": F.sha2(F.concat_ws(",", F.col("items")), 256),
        "contaminated": F.size("hit_words") > 0,
    })
