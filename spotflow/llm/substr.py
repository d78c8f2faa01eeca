"""Substring deduplication with super-k-mer partitioning.

A window is `window` consecutive words. Its minimiser is the smallest hash of the `gram`-word sequences in
it; consecutive windows with one minimiser are a super-k-mer, which travels as one packed string to the
minimiser's bucket. Equal windows have equal minimisers, so a bucket can sort its windows and find, exactly,
the smallest document in which each one starts. A bucket that a frequent minimiser makes too large is dealt
out again by other minimisers of its windows, and in the end by the windows' own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import free_name, map_rows, returned, stored

#: Bytes that the super-k-mers gathered by a task take in memory before it hands them on, and what one takes
#: beside its string: the string's and the dict's overhead and six list entries.
GATHER, ENTRY = 80 << 20, 300
#: Bytes of unpacked strings that a bucket sorts, and beyond which it is dealt out again in FAN buckets: by
#: other minimisers in the first SALTED rounds, by window up to round DEALT. What is large even then holds few
#: windows, each very often.
SORT, FAN, SALTED, DEALT = 16 << 20, 256, 2, 4
#: Bytes of text for each bucket.
BUCKET = 3 << 19
#: Keys that are broadcast where they have several texts; more are joined.
SENT_KEYS = 100_000
#: Bits that say which documents may have runs to remove: so many for each document that has, in words of 64,
#: up to a bound beyond which more texts are joined than have to be.
BITS, MOST_BITS = 16, 1 << 25
#: How a packed super-k-mer's document, tag, first word and number of windows are stored: as differences.
FIELDS = ("<i8", "<i8", "<i4", "<i4")
RUNS = ("doc", "tag", "first", "last")
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def rolling(v: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every n neighbours, built up by doubling."""
    out, have, lift = None, 0, np.uint64(1)
    size, power, part = 1, BASE, v
    with np.errstate(over="ignore"):
        while True:
            if n & size:  # these `size` values stand before the ones there are
                m = max(0, min(len(part), len(v) - have - size + 1))
                out = part[:m] if out is None else part[:m] * lift + out[size : size + m]
                have, lift = have + size, lift * power
            if have == n:
                return out
            part = part[: max(0, len(part) - size)] * power + part[size:]
            power, size = power * power, size * 2


def sliding_min(v: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while size * 2 <= n:
        v, size = np.minimum(v[: max(0, len(v) - size)], v[size:]), size * 2
    rest = n - size
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


class Packer:
    """Gathers a task's super-k-mers; equal ones of several documents leave as the smallest document's only.

    The others are resolved at once: their windows start in a smaller document of the same task. A document
    is its key and a tag that tells texts of one key apart.
    """

    def __init__(self, window: int, gram: int, buckets: int, gather_bytes: int, salt: int = 0, below: int = 0):
        """below: the bucket of which these are parts, whose numbers follow from its own; salt: which minimisers."""
        self.window, self.gram, self.buckets, self.gather = window, gram, buckets, gather_bytes
        self.salt, self.below = np.uint64(salt * 0x51ED270B), below * buckets
        self.clear()

    def clear(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.strings: list[bytes] = []
        self.docs: list[int] = []
        self.tags: list[int] = []
        self.starts: list[int] = []
        self.counts: list[int] = []
        self.into: list[int] = []
        self.done: list[tuple[int, int, int, int]] = []
        self.size = 0

    def add(self, docs: list[int | None], tags: list[int], texts: list[str | None]) -> None:
        words: list[bytes] = []
        sizes, keys, marks = [], [], []
        for doc, tag, text in zip(docs, tags, texts, strict=True):
            if doc is None or not text:
                continue
            own = text.encode("utf-8").split()
            if len(own) >= self.window:
                sizes.append(len(own))
                keys.append(doc)
                marks.append(tag)
                words += own
        if words:
            self.cut(words, np.array(sizes), keys, marks, np.zeros(len(sizes), np.int64))

    def add_packed(self, blob: bytes) -> None:
        (docs, tags, starts, counts), strings = unpacked(blob)
        self.cut(strings.split(), counts + self.window - 1, docs.tolist(), tags.tolist(), starts)

    def cut(self, words: list[bytes], sizes: np.ndarray, docs: list[int], tags: list[int], offset: np.ndarray) -> None:
        """Super-k-mers of runs of words, each of a window at least, which begin at a word of their documents."""
        n = len(words)
        hashes = mix(np.fromiter(map(crc32, words), np.uint64, n) + BASE)
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1)
        begins = ends - lengths - 1
        least = sliding_min(mix(rolling(hashes, self.gram) + self.salt), self.window - self.gram + 1)
        end_of = np.cumsum(sizes)
        start_of = end_of - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero(owner[: len(least)] == owner[self.window - 1 : self.window - 1 + len(least)])
        value = least[at]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (owner[at[1:]] != owner[at[:-1]]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(fresh)
        count = np.diff(np.append(begin, len(at)))
        word_at = at[begin]
        left, right = begins[word_at], ends[word_at + count + self.window - 2] - 1
        whose = owner[word_at]
        packed = b" ".join(words)
        into = (value[begin] % np.uint64(self.buckets)).astype(np.int64) + self.below
        fields = (x.tolist() for x in (left, right, whose, word_at - start_of[whose] + offset[whose], count, into))
        self.keep((packed[a:b], docs[k], tags[k], start, many, bucket) for a, b, k, start, many, bucket in zip(*fields, strict=True))

    def keep(self, found: Iterable[tuple[bytes, int, int, int, int, int]]) -> None:
        """String, document, tag, first word, number of windows and bucket of each super-k-mer."""
        seen, docs, window = self.seen, self.docs, self.window
        for s, doc, tag, start, count, bucket in found:
            old = seen.get(s)
            if old is not None and docs[old] != doc:
                if docs[old] < doc:
                    self.done.append((doc, tag, start, start + count + window - 1))
                else:
                    self.done.append((docs[old], self.tags[old], self.starts[old], self.starts[old] + count + window - 1))
                    docs[old], self.tags[old], self.starts[old] = doc, tag, start
                self.size += 100
                continue
            if old is None:
                seen[s] = len(docs)
            docs.append(doc)
            self.tags.append(tag)
            self.starts.append(start)
            self.counts.append(count)
            self.into.append(bucket)
            self.strings.append(s)
            self.size += len(s) + ENTRY

    def full(self) -> bool:
        return self.size > self.gather

    def leave(self) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
        """Buckets, bytes before compression and packed super-k-mers; then, with 0 bytes, what is resolved already."""
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        into = np.array(self.into, np.int64)
        order = np.argsort(into, kind="stable")
        edges = np.flatnonzero(np.diff(into[order], prepend=-1)) if len(order) else np.zeros(0, np.int64)
        fields = [np.array(x, np.int64) for x in (self.docs, self.tags, self.starts, self.counts)]
        strings, done = self.strings, self.done
        self.clear()
        buckets, raw, blobs = [], [], []
        for a, b in zip(edges, [*edges[1:], len(order)][: len(edges)], strict=True):
            own = order[a:b]
            blob = np.int64(len(own)).tobytes() + b"".join(np.diff(f[own], prepend=0).astype(t).tobytes() for f, t in zip(fields, FIELDS, strict=True)) + b"\n".join([strings[i] for i in own])
            buckets.append(int(into[own[0]]))
            raw.append(len(blob))
            blobs.append(squeeze(blob))
            if len(blobs) == 256:
                yield buckets, raw, blobs
                buckets, raw, blobs = [], [], []
        if done:
            buckets.append(done[0][0] % self.buckets)
            raw.append(0)
            blobs.append(squeeze(np.array(done, np.int64).tobytes()))
        if blobs:
            yield buckets, raw, blobs


def unpacked(blob: bytes) -> tuple[tuple[np.ndarray, ...], bytes]:
    """Documents, tags, first words and numbers of windows of packed super-k-mers, and their strings, one a line."""
    import zstandard

    whole = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(whole[:8], np.int64)[0])
    at, fields = 8, []
    for t in FIELDS:
        size = n * np.dtype(t).itemsize
        fields.append(np.cumsum(np.frombuffer(whole[at : at + size], t).astype(np.int64)))
        at += size
    return tuple(fields), whole[at:]


class Numbers(dict):
    """Words numbered in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def covered(parts: list[tuple[np.ndarray, ...]], strings: list[bytes], window: int) -> np.ndarray:
    """Documents, tags, first words and ends of runs of windows that a smaller document has too."""
    docs, tags, starts, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    words = b"\n".join(strings).split()
    strings.clear()
    ids = np.fromiter(map(Numbers().__getitem__, words), np.int64, len(words))
    del words
    sizes = counts + window - 1
    ends = np.cumsum(sizes)
    whose = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(over="ignore"):
        value = mix(rolling(mix((ids + 1).astype(np.uint64) * BASE), window))
    usable = np.ones(len(ids), bool)
    for j in range(1, window):
        usable[ends - j] = False
    at = np.flatnonzero(usable)
    order = at[np.argsort(value[at], kind="stable")]
    sorted_value = value[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_value[1:] != sorted_value[:-1]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    if not len(first):
        return np.zeros((0, 4), np.int64)
    doc = docs[whose[order]]
    smallest = np.minimum.reduceat(doc, first)
    leader = order[first]
    mixed = np.zeros(len(first), bool)  # groups in which different windows share a hash
    several = np.flatnonzero(smallest[group] != np.maximum.reduceat(doc, first)[group])
    for j in range(window):
        differs = ids[order[several] + j] != ids[leader[group[several]] + j]
        mixed[group[several[differs]]] = True
    hit = doc > smallest[group]
    for g in np.flatnonzero(mixed):
        own = np.flatnonzero(group == g)
        low: dict[bytes, int] = {}
        keys = [ids[order[i] : order[i] + window].tobytes() for i in own]
        for i, k in zip(own, keys, strict=True):
            low[k] = min(low.get(k, doc[i]), doc[i])
        hit[own] = [doc[i] > low[k] for i, k in zip(own, keys, strict=True)]
    found = np.sort(order[hit])
    if not len(found):
        return np.zeros((0, 4), np.int64)
    run = np.ones(len(found), bool)
    run[1:] = (found[1:] != found[:-1] + 1) | (whose[found[1:]] != whose[found[:-1]])
    a = np.flatnonzero(run)
    b = np.append(a[1:], len(found)) - 1
    k = whose[found[a]]
    offset = ends[k] - sizes[k]
    return np.stack([docs[k], tags[k], starts[k] + found[a] - offset, starts[k] + found[b] - offset + window], axis=1)


def covered_windows(blobs: list[bytes], window: int) -> Iterator[np.ndarray]:
    """The same for packed windows of few sorts, whatever their number: a blob is unpacked at a time, twice."""
    low: dict[bytes, int] = {}

    def keys(strings: bytes) -> list[bytes]:
        return [b" ".join(s.split()[:window]) for s in strings.split(b"\n")]

    for blob in blobs:
        fields, strings = unpacked(blob)
        for doc, k in zip(fields[0].tolist(), keys(strings), strict=True):
            if doc < low.setdefault(k, doc):
                low[k] = doc
    for blob in blobs:
        (docs, tags, starts, counts), strings = unpacked(blob)
        hit = docs > np.array([low[k] for k in keys(strings)])
        yield np.stack([docs, tags, starts, starts + counts + window - 1], axis=1)[hit]


#: Bytes of texts whose super-k-mers one task judges, on average.
TASK = 16 << 20


def judged(packed: DataFrame, window: int, gram: int, size: int, gather_bytes: int = GATHER, sort_bytes: int = SORT) -> DataFrame:
    """doc, tag, first, last (exclusive) of word runs to remove, from texts of `size` bytes.

    There are as many tasks as the texts' bytes ask for, so that none reads more when these grow. A task holds at most about sort_bytes of a bucket. What a larger one holds goes, in passing, to FAN
    smaller buckets, equal super-k-mers of different documents resolved on the way; these are judged in the
    next round.
    """
    schema = "bucket long, raw long, packed binary, doc long, tag long, first int, last int"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def rows(part: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part[c]).cast(k) if c in part else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names)

    def runs(found: np.ndarray) -> pa.RecordBatch:
        return rows({c: found[:, k] for k, c in enumerate(RUNS)}, len(found))

    def judge(level: int):
        def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            blobs, total = [], 0
            again: Packer | None = None

            def left() -> Iterator[pa.RecordBatch]:
                for into, raw, packed in again.leave():
                    yield rows({"bucket": into, "raw": raw, "packed": packed}, len(into))

            for batch in batches:
                for raw, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    if not raw:
                        yield runs(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64).reshape(-1, 4))
                        continue
                    blobs.append(blob)
                    total += raw
                    if again is None and total > sort_bytes and len(blobs) > 1 and level < DEALT:
                        again = Packer(window, gram if level < SALTED else window, FAN, gather_bytes, level + 1, key[0].as_py())
                    while again is not None and blobs:
                        again.add_packed(blobs.pop())
                        if again.full():
                            yield from left()
            if again is not None:
                yield from left()
                returned()
            elif total > sort_bytes and len(blobs) > 1:
                yield from map(runs, covered_windows(blobs, window))
            elif blobs:
                parts, strings = zip(*map(unpacked, blobs), strict=True)
                yield runs(covered(list(parts), list(strings), window))

        return run

    found, level = None, 0
    while True:
        tasks = max(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK))
        out = stored(packed.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(judge(level), schema), "judged")
        own = out.where("bucket IS NULL").select(*RUNS)
        found = own if found is None else found.union(own)
        packed = out.where("bucket IS NOT NULL").select("bucket", "raw", "packed")
        if not packed.limit(1).count():
            return found
        level += 1


def remove_runs(words: list[bytes], runs: list[tuple[int, int]]) -> list[bytes]:
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for a, b in runs:
        gone[a] += 1
        gone[b] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]


def identified(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, str, int]:
    """docs with a tag, the tag's name and the bytes of all texts. Key and tag say which text a row has.

    The tag is 0 for a key with one text, else the text's 64-bit hash: a row's identity comes from what it
    holds and is the same however often, and in whatever order, docs is read.
    """
    texts = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.min(F.xxhash64(text)).alias("low"), F.max(F.xxhash64(text)).alias("high"), F.sum(F.octet_length(text)).alias("size")
    )
    sums = texts.agg(F.sum("size").alias("size"), F.count_if(F.col("low") < F.col("high")).alias("several")).first()
    tag = free_name(docs, "_tag")
    if not sums.several:
        return docs.withColumn(tag, F.lit(0).cast("long")), tag, sums.size or 0
    several = texts.where("low < high").select(F.col("key").alias(key), F.lit(True).alias(tag))
    if sums.several <= SENT_KEYS:
        several = F.broadcast(several)
    return docs.join(several, key, "left").withColumn(tag, F.when(F.col(tag), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))).select(*docs.columns, tag), tag, sums.size or 0


def divided(base: DataFrame, runs: DataFrame, key: str, doc: str) -> tuple[DataFrame, DataFrame]:
    """base in two parts: rows whose key may be a doc of runs, and rows whose key is none. Only the former need a join."""
    n = runs.agg(F.approx_count_distinct(doc)).first()[0]
    bits = min(MOST_BITS, max(1 << 10, 1 << (BITS * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    at, word, mask = (free_name(base, c) for c in ("_at", "_word", "_mask"))
    marks = runs.select(place(doc).alias("_p")).groupBy(F.shiftright("_p", 6).alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_p & 63 AS INT))")).alias(mask))
    known = base.withColumn(at, place(key)).withColumn(word, F.shiftright(at, 6)).join(F.broadcast(marks), word, "left")
    hit = F.coalesce(F.expr(f"shiftright(`{mask}`, CAST(`{at}` & 63 AS INT)) & 1L") == 1, F.lit(False))
    return known.where(hit).select(*base.columns), known.where(~hit).select(*base.columns)


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = 13, gram: int = 4, gather_bytes: int = GATHER, sort_bytes: int = SORT) -> DataFrame:
    """Every column of docs, then n_words, n_removed, kept (words left, joined by blanks), kept_sha256.

    A word goes if a window over it also starts in a document with a smaller key; all windows are judged on
    the input. Words are runs of other bytes than blanks and 0x09-0x0D. Null texts have no words. Rows whose
    key is null lose nothing and take nothing away; rows with equal keys don't take from one another, and
    equal rows have equal results. Keys are whole numbers; others raise. Columns with a result's name are
    replaced; texts shorter than a window are kept whole. docs is read four times: store it first if it is
    dear to compute.
    """
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise ValueError(f"{key} has to be of whole numbers")
    added = ["n_words", "n_removed", "kept", "kept_sha256"]
    base, tag, size = identified(docs.select(*[c for c in docs.columns if c not in added]), text, key)
    buckets = max(64, -(-size // BUCKET))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, gram, buckets, gather_bytes)

        def left() -> Iterator[pa.RecordBatch]:
            for columns in packer.leave():
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "raw", "packed"])

        for batch in batches:
            packer.add(*(c.to_pylist() for c in batch.columns))
            if packer.full():
                yield from left()
        yield from left()

    packed = map_rows(base.select(F.col(key).cast("long"), tag, text), pack, "bucket long, raw long, packed binary")
    held = free_name(base, "_runs")
    found = judged(packed, window, gram, size, gather_bytes, sort_bytes)
    runs = found.groupBy(F.col("doc").alias(key), F.col("tag").alias(tag)).agg(F.collect_set(F.struct("first", "last")).alias(held))
    names = [c for c in base.columns if c != tag]
    touched, whole = divided(base, found, key, "doc")  # texts that lose nothing aren't shuffled
    kind = runs.schema[held].dataType
    joined = touched.join(runs, [key, tag], "left").select(*names, held).unionAll(whole.select(*names, F.lit(None).cast(kind).alias(held)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept, digest = [], [], [], []
            texts = batch.column(batch.schema.names.index(text)).to_pylist()
            for x, found in zip(texts, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                words = (x or "").encode("utf-8").split()
                left = remove_runs(words, [(r["first"], r["last"]) for r in found or ()])
                whole = b" ".join(left)
                n.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(whole.decode("utf-8"))
                digest.append(hashlib.sha256(whole).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digest, pa.string())], [*names, *added])

    columns = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*names).schema), "n_words long, n_removed long, kept string, kept_sha256 string"])
    return map_rows(joined, finish, columns)
