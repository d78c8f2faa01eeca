"""Language identification by the nearest of several centroids of TF-IDF n-gram vectors.

Texts become hashed counts of byte bi- and trigrams of their lower-cased letters, weighted by
(1 + ln tf) * idf and scaled to length 1. Each language has a few centroids (spherical k-means); a text
takes the language of the most similar one, or is rejected if even that one is too far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_rows, once, send

#: Buckets of hashed n-grams.
BUCKETS = 1 << 14
#: Bins of the histogram of similarities, and the modulus of the hash that chooses rows.
BINS = 1 << 16
SHARES = 1 << 40
#: Languages in a model, some quarter MB each.
MOST_LANGUAGES = 128
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: ASCII other than letters separates; what isn't ASCII stays.
LETTERS_ONLY = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur, in order, and their counts."""
    folded = b" ".join([b"", *text.lower().encode("utf-8", "replace").translate(LETTERS_ONLY).split(), b""])
    a = np.frombuffer(folded, np.uint8).astype(np.uint32)
    two = a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + a[2:] * np.uint32(0x27D4EB2F)
    hashed = np.concatenate([(two ^ (two >> np.uint32(15))) >> np.uint32(18), ((three ^ (three >> np.uint32(13))) * np.uint32(0x165667B1)) >> np.uint32(18)])
    counts = np.bincount(hashed, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k centroids of length 1; starts from the mean and then the rows that are farthest from what there is."""
    centre = rows.mean(axis=0)
    chosen = [rows[int(np.argmax(rows @ centre))]]
    while len(chosen) < min(k, len(rows)):
        chosen.append(rows[int(np.argmin(np.max(rows @ np.stack(chosen).T, axis=1)))])
    centroids = np.stack(chosen)
    for _ in range(rounds):
        near = np.argmax(rows @ centroids.T, axis=1)
        sums = np.stack([rows[near == j].sum(axis=0) if (near == j).any() else centroids[j] for j in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def share(n: int, per_language: int) -> int:
    """Of SHARES hash values, those that choose about per_language of n rows; at least one."""
    return SHARES if n <= per_language else max(1, per_language * SHARES // n)


def inverse_frequencies(rows: DataFrame) -> np.ndarray:
    """idf of each bucket over all of rows(text); a task sends at most BUCKETS + 1 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS + 1, np.int64)  # the last is the number of texts
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if has_letter(x):
                    df[ngram_counts(x)[0]] += 1
                    df[BUCKETS] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["bucket", "n"])

    df = np.zeros(BUCKETS + 1)
    for r in map_rows(rows.select("text"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[r.bucket] = r.n
    return (np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1).astype(np.float32)


def own_similarity(rows: DataFrame, model: dict, part: float) -> float:
    """The similarity with their own language that all but `part` of rows(text, lang) reach, from a histogram of all."""
    sent = send(rows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, seen = sent.value[1], np.zeros(BINS, np.int64)
        columns = {name: np.flatnonzero(use["owner"] == k) for k, name in enumerate(use["langs"])}
        for batch in batches:
            for x, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name in columns and has_letter(x):
                    own = float(cosines(use, x)[columns[name]].max())
                    seen[min(BINS - 1, max(0, int(own * BINS)))] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["bin", "n"])

    seen = np.zeros(BINS, np.int64)
    for r in map_rows(rows.select("text", "lang"), run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        seen[r.bin] = r.n
    return float(np.searchsorted(np.cumsum(seen), part * seen.sum(), side="right")) / BINS if seen.any() else 0.0


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 300, centroids: int = 4, slack: float = 0.25, most: int = MOST_LANGUAGES) -> dict:
    """Fit centroids on about `per_language` rows of each language, chosen by a hash: a documented, bounded sample.

    The hash is of key and text, and equal rows count once in the sample, so that neither a frequent key nor a
    repeated row can fill it. Rows without key, language or letters teach nothing. Document frequencies are those of all rows. The
    rejection distance is `slack` times the similarity that all but one in two hundred of all rows reach with
    their own language, to one part in BINS. Of more than `most` languages, those with most rows are learned, of equal ones the first in
    order: the model has BUCKETS numbers for each centroid and is sent to all tasks.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("key IS NOT NULL AND lang IS NOT NULL AND length(text) > 0")
    commonest = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most)
    totals = {r.lang: r["count"] for r in commonest.collect()}
    if not totals:
        return {"langs": [], "owner": np.zeros(0, int), "centroids": np.zeros((BUCKETS, 0), np.float32), "idf": np.ones(BUCKETS, np.float32), "reject": 0.0}
    rows = rows.where(F.col("lang").isin(*totals))
    part = [x for name, n in totals.items() for x in (F.lit(name), F.lit(share(n, per_language)))]
    sample = rows.where(F.pmod(F.xxhash64("key", "text", F.lit("langid")), F.lit(SHARES)) < F.element_at(F.create_map(*part), F.col("lang"))).distinct()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, at, counts = [], [], []
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(x):
                    a, c = ngram_counts(x)
                    langs.append(name)
                    at.append(a.astype("<i4").tobytes())
                    counts.append(c.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(at, pa.binary()), pa.array(counts, pa.binary())], ["lang", "at", "counts"])

    collected = map_rows(sample.select("lang", "text"), vectors, "lang string, at binary, counts binary").collect()
    found = [(r.lang, np.frombuffer(r.at, "<i4"), np.frombuffer(r.counts, "<i4")) for r in sorted(collected)]
    idf = inverse_frequencies(rows)
    langs = sorted({x[0] for x in found})
    owner, kept = [], []
    for k, name in enumerate(langs):
        own = [x for x in found if x[0] == name]
        dense = np.zeros((len(own), BUCKETS), np.float32)
        for row, (_, a, c) in zip(dense, own, strict=True):
            row[a] = (1 + np.log(c)) * idf[a]
        dense /= np.linalg.norm(dense, axis=1, keepdims=True)
        made = spherical_kmeans(dense, centroids)
        kept.append(made)
        owner += [k] * len(made)
    model = {"langs": langs, "owner": np.array(owner), "centroids": np.ascontiguousarray(np.concatenate(kept).T.astype(np.float32)) if kept else np.zeros((BUCKETS, 0), np.float32), "idf": idf, "reject": 0.0}
    return model | {"reject": slack * own_similarity(rows, model, 0.005)} if kept else model


def cosines(model: dict, text: str) -> np.ndarray:
    """Similarity with each centroid."""
    at, counts = ngram_counts(text)
    weights = (1 + np.log(counts)).astype(np.float32) * model["idf"][at]
    return (weights @ model["centroids"][at]) / max(float(np.linalg.norm(weights)), 1e-12)


def classify(model: dict, text: str | None) -> tuple[str, float, bool]:
    if not has_letter(text) or not model["langs"]:
        return UNKNOWN, 0.0, True
    found = cosines(model, text)
    best = int(np.argmax(found))
    score = min(1.0, max(0.0, float(found[best])))
    return model["langs"][model["owner"][best]], score, score < model["reject"]


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Every column of docs, then lang_pred, score (cosine, 0 to 1) and rejected.

    Null texts and texts without a letter are `und`, 0, rejected; so is everything if no language was
    learned. A far text keeps its nearest language in lang_pred and is marked rejected. Ties go to the
    first language in order. Columns with a result's name are replaced; repeated rows stay repeated.
    """
    added = ["lang_pred", "score", "rejected"]
    base = docs.select(*[c for c in docs.columns if c not in added])
    sent = send(docs.sparkSession, model)  # BUCKETS numbers for each centroid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, value = sent.value
            use = once(key, lambda: value)
            found = [classify(use, x) for x in batch.column(batch.schema.names.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], [*batch.schema.names, *added])

    columns = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), "lang_pred string, score double, rejected boolean"])
    return map_rows(base, run, columns)


def held_out(key: Column) -> Column:
    """crc32 of the id as text leaves 1 modulo 3; a null id is held out."""
    return F.coalesce(crc_mod(key, 3) == 1, F.lit(True))
