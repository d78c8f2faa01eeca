"""Quality scores: random-indexing word vectors, pooled per document, and a small calibrated network.

Every token has a sparse random index vector, drawn from its own hash, so it needs no table. A token that the corpus
says twice or more has a context vector: the sum of the index vectors of its neighbours over the whole
corpus. These sums are made in passing by each task, and added up by token in a table as long as the vocabulary.
A document is the mean of its tokens' index and scaled context vectors; those of the commonest tokens are sent to all
tasks, all others joined. A two-layer network in numpy turns the mean into a logit, which a temperature fitted on
rows that the network wasn't trained on turns into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Members, crc_mod, forget, free_name, map_rows, member_filter, returned, send, stored
from .substr import mix

#: Length of index vectors, entries of an index vector that aren't 0; each is in a part of its own.
SIZE, ENTRIES = 32, 4
#: Commonest tokens whose context vectors are sent to all tasks: 40 bytes each, whatever the vocabulary.
COMMON = 1 << 17
#: A context vector is kept in bytes: whole numbers from -127 to 127, of a vector of length 1 times this.
FINE = 127.0
#: Tokens whose sums or counts a task gathers before it passes them on; entries beyond LARGE go on at once, the others are kept in two bytes.
HELD, LARGE = 1 << 19, 8000
U = np.uint64
#: Byte classes: 0 white space, 1 letters and all that isn't ASCII, 2 digits, 3 other signs.
CLASS = np.array([0 if b == 32 or 9 <= b <= 13 else 1 if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 else 2 if 48 <= b <= 57 else 3 for b in range(256)], np.uint8)
CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all tokens of the texts, and the text that each is of.

    Tokens are runs of one byte class, letters without regard to case; words wholly in capitals are marked,
    and a token that repeats the one before it is the mark of repetition.
    """
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not len(data):
        return none
    kinds = CLASS[data]
    starts = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1]))
    ends = np.append(starts[1:], len(data))
    seen = kinds[starts] != 0
    starts, ends = starts[seen], ends[seen]
    if not len(starts):
        return none
    with np.errstate(over="ignore"):
        # each token's bytes, weighted by a power of their place in the token
        place = np.arange(len(data), dtype=np.int64)
        sizes = ends - starts
        inside = np.repeat(np.arange(len(starts)), sizes)
        at = place[kinds != 0]
        step = at - starts[inside]
        power = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
        begin = np.cumsum(sizes) - sizes
        hashes = np.add.reduceat((LOWER[data[at]] + U(1)) * power[step], begin)
        capitals = np.add.reduceat(CAPITAL[data[at]].astype(np.int64), begin)
    hashes = mix(hashes)
    hashes = np.where((capitals >= 2) & (capitals == sizes), hashes ^ U(0xC3A5C85C97CB3127), hashes)
    edge = np.cumsum([len(p) + 1 for p in parts])
    owner = np.searchsorted(edge, starts, side="right")
    repeats = np.append(False, (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]))
    hashes[repeats] = U(0x5851F42D4C957F2D)
    return mix(hashes), owner


def index_entries(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs [token, entry] of the entries of each token's index vector."""
    bits = mix(tokens ^ U(0x2545F4914F6CDD1D))
    part = SIZE // ENTRIES
    shifts = np.arange(ENTRIES, dtype=np.uint64) * U(8)
    own = bits[:, None] >> shifts
    places = (own % U(part)).astype(np.int64) + np.arange(ENTRIES) * part
    return places, np.where((own >> U(7)) & U(1), 1, -1)


def summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their rows."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
    wide = np.int32 if rows.dtype == np.int16 else rows.dtype
    return keys[begin], np.add.reduceat(rows[order], begin, axis=0, dtype=wide) if len(begin) else rows[:0]


def neighbour_sums(tokens: np.ndarray, owner: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The wanted ones among tokens, and for each the sum of the index vectors before and behind it in its text."""
    near = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
    names, place = np.unique(tokens, return_inverse=True)
    chosen = np.zeros(len(names), bool)
    chosen[place[wanted]] = True
    rank = np.cumsum(chosen) - 1
    places, signs = index_entries(names)
    table = np.zeros(int(chosen.sum()) * SIZE)
    for own, other in ((place[near], place[near + 1]), (place[near + 1], place[near])):
        kept = chosen[own]
        own, other = rank[own[kept]], other[kept]
        for e in range(ENTRIES):
            table += np.bincount(own * SIZE + places[other, e], weights=signs[other, e], minlength=len(table))
    return names[chosen], table.reshape(-1, SIZE).astype(np.int32)


def gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums by token over the parts of a task, passed on whenever HELD tokens have come together; a token may come more than once."""
    keys, rows, size = [], [], 0

    def kept(k: np.ndarray, r: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal size
        if r.ndim > 1:
            large = (np.abs(r) > LARGE).any(axis=1)
            if large.any():
                yield k[large], r[large]
                k, r = k[~large], r[~large]
            r = r.astype(np.int16)
        keys.append(k)
        rows.append(r)
        size += len(k)

    for k, r in parts:
        yield from kept(k, r)
        if size >= HELD:
            k, r = summed(np.concatenate(keys), np.concatenate(rows))
            keys, rows, size = [], [], 0
            if len(k) >= HELD * 3 // 4:
                yield k, r
            else:
                yield from kept(k, r)
    if keys:
        yield summed(np.concatenate(keys), np.concatenate(rows))


def token_counts(docs: DataFrame, text: str) -> DataFrame:
    """token, n of every token that docs have twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                yield np.unique(token_hashes(batch.column(0).to_pylist())[0], return_counts=True)

        for tokens, n in gathered(parts()):
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    return map_rows(docs.select(text), run, "token long, n long", rows=500).groupBy("token").agg(F.sum("n").alias("n")).where("n >= 2")


def context_vectors(docs: DataFrame, text: str, counts: DataFrame) -> DataFrame:
    """token, vector (SIZE signed bytes) of every token in counts: the sum of its neighbours' index vectors, scaled."""
    chosen = member_filter(counts, "token")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                tokens, owner = token_hashes(batch.column(0).to_pylist())
                yield neighbour_sums(tokens, owner, chosen.has(tokens))

        for tokens, rows in gathered(parts()):
            # bytes where a sum fits them, which is nearly everywhere
            fits = (rows.min(axis=1) >= -128) & (rows.max(axis=1) <= 127)
            packed = [(a if fit else b).tobytes() for fit, a, b in zip(fits.tolist(), rows.astype(np.int8), rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(packed, pa.binary())], ["token", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of token; the last one of a batch waits for the next."""
        held = np.zeros(0, np.uint64), np.zeros((0, SIZE), np.int64)

        def made(tokens: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
            length = np.maximum(np.linalg.norm(rows.astype(float), axis=1, keepdims=True), 1.0)
            fine = np.round(rows / length * FINE).astype(np.int8)
            return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array([r.tobytes() for r in fine], pa.binary())], ["token", "vector"])

        for batch in batches:
            rows = np.stack([np.frombuffer(x, np.int8 if len(x) == SIZE else np.int32).astype(np.int64) for x in batch.column(1).to_pylist()]) if batch.num_rows else held[1][:0]
            tokens, rows = np.concatenate([held[0], batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)]), np.concatenate([held[1], rows])
            # sorted as signed numbers, so equal ones lie together
            begin = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))[: len(tokens)]
            tokens, rows = tokens[begin], np.add.reduceat(rows, begin, axis=0) if len(begin) else rows
            held = tokens[-1:], rows[-1:]
            if len(tokens) > 1:
                yield made(tokens[:-1], rows[:-1])
        if len(held[0]):
            yield made(*held)

    made = map_rows(docs.select(text), sums, "token long, sums binary", rows=500).repartition("token").sortWithinPartitions("token")
    return made.mapInArrow(add, "token long, vector binary").join(counts.select("token"), "token", "left_semi")  # the filter lets some others through


def word_vectors(docs: DataFrame, text: str = "text", common: int = COMMON) -> dict:
    """Stored context vectors of all tokens that docs have twice or more, and those of the commonest ones in arrays."""
    counts = stored(token_counts(docs, text), "token_counts")
    table = stored(context_vectors(docs, text, counts), "context_vectors")
    most = counts.orderBy(F.desc("n"), "token").limit(common)
    found = table.join(F.broadcast(most.select("token")), "token").toArrow()  # `common` rows at most
    others = member_filter(table.join(F.broadcast(most.select("token")), "token", "left_anti"), "token")
    forget(counts)
    tokens = found.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    vectors = np.frombuffer(b"".join(found.column("vector").to_pylist()), np.int8).reshape(-1, SIZE)
    return {"table": table, "others": others, "tokens": tokens[order], "vectors": vectors[order]}


def pooled(texts: list[str | None], tokens: np.ndarray, vectors: np.ndarray, others: Members) -> tuple[np.ndarray, np.ndarray, list[dict[int, int]]]:
    """For each text the sum of its tokens' index vectors, and of the known context vectors, [text, 2 SIZE]; its number of tokens; and other tokens with their counts."""
    found, owner = token_hashes(texts)
    n = np.bincount(owner, minlength=len(texts))
    out = np.zeros((len(texts), 2 * SIZE), np.int64)
    rest: list[dict[int, int]] = [{} for _ in texts]
    if not len(found):
        return out, n, rest
    places, signs = index_entries(found)
    flat = np.bincount(((owner[:, None] * SIZE) + places).ravel(), weights=signs.ravel(), minlength=len(texts) * SIZE)
    out[:, :SIZE] = flat.reshape(-1, SIZE)
    at = np.minimum(np.searchsorted(tokens, found), max(len(tokens) - 1, 0))
    known = tokens[at] == found if len(tokens) else np.zeros(len(found), bool)
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        own = at[edges[i] : edges[i + 1]][known[edges[i] : edges[i + 1]]]
        out[i, SIZE:] = vectors[own].sum(axis=0, dtype=np.int64)
    left = np.flatnonzero(~known)
    left = left[others.has(found[left])]
    for i, t in zip(owner[left].tolist(), found[left].view(np.int64).tolist(), strict=True):
        rest[i][t] = rest[i].get(t, 0) + 1
    return out, n, rest


def document_vectors(docs: DataFrame, words: dict, text: str = "text") -> DataFrame:
    """Every column of docs but text, and a vector of doubles (binary): the mean of its tokens' vectors, zeros without tokens.

    A row without tokens but common ones is done where it is read. The others' tokens are joined, each row with what it
    knows and what comes from the join; rows are numbered when they are stored.
    """
    kept = [c for c in docs.columns if c != text]
    row, name = free_name(docs, "_row"), free_name(docs, "vector")
    sent, others = send(docs.sparkSession, (words["tokens"], words["vectors"])), words["others"]  # COMMON rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, n, rest = pooled(batch.column(batch.num_columns - 1).to_pylist(), *sent.value[1], others)
            tokens = pa.array([list(r.items()) for r in rest], pa.map_(pa.int64(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([s.tobytes() for s in sums], pa.binary()), pa.array(n.astype(np.int64)), tokens], [*kept, "_sums", "_n", "_rest"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), "_sums binary, _n long, _rest map<bigint, bigint>"])
    made = stored(map_rows(docs.select(*kept, text), run, schema, rows=500).withColumn(row, F.monotonically_increasing_id()), "pooled")

    def mean(sums: np.ndarray, n: np.ndarray) -> list[bytes]:
        scale = np.maximum(n, 1)[:, None] * np.concatenate([np.full(SIZE, np.sqrt(ENTRIES)), np.full(SIZE, FINE)])
        return [x.tobytes() for x in sums / scale]

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.frombuffer(b"".join(batch.column(len(kept)).to_pylist()), np.int64).reshape(-1, 2 * SIZE)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(mean(sums, batch.column(len(kept) + 1).to_numpy(zero_copy_only=False)), pa.binary())], [*kept, name])

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of number, each document's own row before what the join found for it."""
        base, extra, like = None, None, None

        def closed() -> pa.RecordBatch:
            sums = np.frombuffer(base.column(len(kept))[0].as_py(), np.int64).copy()
            sums[SIZE:] += extra
            return pa.RecordBatch.from_arrays([*base.columns[: len(kept)], pa.array(mean(sums[None], np.array([base.column(len(kept) + 1)[0].as_py()])), pa.binary())], [*kept, name])

        for batch in batches:
            out = []
            own = batch.column(len(kept) + 2).to_pylist()
            counts = batch.column(len(kept) + 3).to_numpy(zero_copy_only=False)
            heads = [i for i, v in enumerate(own) if v is None]
            for a, b in zip([-1, *heads], [*heads, len(own)], strict=True):
                if a >= 0:
                    if base is not None:
                        out.append(closed())
                    base, extra = batch.slice(a, 1), np.zeros(SIZE, np.int64)
                if b > a + 1:
                    found = np.frombuffer(b"".join(own[a + 1 : b]), np.int8).reshape(-1, SIZE).astype(np.int64)
                    extra += (found * counts[a + 1 : b, None]).sum(axis=0)
            yield from out
        if base is not None:
            yield closed()

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), f"`{name}` binary"])
    short = map_rows(made.where(F.size("_rest") == 0).select(*kept, "_sums", "_n"), done, fields)
    long = made.where(F.size("_rest") > 0)
    asked = long.select(row, F.explode("_rest").alias("token", "_times")).join(words["table"], "token")
    found = asked.select(row, F.col("vector").alias("_vector"), "_times")
    base = long.select(row, *kept, "_sums", "_n", F.lit(None).cast("binary").alias("_vector"), F.lit(1).cast("long").alias("_times"))
    both = base.unionByName(found, allowMissingColumns=True).repartition(row).sortWithinPartitions(row, F.col("_vector").isNotNull())
    joined = both.select(*kept, "_sums", "_n", "_vector", "_times").mapInArrow(lambda b: (yield from _and_return(join_up(b))), fields)
    return short.unionByName(joined)


def _and_return(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches
    returned()


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 600, rate: float = 0.02, decay: float = 1e-4) -> dict:
    """Two layers, tanh between them, trained by Adam on all rows at once; every fifth row sets the temperature."""
    rng = np.random.default_rng(7)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / scale
    aside = np.arange(len(z)) % 5 == 0 if len(z) >= 50 else np.zeros(len(z), bool)
    a, t = z[~aside], y[~aside]
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for step in range(1, rounds + 1):
        h = np.tanh(a @ w[0] + w[1])
        error = (sigmoid(h @ w[2] + w[3]) - t) / len(t)
        back = np.outer(error, w[2]) * (1 - h * h)
        for k, g in enumerate((a.T @ back + decay * w[0], back.sum(axis=0), h.T @ error + decay * w[2], error.sum(keepdims=True))):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = {"mean": mean, "scale": scale, "w": w, "temperature": 1.0}
    if aside.any():
        logits, truth = network_logits(net, x[aside]), y[aside]
        loss = lambda c: -np.mean(truth * np.log(sigmoid(logits / c) + 1e-9) + (1 - truth) * np.log(1 - sigmoid(logits / c) + 1e-9))
        net["temperature"] = float(min(np.exp(np.linspace(np.log(0.25), np.log(8), 71)), key=loss))
    return net


def network_logits(net: dict, x: np.ndarray) -> np.ndarray:
    w = net["w"]
    return np.tanh(((x - net["mean"]) / net["scale"]) @ w[0] + w[1]) @ w[2] + w[3]


def held_out(key: Column) -> Column:
    """crc32 of the id as text leaves 0 modulo 5; a null id is held out."""
    return F.coalesce(crc_mod(key, 5) == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = 6000, common: int = COMMON) -> dict:
    """Word vectors of all texts, and a network from about `sample` labelled rows chosen by a hash of the key.

    That sample is the documented bound of the fit. Rows with a null key or label teach nothing; a key with
    several labels has their majority, 1 if even, and of its texts one counts, however many rows have the key. With labels of one sort, or none, every score is their share, or 0.5.
    """
    words = word_vectors(docs, text, common)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    part = min(1.0, sample / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("key", F.lit("quality")), F.lit(1 << 30)) < int(part * (1 << 30)))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")  # about `sample` pairs of numbers
    made = document_vectors(rows.select("key", "y", "text"), words)
    found = sorted(map(tuple, made.groupBy("key").agg(F.min("y").alias("y"), F.min("vector").alias("x")).collect()))
    y = np.array([f[1] for f in found], float)
    x = np.array([np.frombuffer(f[2], float) for f in found], float)
    if len(set(y.tolist())) < 2:
        return {"words": words, "net": None, "share": float(y.mean()) if len(y) else 0.5}
    return {"words": words, "net": fit_network(x, y), "share": float(y.mean())}


def quality_scores(docs: DataFrame, model: dict, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Every column of docs but text, then score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold).

    Null, empty and blank texts are scored as a document without tokens. Columns with a result's name are
    replaced; repeated rows stay repeated.
    """
    base = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    sent = send(docs.sparkSession, {"net": model["net"], "share": model["share"]})  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = sent.value[1]
            x = np.frombuffer(b"".join(batch.column(batch.num_columns - 1).to_pylist()), float).reshape(batch.num_rows, -1)
            score = sigmoid(network_logits(use["net"], x) / use["net"]["temperature"]) if use["net"] else np.full(len(x), use["share"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], [*batch.schema.names[:-1], "score", "predicted"])

    made = document_vectors(base, model["words"], text)
    columns = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields[:-1]), "score double, predicted int"])
    return map_rows(made, run, columns)
