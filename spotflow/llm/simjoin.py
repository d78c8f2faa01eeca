"""Jaccard join of word-shingle sets by the pigeonhole principle over a partitioned universe.

Sets are put into bands by size. For a band, hashing splits the universe of shingles into segments; two
sets that are similar enough differ in at most H shingles, so with more than H (weighted) segments some
must agree. A segment counts once if its subsets have to be equal, and twice if they may differ by one
shingle, which is found through the subsets' one-deletion neighbourhoods. How many segments of which sort
a band has is chosen by cost, and spare segments let each set leave out its commonest subsets. Candidates
are verified exactly on whole texts.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, free_name, map_rows, member_filter, numbered, send, stored
from ..graph import components
from .substr import mix, rolling

#: Documents sampled to see which shingles are common; only the choice of subsets depends on it.
SAMPLE = 2000
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
U = np.uint64


def shingles(text: str | None, k: int = 4) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; all words as one shingle if there are fewer."""
    words = text.encode("utf-8").translate(FOLD).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(k, len(words))
    return np.unique(mix(rolling(hashes, size) + U(size)))


def similar(a: str, b: str, k: int, percent: int) -> bool:
    """Whether the texts' shingle sets are similar enough, compared word by word and not by hashes."""
    x, y = ({tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)} for w in (t.encode("utf-8").translate(FOLD).split() for t in (a, b)))
    shared = len(x & y)
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def set_id(tokens: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh3_64_digest(tokens.tobytes()), ">i8")[0])


@lru_cache(maxsize=None)
def bands(percent: int) -> list[tuple[int, int]]:
    """Size bands up to 2**40: a set's partners are in its own band or the next to either side."""
    found, low = [], 1
    while low < 1 << 40:
        high = max(low, 100 * low // percent)
        found.append((low, high))
        low = high + 1
    return found


@lru_cache(maxsize=None)
def allocation(band: int, percent: int) -> tuple[int, int, int, int]:
    """H, segments, those of them with one-deletion neighbourhoods, and spare segments of a band.

    segments + neighbourhoods >= H + 1 + spare. The cost of a choice is the signatures that a set sends
    plus a charge for segments so small that unlike sets meet in them.
    """
    low, high = bands(percent)[band]
    limit = high * (100 - percent) // percent
    if not limit:
        return 0, 0, 0, 0
    spare = 1 + limit // 4 if limit > 4 else 0
    most = min((limit + 1) // 2, 64)  # beyond some, each further neighbourhood adds the same

    def cost(near: int) -> float:
        m = limit + 1 + spare - near
        c = low / m
        return (m - near - spare) + near * (1 + c) + 64 * max(0.0, m * math.exp(-c) - spare)

    near = min(range(most + 1), key=cost)
    return limit, limit + 1 + spare - near, near, spare


def signatures(tokens: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a set: for its own band, and for the band below, in which its smaller partners are."""
    table = bands(percent)
    own = bisect_right(table, (len(tokens), 1 << 62)) - 1
    out = []
    for band in (own, own - 1):
        if band < 0 or len(tokens) > 100 * table[band][1] // percent:
            continue
        limit, m, near, spare = allocation(band, percent)
        if not limit:
            continue  # only equal sets are similar enough, and they are one already
        segment = (mix(tokens + U(0x51ED270B)) % U(m)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        value = mix(tokens ^ U(0xA24BAED4963EE407))[order]
        counts = np.bincount(segment, minlength=m)
        sums = np.zeros(m, np.uint64)
        full = np.flatnonzero(counts)
        sums[full] = np.add.reduceat(value, (np.cumsum(counts) - counts)[full])
        salt = mix(np.arange(m, dtype=np.uint64) + U(band << 32) + U(1))
        signs = mix(sums + salt)
        exact = np.arange(near, m)
        if spare:
            at = np.minimum(np.searchsorted(common, tokens), max(len(common) - 1, 0))
            rare = np.bincount(segment, weights=(common[at] != tokens) if len(common) else None, minlength=m)
            exact = exact[np.lexsort((signs[exact], counts[exact], rare[exact]))[spare:]]
        out.append(signs[exact])
        if near:
            out.append(signs[:near])
            n = int(counts[:near].sum())
            of = segment[order][:n]
            out.append(mix(sums[of] - value[:n] + salt[of]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def members(docs: DataFrame, text: str, k: int, node: str) -> DataFrame:
    """docs without text, and node (id of the shingle set) and n_shingles."""
    kept = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = [], []
            for x in batch.column(batch.num_columns - 1).to_pylist():
                tokens = shingles(x, k)
                ids.append(set_id(tokens))
                sizes.append(len(tokens))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], [*kept, node, "n_shingles"])

    columns = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), f"`{node}` long, n_shingles long"])
    return map_rows(docs.select(*kept, text), run, columns)


def common_shingles(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """Shingles in three or more of about SAMPLE documents; at most SAMPLE texts' worth."""
    total = docs.count()
    chosen = docs.where(F.rand(11) < min(1.0, SAMPLE / max(total, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x, k) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["shingle"])

    often = map_rows(chosen.select(text), run, "shingle long").groupBy("shingle").count().where("count >= 3").select("shingle").collect()
    return np.sort(np.array([r.shingle for r in often], np.int64).view(np.uint64))


def candidates(docs: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """Sets that share a signature: bucket, leader (its smallest set), node (another one).

    Buckets of the same sets are one; bucket is null where only two sets met, for which nothing is left
    to compare. A bucket takes rows in proportion to its sets, not to their pairs.
    """
    sent = send(docs.sparkSession, common_shingles(docs, text, k))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            common, signs, nodes = sent.value[1], [], []
            for x in batch.column(0).to_pylist():
                tokens = shingles(x, k)
                node = set_id(tokens)
                if len(tokens) and node not in seen:  # copies within a task send once
                    seen.add(node)
                    made = signatures(tokens, common, percent)
                    signs.append(made)
                    nodes.append(np.full(len(made), node, np.int64))
            if signs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(signs).view(np.int64)), pa.array(np.concatenate(nodes))], ["sign", "node"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by sign and node; the last run of a batch waits for the next one."""
        empty = np.zeros(0, np.int64)
        sign, node = empty, empty

        def runs(sign: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
            fresh = np.ones(len(sign), bool)
            fresh[1:] = (sign[1:] != sign[:-1]) | (node[1:] != node[:-1])
            sign, node = sign[fresh], node[fresh]
            begin = np.flatnonzero(np.append(True, sign[1:] != sign[:-1])) if len(sign) else empty
            size = np.diff(np.append(begin, len(sign)))
            two = begin[size == 2]
            bucket, leader, other = [np.zeros(len(two), np.int64)], [node[two]], [node[two + 1]]
            known = [np.zeros(len(two), bool)]
            for a, n in zip(begin[size > 2], size[size > 2], strict=True):
                own = node[a : a + n]
                bucket.append(np.full(n, set_id(own), np.int64))
                leader.append(np.full(n, own[0], np.int64))
                other.append(own)
                known.append(np.ones(n, bool))
            if sum(map(len, other)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bucket), mask=~np.concatenate(known)), pa.array(np.concatenate(leader)), pa.array(np.concatenate(other))], ["bucket", "leader", "node"])

        for batch in batches:
            sign = np.concatenate([sign, batch.column(0).to_numpy(zero_copy_only=False)])
            node = np.concatenate([node, batch.column(1).to_numpy(zero_copy_only=False)])
            if len(sign) and sign[0] != sign[-1]:
                cut = int(np.searchsorted(sign, sign[-1]))
                yield from runs(sign[:cut], node[:cut])
                sign, node = sign[cut:], node[cut:]
        yield from runs(sign, node)

    signed = map_rows(docs.select(text), sign, "sign long, node long")
    met = signed.repartition("sign").sortWithinPartitions("sign", "node").mapInArrow(meet, "bucket long, leader long, node long")
    return met.distinct()


def named_texts(docs: DataFrame, text: str, k: int, nodes: DataFrame) -> DataFrame:
    """set and text of one document for each of the sets in nodes(node long)."""

    named = member_filter(nodes, "node")  # spares the shuffle most texts that no candidate names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found, texts = [], []
            for x in batch.column(0).to_pylist():
                node = set_id(shingles(x, k))
                if node in seen:
                    continue
                seen.add(node)
                found.append(node)
                texts.append(x)
            at = np.flatnonzero(named.has(np.array(found, np.int64)))
            found, texts = [found[i] for i in at], [texts[i] for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(texts, pa.string())], ["node", "text"])

    held = map_rows(docs.select(text), run, "node long, text string")
    return held.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, compared exactly."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            good = []
            for i in range(len(a)):
                for node, x in ((a[i], ta[i]), (b[i], tb[i])):
                    if node not in known:
                        known[node] = shingles(x, k)
                x, y = known[a[i]], known[b[i]]
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared) and similar(ta[i], tb[i], k, percent):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], ["a", "b"])

    return map_rows(both.select("a", "b", "ta", "tb"), run, "a long, b long", rows=1000)


def tile_links(nodes: list[int], labels: list[int], left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], texts: list[str], k: int, percent: int) -> list[tuple[int, int]]:
    """Similar pairs of the sets at left and at right, one for each two components that they join.

    Overlaps are products of the sets' incidence matrices, some thousand shingles at a time; the pairs
    that they name are compared word by word.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    tokens = np.concatenate([np.zeros(0, np.uint64), *sets])
    whose = np.repeat(np.arange(len(sets)), sizes)
    _, place, often = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = often >= 2
    rank = np.cumsum(shared) - 1
    kept = shared[place]
    columns, rows = rank[place[kept]], whose[kept]
    order = np.argsort(columns, kind="stable")
    columns, rows = columns[order], rows[order]
    overlap = np.zeros((len(left), len(right)), np.float32)
    width = 2048
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(columns, [low, low + width])
        part = np.zeros((len(sets), width), np.float32)
        part[rows[a:b], columns[a:b] - low] = 1
        overlap += part[left] @ part[right].T
    total = sizes[left][:, None] + sizes[right][None, :] - overlap
    root: dict[int, int] = {}

    def top(k: int) -> int:
        while root.get(k, k) != k:
            k = root[k]
        return k

    found = []
    for i, j in np.argwhere(100 * overlap.astype(np.float64) >= percent * total):
        x, y = top(labels[left[i]]), top(labels[right[j]])
        if x != y and similar(texts[left[i]], texts[right[j]], k, percent):
            root[max(x, y)] = min(x, y)
            found.append((nodes[left[i]], nodes[right[j]]))
    return found


def compared_groups(open_: DataFrame, texts: DataFrame, k: int, percent: int, tile_rows: int, tile_bytes: int) -> DataFrame:
    """a, b: links between sets of different components in one group; open_: group, node, label.

    A group is dealt into parts of at most about tile_rows sets and tile_bytes of text: components that fill
    parts have their own, the others share some. Every two parts are compared in a task of their own, unless
    both are of one component, and it returns no more links than it has sets. No pair of sets is ever a row.
    """
    named = open_.join(texts, "node")
    size = named.groupBy("group", "label").agg(F.count("*").alias("sets"), F.sum(F.octet_length("text")).alias("bytes"))
    alone = (F.col("sets") >= tile_rows) | (F.col("bytes") >= tile_bytes)
    size = size.select("group", "label", alone.alias("alone"), F.when(alone, F.col("label")).otherwise(0).alias("share"), "sets", "bytes")
    shares = size.groupBy("group", "alone", "share").agg(F.greatest(F.ceil(F.sum("sets") / tile_rows), F.ceil(F.sum("bytes") / tile_bytes), F.lit(1)).cast("int").alias("parts"))
    of = Window.partitionBy("group")
    upto = F.sum("parts").over(of.orderBy("alone", "share").rowsBetween(Window.unboundedPreceding, 0))
    laid = shares.select("*", (upto - F.col("parts")).cast("int").alias("low"), F.sum("parts").over(of).cast("int").alias("total"))
    laid = size.select("group", "label", "alone", "share").join(laid, ["group", "alone", "share"]).select("group", "label", "alone", "parts", "low", "total")
    dealt = named.join(laid, ["group", "label"]).withColumn("part", (F.col("low") + F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda q: ~F.col("alone") | (q < F.col("low")) | (q >= F.col("low") + F.col("parts")))
    tiled = dealt.select("group", "part", "node", "label", "text", F.explode(others).alias("other"))
    tiles = tiled.select("group", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", "label", "text")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, node, label, sets, held = [], [], [], [], []
        for batch in batches:
            part += batch.column(3).to_pylist()
            node += batch.column(4).to_pylist()
            label += batch.column(5).to_pylist()
            held += batch.column(6).to_pylist()
        sets = [shingles(x, k) for x in held]
        at = np.array(part)
        links = tile_links(node, label, np.flatnonzero(at == key[1].as_py()), np.flatnonzero(at == key[2].as_py()), sets, held, k, percent)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    return tiles.groupBy("group", "p", "q").applyInArrow(run, "a long, b long")


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after new links(a, b): only the components that these join are labelled again."""
    ends = links.join(labels.withColumnRenamed("node", "a"), "a", "left").select("b", F.coalesce("label", "a").alias("x"))
    ends = ends.join(labels.withColumnRenamed("node", "b"), "b", "left").select("x", F.coalesce("label", "b").alias("y"))
    joined = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("lower"))
    known = labels.union(joined.join(labels, "label", "left_anti").select(F.col("label").alias("node"), "label"))
    return known.join(joined, "label", "left").select("node", F.coalesce("lower", "label").alias("label"))


def unsettled(held: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, node, label of the buckets in held(bucket, node) whose sets are of several components."""
    named = held.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    return named.join(mixed, "bucket", "left_semi")


def grouped_buckets(held: DataFrame) -> DataFrame:
    """group, node, label: the buckets of held(bucket, node, label) whose smallest component is the same, together.

    Such buckets have mostly the same sets, each of which is then in few groups, however many buckets it is in. A group
    holds what meets one component, and nothing that is only reached from there.
    """
    group = held.groupBy("bucket").agg(F.min("label").alias("group"))
    return held.join(group, "bucket").select("group", "node", "label").distinct()


def linked_sets(docs: DataFrame, text: str, k: int, percent: int, tile_rows: int = 1000, tile_bytes: int = 4 << 20) -> DataFrame:
    """node, label: components of the sets that have a similar one.

    Each set is first compared with the smallest leader that it met, and with a set that it alone met in some
    bucket. A bucket whose sets are of one component is then done; the others are compared by groups of buckets,
    in tiles. So every two sets that share a bucket are compared
    unless they are known to belong together, and rows grow with sets and their buckets.
    """
    met = stored(candidates(docs, text, k, percent), "met")
    texts = stored(named_texts(docs, text, k, met.select("node").union(met.select(F.col("leader").alias("node"))).distinct()), "texts")
    pairs = met.where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b"), "bucket")
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    labels = stored(components(verified(first, texts, k, percent)), "labels")
    apart = (
        pairs.where("bucket IS NULL").select("a", "b")
        .join(first, ["a", "b"], "left_anti")
        .join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
        .join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
        .where(F.coalesce("la", "a") != F.coalesce("lb", "b"))
        .select("a", "b")
    )

    def with_links(labels: DataFrame, links: DataFrame) -> DataFrame:
        links = stored(links, "links")
        if links.limit(1).count():
            joined = stored(joined_labels(labels, links), "labels")
            forget(labels)
            labels = joined
        forget(links)
        return labels

    labels = with_links(labels, verified(apart, texts, k, percent))
    held = stored(grouped_buckets(unsettled(met.where("bucket IS NOT NULL").select("bucket", "node"), labels)), "held")
    if held.limit(1).count():
        labels = with_links(labels, compared_groups(held, texts, k, percent, tile_rows, tile_bytes))
    forget(met, texts, held)
    return labels


def labelled(base: DataFrame, text: str, k: int, percent: int, label: str, **tiles: int) -> DataFrame:
    """base without text, with n_shingles and a label: one for each component, null for texts without words."""
    node = free_name(base, "_set")
    held = stored(members(base, text, k, node), "members")
    labels = linked_sets(base, text, k, percent, **tiles).select(F.col("node").alias(node), F.col("label").alias(label))
    # texts without words spread over the join instead of meeting under one id
    spread = F.when(F.col("n_shingles") > 0, F.col(node)).otherwise((F.rand(5) * (1 << 40)).cast("long"))
    named = held.withColumn(node, spread).join(labels, node, "left")
    return named.withColumn(label, F.when(F.col("n_shingles") > 0, F.coalesce(label, node))).drop(node)


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, percent: int = 80, **tiles: int) -> DataFrame:
    """Every column of docs but text, then n_shingles and component_id.

    Two rows link when 100 * |intersection| >= percent * |union| of their sets of distinct k-word shingles
    of lower-cased (A-Z) words; a text of fewer words is one shingle. component_id is the smallest key
    that links reach, its own included. Null and empty texts have 0 shingles and are linked with nothing.
    Rows with equal sets are one set, however many they are, repeated rows included. A null key links but
    is never a component's id: a component of null keys has a null id. Columns with a result's name are
    replaced. Shingles and sets are compared as 64-bit hashes. docs is read five times.
    """
    base = docs.select(*[c for c in docs.columns if c not in ("n_shingles", "component_id")])
    names = [c for c in base.columns if c != text]
    label = free_name(base, "_label")
    named = labelled(base, text, k, percent, label, **tiles)
    full = named.where(F.col(label).isNotNull())
    first = full.groupBy(label).agg(F.min(key).alias("component_id"))
    linked = full.join(first, label).select(*names, "n_shingles", "component_id")
    return linked.union(named.where(F.col(label).isNull()).select(*names, "n_shingles", F.col(key).alias("component_id")))


def representatives(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay when each component keeps one: that of the smallest key, of equal ones the first.

    Texts without words are linked with nothing and stay. A null key counts as the largest. Rows are numbered
    once and stored, so that the row that stays is the one that was compared.
    """
    row = free_name(docs, "_row")
    base = numbered(docs, row)
    named = labelled(base.select(F.col(row).alias("row"), F.col(key).alias("key"), F.col(text).alias("text")), "text", k, percent, "label")
    best = named.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("best")).select(F.col("best.row").alias(row))
    stay = best.union(named.where("label IS NULL").select(F.col("row").alias(row)))
    return base.join(stay, row, "left_semi").drop(row)
