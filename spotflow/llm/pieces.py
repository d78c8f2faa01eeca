"""SentencePiece encoding and decoding through a relational lattice.

Texts are cut into units that no vocabulary piece crosses. The common units, and those that a task meets for the
first time, are exploded into substrings of bounded length, equi-joined to the piece table and grouped again to the edges of
each unit's lattice, over which a higher-order aggregate finds the segmentation. For unigram models it is
Viterbi's best path; for BPE models, whose encoding is in general no best path of any sum of scores, it takes
the merges of neighbours by rank. The texts travel behind their units through the same stage: nothing is
shuffled, stored or numbered.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, returned, send, slices

SPACE = "▁"
#: Units that no piece crosses, from fine to coarse; the first that holds for a vocabulary is used. The fine ones
#: are runs of letters and runs of anything else.
UNITS = (r"▁*(?:[^\W\d_²³¹¼½¾]+|(?:(?!▁)[\W\d_²³¹¼½¾])+)|▁+", r"▁*[^▁]+|▁+")
#: Units of up to this many characters go through the relational lattice: its cuts are the bits of a long.
LONGEST = 62
#: Documents sampled to see which units are common, and how many of these are segmented before all others and
#: broadcast, if they aren't longer than COMMON_SIZE. Where a unit is segmented makes no difference to its ids.
SAMPLE, COMMON, COMMON_SIZE = 16_000, 160_000, 32
#: Units that a task remembers besides, and their bytes; beyond it they are segmented again, with the same result.
REMEMBERED, REMEMBERED_BYTES = 150_000, 8 << 20
#: Rows and bytes of texts that travel as one; larger arrays burden the JVM's heap.
CRATE_ROWS, CRATE_BYTES = 1000, 1 << 18


def load_model(path: str) -> dict:
    """Pieces, ids, scores, byte ids and units of a sentencepiece model with identity normalisation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    if model.encode("ﬁ  ½", out_type=str) == model.encode("fi 1⁄2", out_type=str):
        raise ValueError(f"{path} normalises texts")
    plain = {model.id_to_piece(i): i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))}
    spelled = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
    scores = {p: model.get_score(i) for p, i in plain.items()}
    merges = all(float(s).is_integer() for s in scores.values())  # BPE models score by rank
    unit = next(u for u in (*UNITS, r"(?s).+") if all(re.fullmatch(u, p) for p in plain))
    return {"ids": plain, "scores": scores, "bytes": spelled, "unknown": model.unk_id(), "merges": merges, "disordered": disordered(scores) if merges else set(), "unit": unit, "longest": max(map(len, plain))}


def as_unigrams(model: dict, shift: float = 2.7) -> dict:
    """The model as a unigram model: where scores are ranks, rank r has a log weight of -log(r + shift)."""
    if not model["merges"]:
        return model
    ranks = ranked(model)
    return model | {"merges": False, "disordered": set(), "scores": {p: -math.log(ranks[s] + 1 + shift) for p, s in model["scores"].items()}}


def disordered(scores: dict[str, float]) -> set[str]:
    """Pieces which, on their own, come about by merges that aren't in the order of rank, start and size.

    A unit without such a piece can take its merges in one pass over its edges in that order, instead of the
    best one again and again. For suppose that a merge made another one possible that comes before it: the
    latter's piece spans cuts that no merge has removed, so that the merges within it so far are those of the
    piece on its own, in the order that they have there, and it would come before the last of them there, too.
    """
    found = set()
    for piece in scores:
        parts, last = list(piece), (-float("inf"), 0, 0)
        while len(parts) > 1:
            best = min(((-s, i) for i in range(len(parts) - 1) if (s := scores.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            i = best[1]
            whole = parts[i] + parts[i + 1]
            this = (best[0], sum(map(len, parts[:i])), len(whole))
            if this <= last:
                found.add(piece)
            last = this
            parts[i : i + 2] = [whole]
    return found


def escaped(text: str) -> str:
    """Blanks become visible and one stands in front; nothing for an empty text."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def ranked(model: dict) -> dict[float, int]:
    """Score -> rank: the better the smaller."""
    return {score: k for k, score in enumerate(sorted(set(model["scores"].values()), reverse=True))}


def piece_table(units: DataFrame, model: dict) -> DataFrame:
    """key (hash of the piece), piece, code: its rank and, in the last bit, whether it is disordered."""
    ranks = ranked(model)
    rows = [(p, ranks[s] << 13 | (p in model["disordered"])) for p, s in model["scores"].items()]
    return units.sparkSession.createDataFrame(rows, "piece string, code long").withColumn("key", F.xxhash64("piece"))


def lattice(units: DataFrame, model: dict) -> DataFrame:
    """number, unit, ordered, edges and whole of units(number, unit, whole), in their order.

    Rows without a unit carry something else in `whole` and pass untouched. Units are exploded to substrings
    of bounded length and joined to the piece table by broadcast, on their hash and then letter by letter;
    that keeps a unit's edges together behind a row of its own, and they are grouped in passing, without a
    shuffle or a sort of rows. An edge travels as one number: rank, start, size and the mark of disorder. For
    merges the edges are two bit sets, of the cuts at an edge's ends and of those within it, by rank, start
    and size; else they are a list of cost, start and size for each character that they end at, which has an edge of its own, too. A unit is ordered if all its pieces are. Units of more than
    LONGEST characters have no edges: merged_parts() and viterbi_parts() give theirs, by encode() and unit_paths().
    """
    merges, longest = model["merges"], model["longest"]
    shortest = 2 if merges else 1
    costs = -np.array([*ranked(model), min(model["scores"].values()) - 10.0])  # the last one is that of a character without a piece
    n = F.length("unit")
    own = F.sequence(F.lit(-1), n - shortest)
    starts = units.select("number", "unit", "whole", F.explode(F.when(F.col("unit").isNotNull() & n.between(shortest, LONGEST), own).otherwise(F.array(F.lit(-1)))).alias("start"))
    sizes = F.sequence(F.lit(shortest), F.least(F.lit(longest), n - F.col("start")))
    sized = starts.select("*", F.explode(F.when(F.col("start") >= 0, sizes).otherwise(F.array(F.lit(0)))).alias("size"))
    alone = F.col("start") < 0
    parts = sized.withColumn("part", F.when(~alone, F.expr("substring(unit, start + 1, size)"))).withColumn("key", F.when(~alone, F.xxhash64("part")))
    joined = parts.join(F.broadcast(piece_table(units, model)), "key", "left").where("piece = part OR start < 0")  # one vocabulary: of fixed size
    code = F.when(alone, -1 - F.col("number").cast("long")).otherwise(F.col("code") + F.col("start") * 128 + F.col("size") * 2)
    found = joined.select(code.alias("code"), F.when(alone, F.col("unit")).alias("unit"), F.when(alone, F.col("whole")).alias("whole"))
    kinds = "array<struct<ends:bigint,inner:bigint>>" if merges else "array<array<struct<cost:double,start:int,size:int>>>"

    def grouped(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = batch.column(0).to_numpy(zero_copy_only=False)
        first = code < 0
        begin, own = np.flatnonzero(first), np.flatnonzero(~first)
        run = (np.cumsum(first) - 1)[own]
        edge = np.sort(run << 40 | code[own]) if merges else code[own]
        at = pa.array(begin)
        unit = batch.column(1).take(at)
        start, size, rank = edge >> 7 & 63, edge >> 1 & 63, edge >> 13 & 0x7FFFFFF
        one = np.int64(1)
        counts = np.bincount(run, minlength=len(begin))
        if merges:
            edges = pa.StructArray.from_arrays([pa.array((one << start) | (one << (start + size))), pa.array((one << (start + size)) - (one << (start + one)))], ["ends", "inner"])
        else:
            counts = np.where(counts > 0, pc.fill_null(pc.utf8_length(unit), 0).to_numpy(zero_copy_only=False), 0)  # of characters, from here on
            first_char = np.cumsum(counts) - counts
            chars = first_char[run] + start
            alone = np.ones(int(counts.sum()), bool)
            alone[chars[size == 1]] = False
            spelled = np.flatnonzero(alone)
            start = np.append(start, spelled - np.repeat(first_char, counts)[spelled])
            size, rank, end = np.append(size, np.ones(len(spelled), np.int64)), np.append(rank, np.full(len(spelled), len(costs) - 1)), np.append(chars + size - 1, spelled)
            by_end = np.argsort(end, kind="stable")
            ways = pa.StructArray.from_arrays([pa.array(costs[rank[by_end]]), pa.array(start[by_end].astype(np.int32)), pa.array(size[by_end].astype(np.int32))], ["cost", "start", "size"])
            edges = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(end, minlength=len(alone)))).astype(np.int32)), ways)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), edges)
        ordered = np.ones(len(begin), bool)
        ordered[run[(code[own] & 1).astype(bool)]] = False
        return pa.RecordBatch.from_arrays([pa.array((-1 - code[begin]).astype(np.int32)), unit, pa.array(ordered), lists, batch.column(2).take(at)], ["number", "unit", "ordered", "edges", "whole"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last unit of a batch waits for the next one."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            begin = np.flatnonzero(batch.column(0).to_numpy(zero_copy_only=False) < 0)
            cut = int(begin[-1]) if len(begin) else 0
            if len(begin):
                yield from map(grouped, pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches())
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from map(grouped, pa.Table.from_batches(held).combine_chunks().to_batches())

    return found.mapInArrow(group, f"number int, unit string, ordered boolean, edges {kinds}, whole binary")


def merged_cuts(edges: Column, n: Column, ordered: Column) -> Column:
    """Bit set of cuts after all merges: the best rank first, of equal ones the leftmost; edges come in that order."""
    every = F.call_function("shiftleft", F.lit(2).cast("long"), n) - F.lit(1).cast("long")

    def able(cuts: Column, e: Column) -> Column:
        return (cuts.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(cuts.bitwiseAND(e["inner"])) == 1)

    def merge(cuts: Column, _: Column) -> Column:
        best = F.get(F.filter(edges, lambda e: able(cuts, e)), F.lit(0))
        return cuts.bitwiseAND(F.bitwise_not(F.coalesce(best["inner"], F.lit(0).cast("long"))))

    once_over = F.aggregate(edges, every, lambda cuts, e: F.when(able(cuts, e), cuts.bitwiseAND(F.bitwise_not(e["inner"]))).otherwise(cuts))
    return F.when(ordered, once_over).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), every, merge))


def viterbi_cuts(edges: Column) -> Column:
    """Bit set of cuts of the path of highest score over edges by character, see lattice(): each is looked at once.

    Of equal paths the one with the longest last edge is taken.
    """
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("cuts")))

    def step(best: Column, arriving: Column) -> Column:
        ways = F.transform(arriving, lambda e: F.struct((F.get(best, e["start"])["score"] - e["cost"]).alias("score"), e["size"].alias("size"), F.get(best, e["start"])["cuts"].alias("cuts")))
        end = F.call_function("shiftleft", F.lit(1).cast("long"), F.size(best))
        return F.concat(best, F.transform(F.array(F.array_max(ways)), lambda top: F.struct(top["score"].alias("score"), top["cuts"].bitwiseOR(end).alias("cuts"))))

    return F.element_at(F.aggregate(edges, first, step), -1)["cuts"]


def unit_cuts(units: DataFrame, model: dict) -> DataFrame:
    """number, unit, cuts, whole of units(number, unit, whole); cuts are null where a unit has no edges."""
    edges = lattice(units, model)
    cuts = merged_cuts(F.col("edges"), F.length("unit"), F.col("ordered")) if model["merges"] else viterbi_cuts(F.col("edges"))
    return edges.select("number", "unit", F.when(F.size("edges") > 0, cuts).alias("cuts"), "whole")


def parts_of(unit: str, cuts: int | None) -> list[str]:
    """The unit at its cuts; every character on its own where there are none."""
    if cuts is None:
        return list(unit)
    parts, last = [], 0
    for i in range(1, len(unit) + 1):
        if cuts >> i & 1:
            parts.append(unit[last:i])
            last = i
    return parts


def merged_parts(unit: str, scores: dict[str, float]) -> list[str]:
    """The merges of a unit that is too long for the bits of a long, by a queue: same order, same result."""
    n = len(unit)
    after, before, part = list(range(1, n + 1)), list(range(-1, n - 1)), list(unit)
    queue: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (s := scores.get(part[i] + part[j])) is not None:
            heapq.heappush(queue, (-s, i, part[i] + part[j]))

    for i in range(n):
        offer(i)
    while queue:
        _, i, whole = heapq.heappop(queue)
        if not part[i] or after[i] >= n or part[i] + part[after[i]] != whole:
            continue
        j = after[i]
        part[i], part[j] = whole, ""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [p for p in part if p]


def unit_paths(units: DataFrame, model: dict) -> DataFrame:
    """unit, cuts, n_pieces, sizes of units(number, unit, whole) for a unigram model: the best path of each, of any length.

    sizes are the characters of its pieces. Up to LONGEST characters they are those between the cuts, or of one each where there are no
    edges; a longer unit has no cuts and its path by viterbi_parts(), which takes time and memory by its length.
    """
    sent = send(units.sparkSession, model)  # one vocabulary: of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, longest = sent.value[1]["scores"], sent.value[1]["longest"]
        unknown = min(scores.values()) - 10.0
        for batch in batches:
            unit, cuts = batch.columns
            n = pc.fill_null(pc.utf8_length(unit), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            every = (np.int64(2) << np.minimum(n, LONGEST)) - 1
            bits = np.where(pc.is_valid(cuts).to_numpy(zero_copy_only=False), pc.fill_null(cuts, 0).to_numpy(zero_copy_only=False), every)
            long = np.flatnonzero(n > LONGEST)
            bits[long] = 1  # no sizes from here
            row, end = np.nonzero(np.unpackbits(bits.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            own = np.flatnonzero(end > 0)
            sizes, counts = (end[own] - end[own - 1]).astype(np.int32), np.bincount(row[own], minlength=len(n))
            begin = np.cumsum(counts) - counts
            paths = [np.fromiter(map(len, viterbi_parts(unit[k].as_py(), scores, longest, unknown)), np.int32) for k in long.tolist()]
            if paths:
                sizes = np.insert(sizes, np.repeat(begin[long], [len(p) for p in paths]), np.concatenate(paths))
                counts[long] = [len(p) for p in paths]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(sizes))
            yield pa.RecordBatch.from_arrays([unit, cuts, pa.array(counts.astype(np.int32)), lists], ["unit", "cuts", "n_pieces", "sizes"])

    return unit_cuts(units, model).select("unit", "cuts").mapInArrow(run, "unit string, cuts long, n_pieces int, sizes array<int>")


def viterbi_parts(unit: str, scores: dict[str, float], longest: int, unknown: float | None = None) -> list[str]:
    """The best path of a unit that is too long for the bits of a long; unknown: the score of a character without a piece."""
    if unknown is None:
        unknown = min(scores.values()) - 10.0
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(unit) + 1):
        ways = [(best[end - k][0] + scores[unit[end - k : end]], k) for k in range(1, min(longest, end) + 1) if unit[end - k : end] in scores]
        if unit[end - 1] not in scores:
            ways.append((best[end - 1][0] + unknown, 1))
        best.append(max(ways))
    parts, end = [], len(unit)
    while end:
        parts.append(unit[end - best[end][1] : end])
        end -= best[end][1]
    return parts[::-1]


class Codec:
    """Pieces to ids and ids to text."""

    def __init__(self, model: dict):
        self.model, self.ids = model, model["ids"]
        self.find = re.compile(model["unit"]).findall
        spelled = {i: bytes([b]) for b, i in model["bytes"].items()}
        self.names, self.numbers = pa.array(self.ids), np.array([*self.ids.values(), 0], np.int32)
        self.spelled = np.array([model["bytes"].get(b, model["unknown"]) for b in range(256)], np.int32)
        self.raw = {i: p.replace(SPACE, " ").encode("utf-8") for p, i in self.ids.items()} | spelled | {model["unknown"]: " ⁇ ".encode()}

    def part_ids(self, part: str) -> list[int]:
        if (i := self.ids.get(part)) is not None:
            return [i]
        if self.model["bytes"]:
            return [self.model["bytes"][b] for b in part.encode("utf-8")]
        return [self.model["unknown"]]

    def unit_ids(self, unit: str, cuts: int | None) -> list[int]:
        if len(unit) > LONGEST:
            parts = merged_parts(unit, self.model["scores"]) if self.model["merges"] else viterbi_parts(unit, self.model["scores"], self.model["longest"])
        else:
            parts = parts_of(unit, cuts)
        return [i for p in parts for i in self.part_ids(p)]

    def cut_ids(self, units: pa.StringArray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units at their cuts, and how many each has."""
        offsets = np.frombuffer(units.buffers()[1], np.int32)[units.offset : units.offset + len(units) + 1].astype(np.int64)
        data = np.frombuffer(units.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.searchsorted(chars, offsets[:-1])
        unit = np.repeat(np.arange(len(units)), np.diff(np.append(first, len(chars))))
        place = np.arange(len(chars)) - first[unit]
        cut = (cuts[unit] >> place & 1).astype(bool) | (place == 0)
        begin, unit = chars[cut], unit[cut]
        size = np.diff(np.append(begin, len(data)))
        parts = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(data)).astype(np.int32)), pa.py_buffer(data))
        found = pc.fill_null(pc.index_in(parts, value_set=self.names), -1).to_numpy(zero_copy_only=False)
        unknown = np.flatnonzero(found < 0)
        many = np.ones(len(begin), np.int64)
        if self.model["bytes"]:
            many[unknown] = size[unknown]
        values = np.repeat(self.numbers[found], many)
        at = np.cumsum(many) - many
        of = np.repeat(unknown, many[unknown])
        within = np.arange(len(of)) - np.repeat(np.cumsum(many[unknown]) - many[unknown], many[unknown])
        values[at[of] + within] = self.spelled[data[begin[of] + within]] if self.model["bytes"] else self.model["unknown"]
        return values, np.bincount(unit, weights=many, minlength=len(units)).astype(np.int64)

    def all_ids(self, units: pa.StringArray, cuts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for units of any length; cuts are null where a unit has no edges."""
        known = pc.fill_null(cuts, -1).to_numpy(zero_copy_only=False)
        long = np.flatnonzero(pc.utf8_length(units).to_numpy(zero_copy_only=False) > LONGEST)
        values, counts, last = [], [], 0
        for k in [*long.tolist(), len(units)]:
            if k > last:
                found = self.cut_ids(units.slice(last, k - last), known[last:k])
                values.append(found[0])
                counts.append(found[1])
            if k < len(units):
                values.append(np.array(self.unit_ids(units[k].as_py(), None), np.int32))
                counts.append(np.array([len(values[-1])]))
            last = k + 1
        return np.concatenate(values), np.concatenate(counts)

    def decode(self, ids: list[int]) -> str:
        whole = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return whole[1:] if whole.startswith(" ") else whole


class Numbers(dict):
    """Units numbered in order of appearance, after the common ones; `fresh` are those that haven't left yet."""

    def __init__(self, common: dict[str, int]) -> None:
        super().__init__()
        self.common, self.next, self.size = common, len(common), 0
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        n = self.common.get(unit)
        if n is None:
            n = self.next
            self.next += 1
            self.fresh.append(unit)
            self.size += len(unit)
        self[unit] = n
        return n

    def full(self) -> bool:
        return self.next - len(self.common) > REMEMBERED or self.size > REMEMBERED_BYTES


def common_units(docs: DataFrame, text: str, model: dict, sent) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """At most COMMON units that are frequent in about SAMPLE documents, their ids, and how many each has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(sent.value[1]["unit"]).findall
        for batch in batches:
            for part in slices(batch, CRATE_ROWS, CRATE_BYTES):
                counts: Counter = Counter()
                for x in part.column(0).to_pylist():
                    counts.update(find(escaped(x or "")))
                kept = [(u, n) for u, n in counts.items() if len(u) <= COMMON_SIZE]
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["unit", "n"])

    chosen = docs.select(text).where(F.rand(17) < min(1.0, SAMPLE / max(docs.count(), 1)))
    counted = chosen.mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")).where("n > 1")
    units = counted.orderBy(F.desc("n"), "unit").limit(COMMON).toArrow().column("unit").combine_chunks()
    listed = docs.sparkSession.createDataFrame(pa.table({"number": pa.array(range(len(units)), pa.int32()), "unit": units, "whole": pa.nulls(len(units), pa.binary())}), "number int, unit string, whole binary")
    cuts = unit_cuts(listed, model).select("number", "unit", "cuts").toArrow().sort_by("number")
    if cuts.num_rows != len(units):
        raise RuntimeError("units were lost")
    units = cuts.column("unit").cast(pa.string()).combine_chunks()
    values, counts = Codec(model).all_ids(units, cuts.column("cuts").combine_chunks()) if len(units) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    return units, values, counts


def crated(docs: DataFrame, text: str, sent, common) -> DataFrame:
    """number, unit, whole: for each crate of rows the units that its task meets for the first time, then the crate.

    A crate has the rows' columns and the numbers of their texts' units. Its row's number is that of the units so
    far; an empty crate says that all but the common ones are forgotten and that numbers go on from these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value = common.value
        known = once(key, lambda: {u: n for n, u in enumerate(value[0].to_pylist())})
        find, numbers = re.compile(sent.value[1]["unit"]).findall, Numbers(known)
        for batch in batches:
            for part in slices(batch, CRATE_ROWS, CRATE_BYTES):
                first, flat, edges = numbers.next, [], [0]
                for x in part.column(part.schema.names.index(text)).to_pylist():
                    flat.append(np.fromiter(map(numbers.__getitem__, find(escaped(x or ""))), np.int32))
                    edges.append(edges[-1] + len(flat[-1]))
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(flat)))
                sink = pa.BufferOutputStream()
                whole = pa.RecordBatch.from_arrays([*part.columns, lists], [f"c{k}" for k in range(part.num_columns + 1)])
                with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                    out.write_batch(whole)
                crates = [sink.getvalue().to_pybytes()]
                units, numbers.fresh = numbers.fresh, []
                last = numbers.next
                if numbers.full():
                    numbers = Numbers(known)
                    crates.append(b"")
                place = np.append(np.arange(first, last), [last] * len(crates)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(units + [None] * len(crates), pa.string()), pa.array([None] * len(units) + crates, pa.binary())], ["number", "unit", "whole"])
        del numbers
        returned()

    return docs.mapInArrow(run, "number int, unit string, whole binary")


def extended(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """held with more behind its first `used` values, in twice the room where it is full."""
    if used + len(more) > len(held):
        held = np.concatenate([held[:used], np.zeros(max(used, len(more)), held.dtype)])
    held[used : used + len(more)] = more
    return held


class UnitIds:
    """Ids of units by number; the common ones come first."""

    def __init__(self, codec: Codec, values: np.ndarray, counts: np.ndarray):
        self.codec, self.common = codec, (values, counts)
        self.clear()

    def clear(self) -> None:
        self.known, self.size = 0, 0
        self.values, self.counts, self.begin = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.take(*self.common)

    def take(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.begin = extended(self.begin, self.known, self.size + np.cumsum(counts) - counts)
        self.counts = extended(self.counts, self.known, counts)
        self.values = extended(self.values, self.size, values)
        self.known += len(counts)
        self.size += len(values)

    def add(self, numbers: np.ndarray, units: pa.StringArray, cuts: pa.Array) -> None:
        if not np.array_equal(numbers, np.arange(self.known, self.known + len(numbers))):
            raise RuntimeError("units were lost or came in another order")
        self.take(*self.codec.all_ids(units, cuts))

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units with these numbers, one after the other, and how many there are up to each."""
        many = self.counts[numbers]
        upto = np.append(0, np.cumsum(many, dtype=np.int64))
        return self.values[np.repeat(self.begin[numbers] - upto[:-1], many) + np.arange(upto[-1])], upto


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every column of docs, then ids (array), n_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers), round_trip.

    ids are those that the sentencepiece library gives for the whole text, without begin or end. round_trip
    says whether decoding gives the text back; the visible blank U+2581 in a text decodes as a blank.
    Null and empty texts have no pieces and a null text decodes as empty, which is no round trip. Repeated
    rows and null keys stay as they are. Units that a sample shows to be common are segmented first, any other
    once for all the rows of a task in which it is remembered. Columns with a result's name are replaced.
    Units that are lost on the way raise. docs is read three times.
    """
    added = ["ids", "n_pieces", "ids_sha256", "round_trip"]
    if text in added:
        raise ValueError(f"the text column can't be named {text}")
    model = load_model(path)
    sent = send(docs.sparkSession, model)  # one vocabulary: of fixed size
    base = docs.select(*[c for c in docs.columns if c not in added])
    names = base.columns
    common = send(docs.sparkSession, common_units(base, text, model, sent))  # at most COMMON units of COMMON_SIZE
    cuts = unit_cuts(crated(base, text, sent, common), model)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value = sent.value
        units = UnitIds(once(key, lambda: Codec(value)), *common.value[1][1:])
        for batch in batches:
            numbers = batch.column(0).to_numpy(zero_copy_only=False)
            crates = np.flatnonzero(pc.is_valid(batch.column(3)).to_numpy(zero_copy_only=False)).tolist()
            begin = 0
            for end in [*crates, batch.num_rows]:
                if end > begin:
                    units.add(numbers[begin:end], batch.column(1).slice(begin, end - begin), batch.column(2).slice(begin, end - begin))
                begin = end + 1
                if end < batch.num_rows:
                    if numbers[end] != units.known:
                        raise RuntimeError("units were lost")
                    whole = batch.column(3)[end].as_buffer()
                    if not whole.size:
                        units.clear()
                    else:
                        yield from map(coded, repeat(units), pa.ipc.open_stream(whole))
        del units
        returned()

    def coded(units: UnitIds, batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(batch.num_columns - 1)
        ids, upto = units.of(lists.values.to_numpy())
        edges = upto[lists.offsets.to_numpy()]
        raw, decode_ids = ids.astype("<i4").tobytes(), units.codec.decode
        digests, trips = [], []
        for x, a, b in zip(batch.column(names.index(text)).to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            digests.append(hashlib.sha256(raw[4 * a : 4 * b]).hexdigest())
            trips.append(decode_ids(ids[a:b].tolist()) == x)
        made = [pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids)), pa.array(np.diff(edges)), pa.array(digests, pa.string()), pa.array(trips, pa.bool_())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*names, *added])

    columns = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), "ids array<int>, n_pieces long, ids_sha256 string, round_trip boolean"])
    return cuts.mapInArrow(finish, columns)


def decode(coded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """coded with the text of its ids; null ids give null, ids outside the vocabulary raise."""
    model = load_model(path)
    sent = send(coded.sparkSession, model)
    kept = [c for c in coded.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, value = sent.value
            codec = once(key, lambda: Codec(value))
            texts = [None if x is None else codec.decode(x) for x in batch.column(batch.schema.names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    columns = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.select(*kept).schema), f"`{out}` string"])
    return coded.select(*kept).mapInArrow(run, columns)
