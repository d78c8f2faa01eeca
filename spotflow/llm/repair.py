"""Repair of conversations' structure by a time-major tensor program.

Rows of a conversation become a column of codes; conversations of about one length are the columns of one tensor, and
costs of all of them are updated turn by turn, from the last to the first. What each turn costs from there on is
stored, and all edits are traced by it from the first turn on. A long conversation is cut into segments: a segment's
program is run for every state behind it, which gives a small matrix; these matrices are folded to the cost behind
each segment, and the segments are then solved like conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stored

#: What an edit costs; a row cut short that stays costs as much again as TRUNCATED.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing said, only the system's row, the user has spoken, the assistant has.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a user's or the assistant's row that comes next, by state.
NEXT = np.array([USER, USER, ASSISTANT, USER])
NEVER = 1 << 40
#: Rows (of equal copies one) and bytes of text in one segment.
SEGMENT_ROWS, SEGMENT_BYTES = 1024, 1 << 20


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, there: rows as a fixed hash of conv_id and turn spoils them; there is false for one that is dropped.

    Nulls are one space wherever they are read: in the hash, as role and as text. conv_id and turn stay null.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).alias("way")
    rows = df.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), way)
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    made = rows.select("conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("way") != 0).alias("there"), F.when(F.col("way") == 3, 2).otherwise(1).alias("copies"))
    return made.select("conv_id", "turn", "role", "text", "there", "copies")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows in whole order, as segments: conv_id, part, chunk, whole and lists of turn, role, text, copies and fresh, of a bounded number of rows.

    Equal rows of a turn are one with the number of copies. fresh: none before it in the conversation has its role and
    text. Rows of a conversation are in order of turn (nulls first), role and text; segments in that of part
    and chunk. whole: the segment is all of its conversation. A conversation may be as long as it likes: rows are
    dealt by range, never by conversation. Each conversation has a segment, be it empty.
    """
    kinds = dict(rows.dtypes)
    zero = lambda c: F.lit("") if kinds[c] == "string" else F.lit(0).cast(kinds[c])
    there = F.col("there")
    said = lambda c: F.when(there, F.col(c)).otherwise("").alias(c)
    keyed = rows.select(
        F.col("conv_id").isNull().alias("no_conv"), F.coalesce("conv_id", zero("conv_id")).alias("conv"),
        (F.col("turn").isNotNull() & there).alias("has_turn"), F.when(there, F.coalesce("turn", zero("turn"))).otherwise(zero("turn")).alias("at"),
        F.when(there, F.sha2(F.concat("role", F.lit("\0"), "text"), 256)).otherwise("").alias("mark"), said("role"), said("text"), "copies",
    )
    keys = ["no_conv", "conv", "mark", "has_turn", "at"]
    first = keyed.groupBy("no_conv", "conv", "mark").agg(F.min(F.struct("has_turn", "at")).alias("first")).select("no_conv", "conv", "mark", "first.*", F.lit(True).alias("fresh"))
    held = keyed.groupBy(*keys).agg(F.max("role").alias("role"), F.max("text").alias("text"), F.sum("copies").alias("copies"))
    flagged = held.join(first, keys, "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    order = ["no_conv", "conv", "has_turn", "at", "role", "text"]
    sorted_ = flagged.repartitionByRange(*order).sortWithinPartitions(*order)
    conv = F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id")
    turn = F.when(F.col("has_turn"), F.col("at")).alias("turn")
    narrow = sorted_.select(F.spark_partition_id().alias("part"), conv, (F.col("mark") != "").alias("there"), turn, "role", "text", "copies", "fresh")
    types = dict(narrow.dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order; a segment is closed by another conversation or by its size."""
        names, kind, done, chunk, opened, since = ["turn", "role", "text", "copies", "fresh"], None, [], 0, None, 0
        lists: dict[str, list] = {n: [] for n in names}
        size = 0

        def close(ends: bool) -> None:
            # a conversation at either end of the part may go on in another one
            nonlocal lists, size, chunk
            done.append((opened[0], chunk, opened[1], ends and since == chunk and chunk > 0, lists))
            lists, size, chunk = {n: [] for n in names}, 0, chunk + 1

        def made() -> pa.RecordBatch:
            columns = [pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], kind.field("conv_id").type), pa.array([d[3] for d in done], pa.bool_())]
            columns += [pa.array([d[4][n] for d in done], pa.list_(kind.field(n).type)) for n in names]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, ["part", "chunk", "conv_id", "whole", *names])

        for batch in batches:
            kind = batch.schema
            for part, conv, there, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if opened != (part, conv):
                    if opened is not None:
                        close(True)
                    opened, since = (part, conv), chunk
                elif len(lists["turn"]) >= SEGMENT_ROWS or size >= SEGMENT_BYTES:
                    close(False)
                if there:
                    for n, value in zip(names, row, strict=True):
                        lists[n].append(value)
                    size += len(row[2])
            if done:
                yield made()
        if opened is not None:
            close(False)
            yield made()

    lists = f"turn array<{types['turn']}>, role array<string>, text array<string>, copies array<bigint>, fresh array<boolean>"
    return map_rows(narrow, pack, f"part int, chunk int, conv_id {types['conv_id']}, whole boolean, {lists}")


# codes of rows


def codes(role: list[str], text: list[str], copies: list[int], fresh: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: state that its role leads to or -1, fault (0 none, 1 blank, 2 duplicate, 3 truncated), of the first of its copies."""
    initial = np.array([{"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(r[:1], -1) for r in role], np.int64)
    fault = np.zeros(len(role), np.int64)
    for i, x in enumerate(text):
        last = x.rstrip(" \t\n\v\f\r")
        fault[i] = 1 if not last else 2 if not fresh[i] else 3 if last[-1] not in ".!?" else 0
    return initial, fault, np.array(copies, np.int64)


class Tensor:
    """Rows of conversations of about one length, time-major: [turn, conversation]; short ones end in rows that are not there."""

    def __init__(self, columns: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.length = np.array([len(c[0]) for c in columns])
        t, n = int(self.length.max(initial=0)), len(columns)
        self.initial, self.fault, self.copies = (np.full((t, n), fill) for fill in (-1, 0, 1))
        for k, (initial, fault, copies) in enumerate(columns):
            m = len(initial)
            self.initial[:m, k], self.fault[:m, k], self.copies[:m, k] = initial, fault, copies

    def costs(self, behind: np.ndarray) -> np.ndarray:
        """[turn + 1, state, ...]: least cost from before that turn on, where behind [state, conversation, ...] is what comes after the last."""
        t, n = self.initial.shape
        extra = (None,) * (behind.ndim - 2)
        out = np.empty((t + 1, *behind.shape), np.int64)
        out[t] = behind
        for i in range(t - 1, -1, -1):
            later = out[i + 1]
            initial, fault = self.initial[i][(slice(None), *extra)], self.fault[i][(slice(None), *extra)]
            copies = self.copies[i][(slice(None), *extra)]
            must = (fault == 1) | (fault == 2)
            cut = np.where(fault == 3, TRUNCATED, 0)
            here = np.empty_like(behind)
            for q in range(4):
                fits = ~must & ((initial == NEXT[q]) | ((q == START) & (initial == SYSTEM)))
                kept = np.where((q == START) & (initial == SYSTEM), later[SYSTEM], later[NEXT[q]]) + cut + KEEP
                changed = np.where(must, NEVER, later[NEXT[q]] + cut + REROLE)
                here[q] = np.minimum(np.minimum(np.where(fits, kept, NEVER), changed), later[q] + DELETE)
            here += np.where(copies > 1, (copies - 1) * DELETE, 0)  # the further copies of a row go
            inserted(here)
            there = (i < self.length)[(slice(None), *extra)]
            out[i] = np.where(there, np.minimum(here, NEVER), later)
        return out

    def traced(self, costs: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edits as letters [turn, place, conversation], roles in the result alike (0 none, 1 as it was, 2 user, 3 assistant), and the state behind.

        costs [turn + 1, state, conversation]; of edits as cheap that of the least letter is taken. Rows may be
        inserted behind the last one only where last is true.
        """
        t, n = self.initial.shape
        letters, roles = np.zeros((t + 1, 4, n), np.uint8), np.zeros((t + 1, 4, n), np.uint8)
        state, every = state.copy(), np.arange(n)
        for i in range(t + 1):
            busy = (i < self.length) if i < t else np.zeros(n, bool)
            if i == t:
                busy = last.copy()
            for place in range(4):
                if not busy.any():
                    break
                own = costs[i][state, every]
                onward = NEXT[state]
                more = costs[i][onward, every] + INSERT == own
                if i == t:
                    insert = busy & (own > 0) & more
                    delete = keep = change = np.zeros(n, bool)
                else:
                    later, initial, fault = costs[i + 1], self.initial[i], self.fault[i]
                    rest = own - (self.copies[i] - 1) * DELETE
                    must, cut = (fault == 1) | (fault == 2), np.where(fault == 3, TRUNCATED, 0)
                    opening = (state == START) & (initial == SYSTEM)
                    into = np.where(opening, SYSTEM, onward)
                    delete = busy & (later[state, every] + DELETE == rest)
                    insert = busy & ~delete & more
                    keep = busy & ~delete & ~insert & ~must & (opening | (initial == onward)) & (later[into, every] + cut + KEEP == rest)
                    change = busy & ~delete & ~insert & ~keep
                for where, letter in ((delete, b"D"), (insert, b"I"), (keep, b"K"), (change, b"R")):
                    letters[i, place, where] = letter[0]
                spoken = np.where(onward == USER, 2, 3)
                roles[i, place] = np.where(insert | change, spoken, np.where(keep, 1, 0))
                if i < t:
                    state = np.where(keep, into, np.where(insert | change, onward, state))
                else:
                    state = np.where(insert, onward, state)
                busy = insert
        return letters, roles, state


def inserted(cost: np.ndarray) -> None:
    """Lower costs [state, ...] by rows that are put in here."""
    user, assistant = cost[USER].copy(), cost[ASSISTANT].copy()
    cost[USER] = np.minimum(user, assistant + INSERT)
    cost[ASSISTANT] = np.minimum(assistant, user + INSERT)
    cost[START] = np.minimum(cost[START], cost[USER] + INSERT)
    cost[SYSTEM] = np.minimum(cost[SYSTEM], cost[USER] + INSERT)


def ending(n: int) -> np.ndarray:
    """Cost of each state [state, conversation] behind the last row of a conversation."""
    cost = np.full((4, n), NEVER, np.int64)
    cost[START] = cost[ASSISTANT] = 0
    inserted(cost)
    return cost


def buckets(lengths: list[int]) -> Iterator[list[int]]:
    """Indices of lengths, those of one power of two together, some hundred thousand rows at most."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__)
    begin = 0
    while begin < len(order):
        kind, end = lengths[order[begin]].bit_length(), begin
        while end < len(order) and lengths[order[end]].bit_length() == kind and (end - begin) << kind <= 1 << 18:
            end += 1
        yield order[begin : max(end, begin + 1)]
        begin = max(end, begin + 1)


def columns_of(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    names = batch.schema.names
    return [codes(*row) for row in zip(*(batch.column(names.index(n)).to_pylist() for n in ("role", "text", "copies", "fresh")), strict=True)]


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, part, chunk, matrix (cost from a state before the segment to one behind it) and the segment's codes."""
    for batch in batches:
        own = columns_of(batch)
        found: list = [None] * len(own)
        for picked in buckets([len(c[0]) for c in own]):
            behind = np.full((4, len(picked), 4), NEVER, np.int64)
            behind[np.arange(4), :, np.arange(4)] = 0
            cost = Tensor([own[i] for i in picked]).costs(behind)[0]
            for k, i in enumerate(picked):
                found[i] = cost[:, k].ravel().tolist()
        at = batch.schema.names.index
        lists = [pa.array([c[j].tolist() for c in own], pa.list_(pa.int64())) for j in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column(at("conv_id")), batch.column(at("part")), batch.column(at("chunk")), pa.array(found, pa.list_(pa.int64())), *lists], ["conv_id", "part", "chunk", "matrix", "initial", "fault", "copies"])


def folded_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, chunk, behind, last: the cost behind each segment; segments come conversation by conversation, the last one first."""
    conv, cost, begun = None, None, False
    for batch in batches:
        behind, last = [], []
        for own, matrix in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            fresh = not begun or own != conv
            if fresh:
                conv, cost, begun = own, ending(1)[:, 0], True
            last.append(fresh)
            behind.append(cost.tolist())
            cost = (np.array(matrix).reshape(4, 4) + cost).min(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(behind, pa.list_(pa.int64())), pa.array(last, pa.bool_())], ["part", "chunk", "behind", "last"])


def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, part, chunk, behind, last and the state behind the segment for each state before it."""
    for batch in batches:
        conv, part, chunk, *lists, last, behind = (c.to_pylist() for c in batch.columns)
        own = [tuple(np.array(x, np.int64) for x in row) for row in zip(*lists, strict=True)]
        found = [[0] * 4 for _ in own]
        for picked in buckets([len(c[0]) for c in own]):
            tensor = Tensor([own[i] for i in picked])
            costs = tensor.costs(np.array([behind[i] for i in picked], np.int64).T.copy())
            for q in range(4):
                for i, state in zip(picked, tensor.traced(costs, np.full(len(picked), q), np.zeros(len(picked), bool))[2].tolist(), strict=True):
                    found[i][q] = state
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int32())), batch.column(6), batch.column(7)], ["conv_id", "part", "chunk", "exits", "last", "behind"])


def folded_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, chunk, behind, last, state: that before each segment; segments come conversation by conversation, in order."""
    conv, state, begun = None, START, False
    for batch in batches:
        found = []
        for own, ways in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if not begun or own != conv:
                conv, state, begun = own, START, True
            found.append(state)
            state = ways[state]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(5), batch.column(4), pa.array(found, pa.int32())], ["part", "chunk", "behind", "last", "state"])


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with the cost behind them and the state before them become repaired ones, see repair()."""
    for batch in batches:
        at = batch.schema.names.index
        own = columns_of(batch)
        turns, role, text, behind, last, state = (batch.column(at(n)).to_pylist() for n in ("turn", "role", "text", "behind", "last", "state"))
        rows: list = [None] * len(own)
        for picked in buckets([len(c[0]) for c in own]):
            tensor = Tensor([own[i] for i in picked])
            after = ending(len(picked))
            for k, i in enumerate(picked):
                if behind[i] is not None:
                    after[:, k] = behind[i]
            costs = tensor.costs(after)
            entry = np.array([state[i] or START for i in picked])
            letters, roles, _ = tensor.traced(costs, entry, np.array([last[i] for i in picked]))
            for k, i in enumerate(picked):
                m, t = len(own[i][0]), len(letters) - 1
                audit, messages = [], []
                for j in [*range(m), t]:
                    letter = letters[j, :, k]
                    audit.append(letter[letter > 0].tobytes().decode())
                    if j < t:
                        audit.append("D" * (int(own[i][2][j]) - 1))
                    for way in roles[j, letter > 0, k].tolist():
                        # only the row itself has a text, and it comes behind what is put in before it
                        if way:
                            messages.append({"role": role[i][j] if way == 1 else "user" if way == 2 else "assistant", "text": ""})
                    if j < t and audit[-2][-1] in "KR":
                        messages[-1]["text"] = text[i][j]
                fault, copies = own[i][1], own[i][2]
                initials = [r[:1] for r in role[i]]
                inside = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])) + sum(int(c) - 1 for c in copies)
                known = [x for x in turns[i] if x is not None]
                rows[i] = {
                    "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "turns": len(set(known)),
                    "blank": int(copies[fault == 1].sum()), "duplicate": int(copies[fault == 2].sum() + (copies - 1)[(fault == 0) | (fault == 3)].sum()), "truncated": int((fault == 3).sum()),
                    "illegal": inside, "opens": initials[0] if initials else None, "closes": initials[-1] if initials else None,
                    "cost": int(costs[0, entry[k], k]), "audit": "".join(audit), "messages": messages,
                }
        turn = pa.int64()
        kinds = {"first_turn": turn, "last_turn": turn, "opens": pa.string(), "closes": pa.string(), "audit": pa.string(), "messages": pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))}
        made = [pa.array([r[n] for r in rows], kinds.get(n, pa.int64())) for n in OUTCOME]
        yield pa.RecordBatch.from_arrays([*(batch.column(at(n)) for n in ("conv_id", "part", "chunk", "whole")), *made], ["conv_id", "part", "chunk", "whole", *OUTCOME])


OUTCOME = ["first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal", "opens", "closes", "cost", "audit", "messages"]
_OUTCOME_KINDS = "first_turn bigint, last_turn bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, opens string, closes string, cost bigint, audit string, messages array<struct<role: string, text: string>>"


def repair(rows: DataFrame) -> DataFrame:
    """Both of repaired_parts() as one table."""
    short, long = repaired_parts(rows)
    return short.unionByName(long)


def repaired_parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they should be, whole ones and those that may be cut, in segments: conv_id, part, chunk, whole, what was found, cost, audit and messages (role, text).

    rows: conv_id, turn (whole numbers), role, text and there, copies, as damaged() makes them; other columns are
    left out. The cheapest edits give role initials (s?(ua)+)?: rows are kept, get the role of user or assistant (3), go (4;
    blank ones and those said before have to) or are put in without text (3); a row cut short that stays costs 3. Of edits as
    cheap those count whose letters D, I, K, R come first. Rows of one turn are in order of role and text, a turn
    of null comes first, repeated rows are duplicates. A conversation that loses all its rows has an empty segment.
    Segments of a conversation follow each other by part and chunk; cost is that from the segment's
    begin to the conversation's end, first_turn and last_turn leave out nulls, illegal counts inside the segment.
    """
    segments = stored(ordered(rows), "segments")
    conv = f"conv_id {dict(segments.dtypes)['conv_id']}"
    kinds = f"{conv}, part int, chunk int, whole boolean, {_OUTCOME_KINDS}"
    none = [F.lit(None).cast("array<bigint>").alias("behind"), F.lit(True).alias("last"), F.lit(START).alias("state")]
    short = map_rows(segments.where("whole").select("*", *none), solved, kinds, rows=4000)
    # a conversation that may be cut: matrices, folded from its end, then states, folded from its begin
    long = segments.where("NOT whole")
    made = stored(map_rows(long, matrices, f"{conv}, part int, chunk int, matrix array<bigint>, initial array<bigint>, fault array<bigint>, copies array<bigint>"), "matrices")
    light = made.select("conv_id", "part", "chunk", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("chunk"))
    behind = map_rows(light, folded_back, "part int, chunk int, behind array<bigint>, last boolean")
    both = made.drop("matrix").join(behind, ["part", "chunk"]).select("conv_id", "part", "chunk", "initial", "fault", "copies", "last", "behind")
    ways = map_rows(both, exits, f"{conv}, part int, chunk int, exits array<int>, last boolean, behind array<bigint>")
    states = map_rows(ways.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk"), folded_on, "part int, chunk int, behind array<bigint>, last boolean, state int")
    return short, map_rows(long.join(states, ["part", "chunk"]), solved, kinds, rows=4000)


def summaries(short: DataFrame, long: DataFrame) -> DataFrame:
    """A row for each conversation of repaired_parts(): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    repaired_sha256 is of role:text of all messages, newline-joined; it is taken in passing, segment by segment.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def closed() -> dict:
            span = now["high"] - now["low"] + 1 - now["turns"] if now["low"] is not None else 0
            return {"conv_id": now["conv_id"], "gaps": span, **{n: now[n] for n in ("blank", "duplicate", "truncated", "illegal", "cost")}, "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()}

        for batch in batches:
            done = []
            names = batch.schema.names
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = dict(zip(names, row, strict=True))
                if now is None or r["whole"] or now["whole"] or now["conv_id"] != r["conv_id"]:
                    if now is not None:
                        done.append(closed())
                    now = {"conv_id": r["conv_id"], "whole": r["whole"], "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": r["cost"], "audit": [], "hash": hashlib.sha256(), "said": False, "closes": None}
                if r["first_turn"] is not None:
                    now["turns"] += r["turns"] - (now["high"] == r["first_turn"])
                    now["low"] = r["first_turn"] if now["low"] is None else now["low"]
                    now["high"] = r["last_turn"]
                for n in ("blank", "duplicate", "truncated", "illegal"):
                    now[n] += r[n]
                if r["opens"] is not None:
                    now["illegal"] += now["closes"] is not None and now["closes"] + r["opens"] not in ("su", "ua", "au")
                    now["closes"] = r["closes"]
                now["audit"].append(r["audit"])
                for m in r["messages"]:
                    now["hash"].update((("\n" if now["said"] else "") + m["role"] + ":" + m["text"]).encode("utf-8", "replace"))
                    now["said"] = True
            if done:
                yield _summary(done, batch)
            last = batch
        if now is not None:
            yield _summary([closed()], last)

    conv = f"conv_id {dict(short.dtypes)['conv_id']}"
    kinds = f"{conv}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    cut = long.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    return map_rows(short, merge, kinds).unionByName(map_rows(cut, merge, kinds))


def _summary(rows: list[dict], like: pa.RecordBatch) -> pa.RecordBatch:
    kinds = {"conv_id": like.schema.field("conv_id").type, "audit": pa.string(), "repaired_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.int64())) for n in rows[0]], list(rows[0]))


def messages(segments: DataFrame) -> DataFrame:
    """conv_id, part, chunk, place, role, text: the repaired conversations, message by message, in this order."""
    return segments.select("conv_id", "part", "chunk", F.posexplode("messages").alias("place", "message")).select("conv_id", "part", "chunk", "place", "message.role", "message.text")
