"""Chat formatting by quotation linking.

A message's quoted passages are parsed with their nesting level, hashed after normalisation and joined to
the message of the same conversation that first said them. Conversations are then written without quotes,
each reply behind the message that it answers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, map_rows, numbered, stored

QUOTED = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.DOTALL)
ATTRIBUTION = re.compile(r".*\b(wrote|writes|said|schrieb|écrit|escribió)\s*:\s*", re.IGNORECASE | re.DOTALL)
PARAGRAPHS = re.compile(r"\n\s*\n")
#: Turns in one row of a formatted conversation; longer conversations take several rows, cut from one order.
BLOCK = 256
#: How precisely a passage was found: the whole message, one of its paragraphs, one of its lines.
WHOLE, PARAGRAPH, LINE = 0, 1, 2


def normal(passage: str) -> str:
    """Case and white space don't count, nor do quotation marks and points at the ends."""
    return " ".join(passage.casefold().split()).strip("\"'“”„«»‚‘’ ….")


def passage_hash(passage: str) -> bytes | None:
    n = normal(passage)
    return hashlib.md5(n.encode("utf-8", "replace")).digest() if n else None


def parse_message(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes and the lines that announce them, and the passages with their levels.

    Neighbouring lines of one level are one passage.
    """
    body: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    inside = 0
    for line in (text or "").split("\n"):
        found = QUOTED.fullmatch(line)
        if found:
            level = found[1].count(">")
            if not inside and body and ATTRIBUTION.fullmatch(body[-1]):
                body.pop()
            if inside == level:
                quotes[-1][1].append(found[2])
            elif ATTRIBUTION.fullmatch(found[2]):
                pass  # announces a deeper quote
            else:
                quotes.append((level, [found[2]]))
                inside = level
        else:
            inside = 0
            body.append(line)
    return "\n".join(body).strip(), [(level, "\n".join(lines).strip()) for level, lines in quotes]


def original_hashes(body: str) -> list[tuple[bytes, int]]:
    """Hashes under which a message can be quoted, the most precise kind for each."""
    found: dict[bytes, int] = {}
    for kind, parts in ((WHOLE, [body]), (PARAGRAPH, PARAGRAPHS.split(body)), (LINE, body.split("\n"))):
        for part in parts:
            if (h := passage_hash(part)) is not None:
                found.setdefault(h, kind)
    return sorted(found.items())


def quote_hashes(quotes: list[tuple[int, str]]) -> list[tuple[int, bytes]]:
    """Level and hash of each passage, and of each paragraph and line of it."""
    found = {(level, h) for level, passage in quotes for part in (passage, *PARAGRAPHS.split(passage), *passage.split("\n")) if (h := passage_hash(part)) is not None}
    return sorted(found)


PARSED = "content string, n_quotes int, said array<struct<hash:binary,kind:int>>, quoted array<struct<level:int,hash:binary>>"


def parsed_messages(messages: DataFrame, text: str = "text") -> DataFrame:
    """messages without text, and content, n_quotes, said (hashes to be quoted by), quoted (level and hash)."""
    kept = [c for c in messages.columns if c != text]
    pair = lambda a, b: pa.list_(pa.struct([a, b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, n, said, quoted = [], [], [], []
            for x in batch.column(batch.num_columns - 1).to_pylist():
                body, quotes = parse_message(x)
                content.append(body)
                n.append(len(quotes))
                said.append([{"hash": h, "kind": k} for h, k in original_hashes(body)])
                quoted.append([{"level": level, "hash": h} for level, h in quote_hashes(quotes)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(content, pa.string()), pa.array(n, pa.int32()), pa.array(said, pair(("hash", pa.binary()), ("kind", pa.int32()))), pa.array(quoted, pair(("level", pa.int32()), ("hash", pa.binary())))], [*kept, "content", "n_quotes", "said", "quoted"])

    columns = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.select(*kept).schema), PARSED])
    return map_rows(messages.select(*kept, text), run, columns)


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each message: conv_id, turn, role, content, n_quotes, reply_to, quoted_turns.

    reply_to is the earliest earlier turn that said the outermost passage that was found, null if none was;
    the most precise match counts, then the lowest turn. quoted_turns are all turns that its passages came
    from. Null texts are empty; a null conversation or turn links to nothing; repeated rows stay repeated;
    other columns are dropped. The earliest turn of each hash is found before the join, so that a passage
    that a conversation repeats isn't paired with each of its copies. Of messages with one turn the reply goes
    to that turn. Rows are parsed and numbered once, and stored.
    """
    base = messages.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    parsed = numbered(parsed_messages(base), "row", "parsed")  # parsed once, for what is said, what is quoted and the result
    said = (
        parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
        .select("conv_id", "turn", F.explode("said").alias("s"))
        .groupBy("conv_id", F.col("s.hash").alias("hash"))
        .agg(F.min(F.struct("turn", F.col("s.kind").alias("kind"))).alias("first"))
    )
    asked = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("row", "conv_id", F.col("turn").alias("at"), F.explode("quoted").alias("q")).select("row", "conv_id", "at", "q.level", "q.hash")
    found = asked.join(said, ["conv_id", "hash"]).where("first.turn < at")
    links = found.groupBy("row").agg(F.min(F.struct("level", "first.kind", "first.turn")).alias("best"), F.array_sort(F.collect_set("first.turn")).alias("quoted_turns"))
    return (
        parsed.join(links, "row", "left")
        .select("conv_id", "turn", "role", "content", "n_quotes", F.col("best.turn").alias("reply_to"), F.coalesce("quoted_turns", F.array().cast("array<bigint>")).alias("quoted_turns"))
    )


def reply_order(messages: list[dict]) -> list[dict]:
    """Depth first: a message's replies follow it, in turn order; what answers nothing here keeps its turn's place."""
    here = {m["turn"] for m in messages}
    below: dict = {}
    tops = []
    for m in messages:
        if m["reply_to"] is not None and m["reply_to"] in here:
            below.setdefault(m["reply_to"], []).append(m)
        else:
            tops.append(m)
    ordered, stack = [], tops[::-1]
    while stack:
        m = stack.pop()
        ordered.append(m)
        stack += below.pop(m["turn"], [])[::-1]
    return ordered


def prefix_sums(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df and before: the sum of value over all rows that come earlier by keys.

    Ranges are summed one by one; the driver sees one number for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            v = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False)
            upto = total + np.cumsum(v)
            total = int(upto[-1]) if len(v) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - v, pa.int64()), pa.array(np.full(len(v), task), pa.int64())], [*batch.schema.names, "before", "task"])

    columns = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "before long, task long"])
    held = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, columns), "sums")
    base, total = [], 0
    for r in held.groupBy("task").agg(F.sum(value).alias("n")).orderBy("task").collect():
        base.append((r.task, total))
        total += r.n
    start = df.sparkSession.createDataFrame(base, "task long, start long")
    return held.join(F.broadcast(start), "task").withColumn("before", F.col("before") + F.col("start")).drop("task", "start")


def reply_places(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, place: each node's place when the trees of links(id, parent) are walked depth first, children by id.

    nodes(id) are numbered from 0 with parents below their children. Sizes of subtrees, then distances from
    the root, are summed by pointer doubling: as many stored rounds as the logarithm of the depth.
    """
    state = stored(nodes.join(links, "id", "left").select("id", "parent", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size")), "sizes")
    while state.where("up IS NOT NULL").limit(1).count():
        more = state.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("more"))
        above = state.where("up IS NOT NULL").select(F.col("id").alias("up"), F.col("up").alias("further"))
        old, state = state, stored(state.join(more, "id", "left").join(above, "up", "left").select("id", "parent", F.col("further").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "sizes")
        forget(old)
    placed = prefix_sums(state.select("id", F.coalesce("parent", F.lit(-1)).alias("parent"), "size"), ["parent", "id"], "size")
    first = placed.where("parent >= 0").groupBy("parent").agg(F.min("before").alias("first"))
    below = placed.where("parent >= 0").join(first, "parent").select("id", F.col("parent").alias("up"), (F.col("before") - F.col("first") + 1).alias("place"))
    state = stored(below.union(placed.where("parent < 0").select("id", F.lit(None).cast("long"), F.col("before"))), "places")
    while state.where("up IS NOT NULL").limit(1).count():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("place").alias("more"))
        old, state = state, stored(state.join(above, "up", "left").select("id", F.col("further").alias("up"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")), "places")
        forget(old)
    return state.select("id", "place")


def placed_messages(linked: DataFrame, block: int) -> DataFrame:
    """linked with part and at, the message's place, for conversations of any length; none is gathered."""
    order = ["conv_id", "turn", "role", "content", "reply_to"]
    held = stored(prefix_sums(linked.select(*order, "crowded").withColumn("one", F.lit(1).cast("long")), order, "one").withColumnRenamed("before", "id").drop("one"), "turns")
    first = held.groupBy("conv_id", F.col("turn").alias("reply_to")).agg(F.min("id").alias("parent"))
    links = held.where("reply_to < turn").join(first, ["conv_id", "reply_to"]).select("id", "parent")
    places = reply_places(links, held.select("id"))
    slot = held.select(F.col("id").alias("at"), F.when(F.col("crowded"), F.floor(F.col("id") / block)).otherwise(part_of("turn", block)).alias("part"))
    return held.join(places.withColumnRenamed("place", "at"), "id").join(slot, "at").select(*order, "part", "at")


def part_of(turn: str, block: int) -> Column:
    return F.coalesce(F.floor(F.col(turn) / block), F.lit(0)).cast("long")


def with_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", levels: int = 3) -> DataFrame:
    """messages whose texts quote earlier turns, for tables in which nobody quotes.

    A message quotes its turn modulo levels + 1 messages before it, as far as there are any: the one before
    it at level 1, the one before that at level 2, and so on, each line behind as many marks, above its own text.
    """
    of = Window.partitionBy(conv).orderBy(turn)
    marked = [
        F.when(F.col(turn) % (levels + 1) >= level, F.regexp_replace(F.lag(F.col(text), level).over(of), "(?m)^", "> " * level))
        for level in range(1, levels + 1)
    ]
    return messages.withColumn(text, F.concat_ws("\n", *marked, F.coalesce(F.col(text), F.lit(""))))


def conversations(linked: DataFrame, block: int = BLOCK) -> DataFrame:
    """Formatted conversations: conv_id, part, n_messages, n_linked, turns, chat.

    chat holds the messages in reply order, `<|role|>` and content on lines of their own; empty messages
    are kept. The order is that of the whole conversation, which takes rows one after the other so that none
    is gathered whole: part p has as many messages as the conversation has turns from p * block on, below
    (p + 1) * block. Rows whose conversation is null form a group of their own by turn; a null turn counts
    as part 0, first. Conversations without a reply across such a border are ordered part by part, which
    gives the same. Where so many rows have the same turns, or no conversation, that a part would have more than
    2 * block messages, parts are cut every `block` rows of all such conversations one after the other.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, chats = [], []
            for rows in batch.column(batch.num_columns - 1).to_pylist():
                ordered = rows if rows[0]["at"] is not None else reply_order(rows)
                turns.append([m["turn"] for m in ordered])
                chats.append("\n".join(f"<|{m['role'] or ''}|>\n{m['content']}" for m in ordered))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(turns, pa.list_(pa.int64())), pa.array(chats, pa.string())], [*batch.schema.names[:-1], "turns", "chat"])

    kind = dict(linked.dtypes)["conv_id"]
    held = stored(linked.select("conv_id", "turn", "role", "content", F.col("reply_to").cast("long").alias("reply_to")), "linked")
    across = held.where(part_of("reply_to", block) < part_of("turn", block)).where("conv_id IS NOT NULL AND reply_to IS NOT NULL").select("conv_id", F.lit(False).alias("crowded"))
    crowded = held.groupBy("conv_id", part_of("turn", block).alias("part")).count().where(F.col("count") > 2 * block).select("conv_id", F.lit(True).alias("crowded"))
    whole = across.union(crowded).groupBy(F.col("conv_id").alias("long_id")).agg(F.max("crowded").alias("crowded"))
    messages = held.withColumn("part", part_of("turn", block)).withColumn("at", F.lit(None).cast("long"))
    if whole.limit(1).count():
        whole = stored(whole, "whole")
        same = F.col("conv_id").eqNullSafe(F.col("long_id"))
        messages = messages.join(whole, same, "left_anti").union(placed_messages(held.join(whole, same), block).select(*messages.columns))
    grouped = messages.groupBy("conv_id", "part").agg(
        F.count("*").alias("n_messages"),
        F.count("reply_to").alias("n_linked"),
        F.array_sort(F.collect_list(F.struct("at", "turn", "role", "content", "reply_to"))).alias("messages"),
    )
    return map_rows(grouped, run, f"conv_id {kind}, part long, n_messages long, n_linked long, turns array<bigint>, chat string", rows=500)
