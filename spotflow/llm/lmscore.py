"""Language-model scores: the marginal probability of a text over all its segmentations into pieces.

An existing unigram vocabulary weights the pieces. A word's segmentations form a lattice; a forward recursion
in log space sums over all of them, whole batches of words at a time. The weights are the vocabulary's scores; beside
them, they can be fitted to the distinct training words by expectation and maximisation over their lattices. A
training word has one more edge, from end to end, whose weight is its count. Every distinct word of the
corpus is scored once and joined back to the texts: the commonest words, a bounded number, by broadcast, all
others by a shuffle on the word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, forget, map_rows, numbered, once, send, slices, stored

FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LN10 = math.log(10.0)
#: Words that are joined by broadcast: at most so many, longer ones than HOT_BYTES never.
HOT_WORDS, HOT_BYTES = 1 << 17, 64
#: Distinct words, and bytes of texts, that a task counts before it hands them on.
COUNTED, COUNTED_BYTES = 1 << 18, 48 << 20
#: Words and bytes of words whose lattices are worked on at a time.
LATTICE_ROWS, LATTICE_BYTES = 20_000, 1 << 18
#: Rounds of expectation and maximisation for the fitted weights.
ROUNDS = 1
#: Bins to an octave of counts, for finding the commonest words.
BINS = 16
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Scores of a token: learned, by the vocabulary alone, learned with fitted weights.
SCORES = ["score", "lattice", "fitted"]


def load_pieces(path: str, shift: float = 2.7) -> dict:
    """Log probabilities of the pieces of a sentencepiece model, of a single byte and of the end.

    Scores of a unigram model are log probabilities already. Other models score by rank; rank r of n
    is given probability proportional to 1 / (r + shift), which is what frequencies by rank look like,
    and pieces without rank (single bytes, the end) that of the last rank. They are where fitting starts.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    scores = [model.get_score(i) for i in range(size)]
    plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    ranked = all(float(scores[i]).is_integer() for i in plain)
    if ranked:
        order = sorted(plain, key=lambda i: (-scores[i], i))
        weight = {i: 1.0 / (r + 1 + shift) for r, i in enumerate(order)}
        least = min(weight.values())
        total = sum(weight.values()) + least * 257
        logs = {i: math.log(w / total) for i, w in weight.items()}
        rare = math.log(least / total)
    else:
        logs = {i: float(scores[i]) for i in plain}
        rare = min(logs.values()) - 10.0
    pieces = {model.id_to_piece(i): p for i, p in logs.items()}
    return {"pieces": pieces, "byte": rare, "end": rare, "longest": max(map(len, pieces)), "space": "▁"}


class Lattices:
    """The lattices of batches of words, each with the blank before it, as flat arrays of edges.

    Edges are all pieces that occur, and the bytes of a character that is no piece. Pieces are found by 64-bit
    hashes of their characters, which are checked to differ for different pieces.
    """

    def __init__(self, pieces: dict):
        self.space, self.longest = pieces["space"], pieces["longest"]
        names = list(pieces["pieces"])
        hashes = np.array([self._hash(np.frombuffer(p.encode("utf-32-le"), np.uint32)) for p in names], np.uint64)
        order = np.argsort(hashes)
        self.names = [names[i] for i in order]
        self.hashes = hashes[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("pieces share a hash")
        self.byte = len(names)  # the edge number of a byte; the end's is the next one
        self.logs = np.array([*(pieces["pieces"][p] for p in self.names), pieces["byte"], pieces["end"]])

    @staticmethod
    def _value(chars: np.ndarray) -> np.ndarray:
        x = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))

    @classmethod
    def _hash(cls, chars: np.ndarray) -> int:
        h = np.zeros(1, np.uint64)
        for v in cls._value(chars):
            h = h * HASH_BASE + v
        return int(h[0])

    def edges(self, words: list[str]) -> dict:
        """node: the first node of each word; size: its characters; edges by their end: from, to, which, times, word, step."""
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        chars = np.frombuffer((self.space + self.space.join(words)).encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(words)), size)
        begin = np.cumsum(size) - size
        place = np.arange(len(chars)) - begin[word]
        left = size[word] - place
        value = self._value(chars)
        at, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        starts, lengths, which = [], [], []
        single = np.zeros(len(chars), bool)
        for length in range(1, self.longest + 1):
            keep = left[at] >= length
            at, h = at[keep], h[keep] * HASH_BASE + value[at[keep] + length - 1]
            if not len(at):
                break
            found = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[found] == h)
            starts.append(at[hit])
            lengths.append(np.full(len(hit), length))
            which.append(found[hit])
            if length == 1:
                single[at[hit]] = True
        spelled = np.flatnonzero(~single)
        starts.append(spelled)
        lengths.append(np.ones(len(spelled), np.int64))
        which.append(np.full(len(spelled), self.byte))
        begins, lengths, which = (np.concatenate(x) for x in (starts, lengths, which))
        times = np.ones(len(begins))
        c = chars[spelled]
        times[len(times) - len(spelled) :] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        owner = word[begins]
        start = begins + owner  # a word of n characters has n + 1 nodes
        end = start + lengths
        step = place[begins] + lengths
        order = np.lexsort((end, step))
        return {"node": begin + np.arange(len(words)), "size": size, "from": start[order], "to": end[order], "which": which[order], "times": times[order], "word": owner[order], "step": step[order]}

    @staticmethod
    def _sweep(total: int, first: np.ndarray, source: np.ndarray, target: np.ndarray, cost: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Log of the summed weights of all ways to each node; edges sorted by step and target."""
        out = np.full(total, -np.inf)
        out[first] = 0.0
        if not len(step):
            return out
        new = np.flatnonzero(np.append(True, (target[1:] != target[:-1]) | (step[1:] != step[:-1])))
        turns = np.flatnonzero(np.append(True, step[1:] != step[:-1]))
        of = np.searchsorted(new, turns)
        for a, b, x, y in zip(turns, [*turns[1:], len(step)], of, [*of[1:], len(new)], strict=True):
            out[target[new[x:y]]] = np.logaddexp.reduceat(out[source[a:b]] + cost[a:b], new[x:y] - a)
        return out

    def marginals(self, words: list[str], *logs: np.ndarray) -> list[np.ndarray]:
        """Natural log of the summed probability of all segmentations of each word, for each of the weights."""
        if not words:
            return [np.zeros(0) for _ in logs]
        e = self.edges(words)
        return [self._forward(e, w)[e["node"] + e["size"]] for w in logs]

    def _forward(self, e: dict, logs: np.ndarray) -> np.ndarray:
        total = int(e["node"][-1] + e["size"][-1]) + 1
        return self._sweep(total, e["node"], e["from"], e["to"], logs[e["which"]] * e["times"], e["step"])

    def expected(self, words: list[str], logs: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words' segmentations, and single bytes; 0 for the end."""
        out = np.zeros(len(logs))
        if not words:
            return out
        e = self.edges(words)
        forward = self._forward(e, logs)
        last = e["node"] + e["size"]
        cost = logs[e["which"]] * e["times"]
        # backward: from each word's last node; an edge's turn comes by the distance of its start from there
        turn = last[e["word"]] - e["from"]
        order = np.lexsort((e["from"], turn))
        backward = self._sweep(len(forward), last, e["to"][order], e["from"][order], cost[order], turn[order])
        share = np.exp(forward[e["from"]] + cost + backward[e["to"]] - forward[last][e["word"]])
        return out + np.bincount(e["which"], weights=share * e["times"], minlength=len(out))


def word_log10(pieces: dict, word: str) -> float:
    """log10 of the summed probability of all segmentations of a word with the blank before it."""
    lattices = Lattices(pieces)
    return float(lattices.marginals([word], lattices.logs)[0][0]) / LN10


def folded_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(FOLD).split() if text else []


def held_out(key: Column) -> Column:
    """crc32 of the id as text leaves 0 modulo 10; a null id is held out."""
    return F.coalesce(crc_mod(key, 10) == 0, F.lit(True))


def word_table(docs: DataFrame) -> DataFrame:
    """word, n (in training texts) of docs(text, held_out); words that only held-out texts have come with n = 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        size = 0

        def leave() -> Iterator[pa.RecordBatch]:
            while counts:
                part = [counts.popitem() for _ in range(min(len(counts), 50_000))]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8") for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["word", "n"])

        for batch in batches:
            for x, out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = folded_words(x)
                size += len(x or "")
                if out:
                    for w in own:
                        counts[w] += 0
                else:
                    counts.update(own)
            if len(counts) > COUNTED or size > COUNTED_BYTES:
                yield from leave()
                size = 0
        yield from leave()

    return map_rows(docs.select("text", "held_out"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lattice_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, LATTICE_ROWS, LATTICE_BYTES)


def fitted(lattices: Lattices, words: DataFrame, texts: int, rounds: int = ROUNDS) -> np.ndarray:
    """Log weights after some rounds of expectation and maximisation over the lattices of words(word).

    Each distinct training word counts once: the pieces speak for words that training hasn't seen, and what
    recurs has an edge of its own. Expected counts are smoothed by as many observations of the weights at
    the start as there are pieces. The driver gets one number a piece.
    """
    logs = lattices.logs
    prior = np.exp(logs) * np.append(np.ones(lattices.byte), [256.0, 1.0])
    prior /= prior.sum()
    for _ in range(rounds):
        sent = send(words.sparkSession, (lattices, logs))  # one vocabulary: of fixed size

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in lattice_slices(batches):
                use, logs = sent.value[1]
                own = use.expected(batch.column(0).to_pylist(), logs)
                total = own if total is None else total + own
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["which", "n"])

        found = words.select("word").mapInArrow(run, "which int, n double").groupBy("which").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(len(logs))
        counts[found.column("which").to_numpy()] = found.column("n").to_numpy()
        counts[-1] = texts
        if not counts.any():
            break
        share = (counts + lattices.byte * prior) / (counts.sum() + lattices.byte)
        logs = np.log(share)
        logs[lattices.byte] -= math.log(256.0)  # any of the bytes
    return logs


def hot_threshold(words: DataFrame, most: int) -> int:
    """The least n for which at most `most` words(word, n) occur n times or more; a word has to occur twice."""
    bins = words.where((F.col("n") > 1) & (F.octet_length("word") <= HOT_BYTES)).groupBy(F.floor(F.log2("n") * BINS).alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    least, total = 1 << 62, 0
    for r in sorted(bins, reverse=True):
        total += r.words
        if total > most:
            break
        least = r.least
    return least


def score_texts(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", hot_words: int = HOT_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score, fitted_score of every text.

    Tokens are the words, A-Z lower-cased, and one end. base_score is the add-0.1 unigram score by the
    counts of the training texts. lattice_score is the log10 of the marginal probability over all segmentations under the
    vocabulary's scores: the sum over the tokens of the marginal s of their lattices of pieces (the end is a piece of its
    own). score is that of the model which has learned the training texts, too: c / (N + V) + V / (N + V) * s for each token, where c is the
    token's training count, N all and V the distinct training tokens; without training tokens it is s.
    fitted_score is the same with weights fitted in `rounds` rounds; with none, it is score. A null or empty text is its end alone. A null
    key is held out. Repeated rows are separate texts, each counted and scored. Other columns are dropped. Rows are numbered once and
    stored.
    """
    spark = docs.sparkSession
    base = numbered(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), held_out(F.col(key)).alias("held_out")), "row")
    lattices = Lattices(load_pieces(path))
    counted = stored(word_table(base), "counted")
    ends = base.where(~F.col("held_out")).count()
    sums = counted.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    total, distinct = (sums.n or 0) + ends, (sums.v or 0) + (ends > 0)
    under = total + 0.1 * (distinct + 1)
    logs = [lattices.logs, fitted(lattices, counted.where("n > 0"), ends, rounds)] if rounds else [lattices.logs]
    new = math.log(distinct / (total + distinct)) if total else 0.0
    own = lambda n: np.log(np.maximum(n, 1e-300) / max(total + distinct, 1))
    log10_of = lambda n, spelled: np.where(n > 0, np.logaddexp(own(n), new + spelled), new + spelled) / LN10
    sent = send(spark, (lattices, logs))

    def values(n: np.ndarray, spelled: list[np.ndarray]) -> list[np.ndarray]:
        """score, lattice_score, fitted_score of tokens."""
        return [log10_of(n, spelled[0]), spelled[0] / LN10, log10_of(n, spelled[-1])]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lattice_slices(batches):
            use, logs = sent.value[1]
            n = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            made = values(n, use.marginals(batch.column(0).to_pylist(), *logs))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], ["word", "n", *SCORES])

    words = stored(counted.select("word", "n").mapInArrow(score, "word string, n long, score double, lattice double, fitted double"), "words")
    forget(counted)
    hot = words.where((F.col("n") >= hot_threshold(words, hot_words)) & (F.octet_length("word") <= HOT_BYTES)).toArrow()  # at most hot_words of HOT_BYTES
    common = send(spark, (hot.column("word").cast(pa.binary()).combine_chunks(), [np.log10((hot.column("n").to_numpy() + 0.1) / under), *(hot.column(c).to_numpy() for c in SCORES)]))
    end = [math.log10((ends + 0.1) / under), *(float(v[0]) for v in values(np.array([float(ends)]), [w[-1:] for w in logs]))]
    end_known = int(ends > 0)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of the sums over common words for each text, with word null, and one for each other word in it."""
        name, (spelt, tables) = common.value
        get = once(name, lambda: {w: i for i, w in enumerate(spelt.to_pylist())}).get
        for batch in batches:
            flat: list[bytes] = []
            sizes = []
            for x in batch.column(1).to_pylist():
                own = folded_words(x)
                flat += own
                sizes.append(len(own))
            n = batch.num_rows
            owner = np.repeat(np.arange(n), sizes)
            at = np.fromiter(map(get, flat, repeat(-1)), np.int64, len(flat))
            known = np.flatnonzero(at >= 0)
            sums = [np.bincount(owner[known], weights=w, minlength=n) for w in (np.ones(len(known)), *(t[at[known]] for t in tables))]
            other = np.flatnonzero(at < 0)
            rare = Counter(zip(owner[other].tolist(), map(flat.__getitem__, other.tolist()), strict=True))
            rows = batch.column(0).to_numpy()
            m = len(rare)
            own_words = pa.array([w.decode("utf-8") for _, w in rare], pa.string())
            blank = np.zeros(m)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([rows, rows[np.fromiter((k for k, _ in rare), np.int64, m)]]), pa.int64()),
                    pa.concat_arrays([pa.nulls(n, pa.string()), own_words]),
                    pa.array(np.concatenate([np.zeros(n, np.int64), np.fromiter(rare.values(), np.int64, m)])),
                    pa.array(np.concatenate([np.array(sizes, np.int64) + 1, blank.astype(np.int64)])),
                    pa.array(np.concatenate([sums[0].astype(np.int64) + end_known, blank.astype(np.int64)])),
                    *(pa.array(np.concatenate([s + e, blank])) for s, e in zip(sums[1:], end, strict=True)),
                ],
                names,
            )

    names = ["row", "word", "times", "n_tokens", "n_known", "base", *SCORES]
    parts = map_rows(base.select("row", "text"), part, "row long, word string, times long, n_tokens long, n_known long, base double, score double, lattice double, fitted double", rows=1000)
    # texts' own rows get a word of their own that no text has, so that they spread over the join
    keyed = parts.withColumn("word", F.coalesce("word", F.concat(F.lit(" "), F.col("row").cast("string"))))
    joined = keyed.join(words.select("word", F.col("n").alias("w_n"), *(F.col(c).alias("w_" + c) for c in SCORES)), "word", "left")
    each = F.col("times").cast("double")
    summed = joined.groupBy("row").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("w_n") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(F.col("w_n").isNull(), 0.0).otherwise(each * F.log10((F.col("w_n") + 0.1) / F.lit(under)))).alias("base_score"),
        *(F.sum(F.col(c) + F.coalesce(each * F.col("w_" + c), F.lit(0.0))).alias(c if c == "score" else c + "_score") for c in SCORES),
    )
    return base.select("row", "key", "held_out").join(summed, "row").select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score", "lattice_score", "fitted_score")
