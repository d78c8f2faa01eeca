"""Quality rules on repetition, by suffix arrays over words.

The suffixes of all texts of a slice are sorted at once by prefix doubling; a text's suffixes never meet another's,
as the first rank holds the text. Longest common prefixes of neighbours come from the ranks of each doubling. Their
intervals are the repeated substrings; the longest at each place cover the text, and what they cover, and
the longest of them, are limited.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows

SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
#: A repeat counts for the verdict from so many words on; these may cover so many hundredths of a text, and none may have more words than LONGEST.
REPEAT_WORDS, COVERED_PERCENT, LONGEST = 8, 30, 60
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def suffixes(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of words, text by text, and the common prefix of each suffix with the one before it, from 2 words on (0 below).

    owner: the text of each word, ascending. Ranks are group starts in the sorted order, so that only
    suffixes which still share a rank are sorted again.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = owner * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    rank, ranks, width = _ranked(key[order], order, np.zeros(n, np.int64), n), [], 1
    active = _shared(rank, order)
    while True:
        ranks.append(np.append(rank, -1).astype(np.int32 if n < 1 << 31 else np.int64))
        if not len(active):
            break
        behind = active + width
        inside = behind < n
        inside[inside] = owner[behind[inside]] == owner[active[inside]]
        second = np.zeros(len(active), np.int64)
        second[inside] = rank[behind[inside]] + 1
        pair = rank[active] * (n + 1) + second
        order = np.argsort(pair, kind="stable")
        rank = _ranked(pair[order], active[order], rank, n)
        active = _shared(rank, active[order])
        width *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    if len(ranks) > 1:
        at = np.flatnonzero(ranks[1][sa[1:]] == ranks[1][sa[:-1]]) + 1
        a, b, same = sa[at - 1], sa[at], np.zeros(len(at), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            same[ranks[level][np.minimum(a + same, n)] == ranks[level][np.minimum(b + same, n)]] += 1 << level
        lcp[at] = same
    return sa, lcp


def _ranked(key: np.ndarray, places: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """rank with the suffixes at places, sorted by key, told apart where their keys differ.

    The suffixes of a former group lie together in key's order, and begin where the group began.
    """
    out = rank.copy()
    begin = np.append(True, key[1:] != key[:-1])
    former = rank[places]
    group = np.append(True, former[1:] != former[:-1])
    at = np.arange(len(places))
    start = np.maximum.accumulate(np.where(group, at, 0))
    mine = np.maximum.accumulate(np.where(begin, at, 0))
    out[places] = former + mine - start
    return out


def _shared(rank: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Those of places, which lie in order of rank, whose rank another one has."""
    own = rank[places]
    same = own[1:] == own[:-1]
    return places[np.append(False, same) | np.append(same, False)]


def intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, last, length) of all intervals of the common prefixes of `least` words or more: suffixes first to last share so many words."""
    found, stack = [], []
    above = np.flatnonzero(lcp >= least)
    last = -2
    for p, value in zip(above.tolist(), lcp[above].tolist(), strict=True):
        if p != last + 1:
            while stack:
                begin, length = stack.pop()
                found.append((begin, last, length))
        begin = p - 1
        while stack and stack[-1][1] >= value:
            begin, length = stack.pop()
            if length > value:
                found.append((begin, p - 1, length))
        stack.append((begin, value))
        last = p
    while stack:
        begin, length = stack.pop()
        found.append((begin, last, length))
    return found


def maximal(found: list[tuple[int, int, int]], sa: np.ndarray, words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which intervals are of substrings that no word before them extends everywhere."""
    if not found:
        return np.zeros(0, bool)
    before = np.where((sa > 0) & (owner[sa] == owner[sa - 1]), words[sa - 1], -1 - sa)
    changes = np.cumsum(np.append(0, before[1:] != before[:-1]))
    spans = np.array(found)
    return changes[spans[:, 1]] > changes[spans[:, 0]]


def covered(reach: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of `least` words or more, where reach has the longest repeat that begins at each word.

    That is the union of the maximal repeats' spans: a longest repeat at its place that isn't maximal lies in a longer one that begins before it.
    """
    at = np.flatnonzero(reach >= least)
    edge = np.zeros(len(reach) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + reach[at], -1)
    return np.cumsum(edge)[:-1] > 0


def repeated(texts: list[str | None], least: int) -> dict[str, list]:
    """For each text: n_words, n_repeat_words, and of repeats of `least` words or more n_repeats, longest_repeat, n_covered and spans [begin, end)."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    split = [(t or "").encode("utf-8").split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    words = np.fromiter((number[w] for own in split for w in own), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    sa, lcp = suffixes(words, owner)
    reach = np.zeros(len(words), np.int64)
    if len(words):
        reach[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    per_text = lambda mask: np.bincount(owner[mask], minlength=len(texts))
    found = intervals(lcp, least)
    begins = np.array([f[0] for f in found], np.int64)[maximal(found, sa, words, owner)] if found else np.zeros(0, np.int64)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, owner, np.where(reach >= least, reach, 0))
    cover = covered(reach, least)
    # runs of covered words, broken at the ends of texts
    opens = np.flatnonzero(cover & np.append(True, ~cover[:-1] | (owner[1:] != owner[:-1]))[: len(cover)])
    closes = np.flatnonzero(cover & np.append(~cover[1:] | (owner[1:] != owner[:-1]), True)[: len(cover)]) + 1
    spans: list[list] = [[] for _ in texts]
    first = np.cumsum(sizes) - sizes
    for a, b in zip(opens.tolist(), closes.tolist(), strict=True):
        i = int(owner[a])
        spans[i].append({"begin": a - int(first[i]), "end": b - int(first[i])})
    return {
        "n_words": sizes.tolist(), "n_repeat_words": per_text(covered(reach, 3)).tolist(), "n_repeats": np.bincount(owner[sa[begins]], minlength=len(texts)).tolist(),
        "longest_repeat": longest.tolist(), "n_covered": per_text(cover).tolist(), "spans": spans,
    }


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier one."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def repetition(docs: DataFrame, text: str = "text", repeat_words: int = REPEAT_WORDS, covered_percent: int = COVERED_PERCENT, longest: int = LONGEST) -> DataFrame:
    """Every column of docs but text, then word counts, what repeats, base_failed and kept.

    A row's words are its text's runs of other than ASCII white space; null is an empty text. n_repeats, longest_repeat, n_covered
    and spans (of words) are of maximal substrings of repeat_words words or more that the text has twice or more. kept is false where
    base_failed is, or where they cover more than covered_percent hundredths of the words, or one has more than `longest` words.
    Repeated rows stay repeated; columns with a result's name are replaced. A text is held whole, with some hundred
    bytes a word, and never compared with another one.
    """
    results = [*COUNTS, "n_repeats", "longest_repeat", "n_covered", "spans", "base_failed", "kept"]
    others = [c for c in docs.columns if c != text and c not in results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            made = repeated(texts, repeat_words)
            made["word_chars"] = [len(t) - sum(map(t.count, SPACES)) for t in texts]
            made["n_symbols"] = [sum(map(t.count, SYMBOLS)) for t in texts]
            made["n_dup_lines"] = [repeated_lines(t) for t in texts]
            made["base_failed"] = [n < 50 or 100 * r > 50 * n for n, r in zip(made["n_words"], made["n_repeat_words"], strict=True)]
            limits = zip(made["base_failed"], made["n_covered"], made["n_words"], made["longest_repeat"], strict=True)
            made["kept"] = [not bad and 100 * c <= covered_percent * n and most <= longest for bad, c, n, most in limits]
            kinds = {"spans": pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), "base_failed": pa.bool_(), "kept": pa.bool_()}
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(made[c], kinds.get(c, pa.int64())) for c in results)], [*others, *results])

    kinds = {"spans": "array<struct<begin: bigint, end: bigint>>", "base_failed": "boolean", "kept": "boolean"}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema), *(f"{c} {kinds.get(c, 'bigint')}" for c in results)])
    return map_rows(docs.select(*others, text), run, schema, rows=1000)
