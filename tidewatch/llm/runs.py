"""Periodic runs of words, found as maximal pairs.

Two places of a text that start the same words, and can't be made longer on either side,
are a maximal pair. A pair whose distance is at most a third of its common words is a run
already: the distance is a period, and as the pair can't be extended neither can the run,
so nothing is extended afterwards.

The suffixes of all texts in a batch are ordered by doubling, as whole arrays; places that
share fewer words with both neighbours than the shortest run needs drop out. Over the rest
the tree of LCP intervals is walked bottom-up. Each node keeps its places in the order of
the text, each with its left word, which is its class; where a node takes in a child, the
places of the smaller list look for partners of another class within the distance. All
places of a node within two thirds of its common words lie one period apart, so all but the
first of them have the same left word: one look to each side finds every partner, and no
class is gone through pair by pair.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, lean

MIN_WORDS = 6
MIN_EXPONENT = 4
#: The least words that the two places of a run share: 5 for period 1, three periods else.
MIN_SHARED = 5
#: Words whose suffixes are ordered together; a longer text is ordered by itself.
BATCH_WORDS = 200_000

_WORDS = re.compile(WORD)


def _ranks(ids: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """For 1, 2, 4, ... words the rank of each place by the words that follow it in its text;
    equal ranks are equal words. Places alone in their rank are not looked at again."""
    n = len(ids)

    def ahead(rank: np.ndarray, places: np.ndarray, h: int) -> np.ndarray:
        to = np.minimum(places + h, n - 1)
        return np.where((places + h < n) & (doc[to] == doc[places]), rank[to] + 1, 0)

    def counted(key: np.ndarray) -> np.ndarray:
        _, inverse, sizes = np.unique(key, return_inverse=True, return_counts=True)
        return (np.cumsum(sizes) - sizes)[inverse]

    every = np.arange(n)
    levels = [counted(doc * (int(ids.max()) + 1) + ids)]
    h = 1
    while h < 4:
        levels.append(counted(levels[-1] * (n + 1) + ahead(levels[-1], every, h)))
        h *= 2
    rank = levels[-1]
    open_ = every[np.bincount(rank, minlength=n)[rank] > 1]
    while len(open_):
        order = np.lexsort((ahead(rank, open_, h), rank[open_]))
        open_ = open_[order]
        old, behind = rank[open_], ahead(rank, open_, h)
        at = np.arange(len(open_))
        group = np.concatenate([[True], old[1:] != old[:-1]])
        part = group | np.concatenate([[True], behind[1:] != behind[:-1]])
        first = lambda new: np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[open_] = old + first(part) - first(group)
        levels.append(rank)
        open_ = open_[np.bincount(rank[open_], minlength=n)[rank[open_]] > 1]
        h *= 2
    return levels


def _neighbours(levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that share at least `least` words with another, in order, and how many each
    shares with the one before."""
    rank = levels[-1]
    some = np.flatnonzero(np.bincount(levels[2], minlength=len(rank))[levels[2]] > 1)
    places = some[np.argsort(rank[some])]
    padded = [np.append(x, -1) for x in levels]
    end, shared = len(rank), np.zeros(len(places), np.int64)
    a, b, common = places[:-1], places[1:], np.zeros(max(len(places) - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = np.minimum(a + common, end), np.minimum(b + common, end)
        same = (padded[k][i] == padded[k][j]) & (i < end) & (j < end)
        common += same.astype(np.int64) << k
    shared[1:] = common
    near = (shared >= least) | np.append(shared[1:] >= least, False)[: len(shared)]
    return places[near], shared[near]


def _joined(a: list[int], b: list[int], shared: int, left: list[int], found: list[tuple[int, int, int]]) -> list[int]:
    """Both lists as one, after adding the maximal pairs between them to `found`."""
    if len(a) < len(b):
        a, b = b, a
    reach, n = shared // (MIN_EXPONENT - 1), len(a)
    for i in b:
        at = bisect_left(a, i - reach)
        if at == n:
            continue
        other = a[at]
        if other < i:
            if left[other] != left[i]:
                found.append((other, i - other, shared))
        elif other <= i + reach and left[other] != left[i]:
            while at < n and a[at] <= i + reach:
                found.append((i, a[at] - i, shared))
                at += 1
    if len(b) * 16 < n:
        for i in b:
            insort(a, i)
    else:
        a += b
        a.sort()
    return a


def maximal_pairs(places: np.ndarray, shared: np.ndarray, left: list[int]) -> list[tuple[int, int, int]]:
    """(place, distance, common words) of the maximal pairs near enough to be runs."""
    found: list[tuple[int, int, int]] = []
    stack: list[list] = []  # open intervals: common words, their places so far
    after = [*shared[1:].tolist(), 0]
    for place, common in zip(places.tolist(), after, strict=True):
        now = [place]
        while stack and stack[-1][0] > common:
            words, others = stack.pop()
            now = _joined(others, now, words, left, found)
        if common < MIN_SHARED:
            continue
        if stack and stack[-1][0] == common:
            stack[-1][1] = _joined(stack[-1][1], now, common, left, found)
        else:
            stack.append([common, now])
    return found


def runs_of(texts: Sequence[Sequence[int]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text of word numbers, by start and period.

    A run is a stretch with smallest period q, of at least max(6, 4 q) words, that no
    neighbouring word extends. A pair at a multiple of q covers the same words as the one
    at q, so the smallest distance of each stretch is its period.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return out
    ids = np.concatenate([np.asarray(t, np.int64) for t in texts])
    doc = np.repeat(np.arange(len(texts)), sizes)
    starts = np.cumsum(sizes) - sizes
    places, shared = _neighbours(_ranks(ids, doc), MIN_SHARED)
    if not len(places):
        return out
    left = np.concatenate([[-1], ids[:-1]])
    left[starts[sizes > 0]] = -1
    best: dict[tuple[int, int], int] = {}
    for place, distance, common in maximal_pairs(places, shared, left.tolist()):
        key = (place, common + distance)
        if common + distance >= MIN_WORDS and distance < best.get(key, common):
            best[key] = distance
    for (place, length), period in best.items():
        text = int(doc[place])
        out[text].append((place - int(starts[text]), length, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def left_over(n: int, runs: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: all but those of a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def _batches(batches) -> Iterator[pa.RecordBatch]:
    numbers: dict[str, int] = {}
    waiting: list[tuple[int, list[str], np.ndarray]] = []
    size = 0

    def done() -> pa.RecordBatch:
        found = runs_of([w[2] for w in waiting])
        kept = []
        for (_, words, _), runs in zip(waiting, found, strict=True):
            stay = left_over(len(words), runs) if runs else None
            kept.append(" ".join(words if stay is None else [words[i] for i in np.flatnonzero(stay)]))
        rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([w[0] for w in waiting], pa.int64()), pa.array([len(w[1]) for w in waiting], pa.int64()),
                pa.array(rows, _FOUND.field("runs").type), pa.array(kept, pa.string()),
            ],
            schema=_FOUND,
        )

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = _WORDS.findall(text.as_py() or "")
            # a number stands for a word within a batch only, so the table may be dropped between batches
            waiting.append((doc, words, np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)))
            size += len(words)
            if size >= BATCH_WORDS or len(waiting) >= 4096:
                yield done()
                waiting, size, numbers = [], 0, {}
    if waiting:
        yield done()


def find_runs(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, runs (start, length, period in words, by
    start and period) and collapsed, its words without those that repeat a run's first
    period, joined by single spaces.

    A null text is an empty one and has neither words nor runs. Rows that repeat a doc_id
    are looked at each; a text of any length is ordered whole. Columns other than doc_id and
    text are ignored; an empty table gives an empty one. Texts don't meet, so there is no
    shuffle, and a task holds the words of one batch.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lean(_batches),
        "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string",
    )


def digest(found: DataFrame) -> DataFrame:
    """The number of runs, the one of greatest exponent (the first, then of the smallest
    period) and digests of all runs and of the collapsed text."""
    # lengths and periods below 2 ** 26 give different quotients for different exponents
    best = F.array_min(
        F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("e"), r["start"], r["period"], r["length"]))
    )
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    found = found.withColumn("_best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        sha(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text, made periodic in a tenth of the documents as a hash of the id says."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, g = F.size(words), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    whole = lambda c: c.cast("int")
    periods = F.flatten(F.array_repeat(F.slice(words, whole(a + 1), whole(p)), whole(F.ceil((n - a) / p))))
    repeated = F.concat(F.slice(words, F.lit(1), whole(a)), F.slice(periods, F.lit(1), whole(n - a)))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(repeated, " ")).otherwise(text)
