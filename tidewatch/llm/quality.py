"""Quality rules: an isolation forest on rule statistics.

Every text gets a row of statistics. Trees of random splits are grown on small samples of
these rows; an unusual row is cut off after few splits, so a short mean path marks an
anomaly. The score above which a document goes is set with the labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import keep

TREES = 100
#: Rows per tree; the forest is grown on at most TREES * SAMPLE rows, chosen by a hash of the id.
SAMPLE = 256
SEED = 17
#: Share of labelled good documents that the threshold may cost at most.
MAX_LOSS = 0.005
BINS = 1000

FEATURES = (
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share",
    "digit_share", "upper_share", "mark_share", "log_line_words",
)
_SPACE = bytes([9, 10, 11, 12, 13, 32])
_SYMBOLS = b"#*$%&|<>"


def _classes() -> np.ndarray:
    """Bits of every byte: 1 starts a code point, 2 white space, 4 symbol, 8 digit, 16 upper case, 32 other mark."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        is_mark = b < 128 and not chr(b).isalnum() and b not in _SPACE
        out[b] = (
            (b & 0xC0 != 0x80) | (b in _SPACE) << 1 | (b in _SYMBOLS) << 2 | (48 <= b < 58) << 3
            | (65 <= b < 91) << 4 | is_mark << 5
        )
    return out


_CLASSES = _classes()


def repeat_words(words: Sequence[bytes]) -> tuple[int, int]:
    """Words inside windows of three words that occur twice or more, and distinct words."""
    n = len(words)
    first: dict[bytes, int] = {}
    code = np.fromiter(map(first.setdefault, words, range(n)), np.int64, n)
    if n < 4 or len(first) == n:
        return 0, len(first)
    if n >= 1 << 21:  # three codes no longer fit 64 bits: number the pairs first
        pair = np.unique(code[:-1] * n + code[1:], return_inverse=True)[1]
        windows = pair[:-1] * n + code[2:]
    else:
        windows = (code[:-2] * n + code[1:-1]) * n + code[2:]
    order = np.sort(windows)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0, len(first)
    hit = np.isin(windows, again)
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= hit
    return int(covered.sum()), len(first)


def statistics(raw: bytes) -> tuple[list[int], list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and the features."""
    words = raw.split()  # bytes split at ASCII white space only
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    n, n_dup = len(words), len(lines) - len(set(lines))
    n_repeat, n_distinct = repeat_words(words)
    kinds = np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=64) if raw else np.zeros(64, np.int64)
    bits = np.arange(64)
    chars, white, symbols, digits, upper, marks = (int(kinds[bits >> i & 1 == 1].sum()) for i in range(6))
    word_chars = chars - white
    some, per_char = max(n, 1), max(word_chars, 1)
    features = [
        float(np.log1p(n)), word_chars / some, symbols / per_char, n_dup / max(len(lines), 1), n_repeat / some,
        n_distinct / some, digits / per_char, upper / per_char, marks / per_char,
        float(np.log1p(n / max(len(lines), 1))),
    ]
    return [n, word_chars, symbols, n_dup, n_repeat], features


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts and the features of every text, one pass without a shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), *((f, pa.float64()) for f in FEATURES)])

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            rows = [statistics((t.as_py() or "").encode()) for t in texts]
            columns = [batch.column(0).cast(pa.int64())]
            columns += [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(len(_COUNTS))]
            columns += [pa.array([r[1][i] for r in rows], pa.float64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = ", ".join(["doc_id long", *(f"{c} long" for c in _COUNTS), *(f"{f} double" for f in FEATURES)])
    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def mean_path(n: float) -> float:
    """Mean path of a failed search in a random binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), cut, left child (right is the next), path."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    path: np.ndarray
    size: int

    @staticmethod
    def grow(rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
        rng = np.random.default_rng(seed)
        size = min(sample, len(rows))
        depth = int(np.ceil(np.log2(max(size, 2))))
        grown = []
        for _ in range(trees):
            nodes: list[list] = [[-1, 0.0, 0, 0.0]]
            todo = [(0, rows[rng.choice(len(rows), size, replace=False)], 0)] if size else []
            while todo:
                at, here, level = todo.pop()
                low, high = here.min(0), here.max(0)
                usable = np.flatnonzero(high > low)
                if level >= depth or len(here) <= 1 or not len(usable):
                    nodes[at][3] = level + mean_path(len(here))
                    continue
                f = int(rng.choice(usable))
                cut = rng.uniform(low[f], high[f])
                child = len(nodes)
                nodes[at][:3] = [f, cut, child]
                nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
                goes = here[:, f] < cut
                todo += [(child, here[goes], level + 1), (child + 1, here[~goes], level + 1)]
            grown.append(nodes)
        most = max(map(len, grown))
        table = np.array([g + [[-1, 0.0, 0, 0.0]] * (most - len(g)) for g in grown])
        return Forest(table[..., 0].astype(int), table[..., 1], table[..., 2].astype(int), table[..., 3], size)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): towards 1 for anomalies, below 0.5 for ordinary rows."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, cut, left, path in zip(self.feature, self.cut, self.left, self.path, strict=True):
            at = np.zeros(len(rows), int)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                step = left[at] + (rows[every, np.maximum(f, 0)] >= cut[at])
                at = np.where(inner, step, at)
            total += path[at]
        return 2.0 ** (-total / len(self.feature) / max(mean_path(self.size), 1e-9))


def calibrate(bins: Sequence[tuple[int, int, int]], max_loss: float = MAX_LOSS) -> float:
    """The score above which documents go, from (bin, quality, count) of labelled rows.

    Of the thresholds that cost at most `max_loss` of the good ones, the one with the
    largest gap between bad and good rows caught, the highest of equals. Without labelled
    good and bad rows nothing goes: 1.
    """
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for b, quality, n in bins:
        (good if quality else bad)[b] += n
    if not good.sum() or not bad.sum():
        return 1.0
    above = lambda x: x[::-1].cumsum()[::-1]
    lost, caught = above(good) / good.sum(), above(bad) / bad.sum()
    gain = np.where(lost <= max_loss, caught - lost, -1.0)
    best = BINS - int(np.argmax(gain[::-1]))
    return best / BINS if gain[best] > 0 else 1.0


def judge(docs: DataFrame, labels: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """One row per row of `docs`: doc_id, the five counts, base_failed, score, kept.

    A null or empty text has no words and fails the base rules (under 50 words). Labels
    with a null quality are not used; labels may lack any document or repeat one. Rows that
    repeat a doc_id are judged each; other columns are ignored; an empty table gives an
    empty one. Counts, scores and the threshold come from all rows; only the forest is
    grown on a sample, of at most trees * sample rows, whose numbers go through the driver.
    """
    measured = keep(measure(docs), "quality-statistics")
    order = F.xxhash64("doc_id", *FEATURES)
    picked = measured.orderBy(order, "doc_id").limit(trees * sample).select(*FEATURES).toArrow()
    rows = np.column_stack([picked.column(f).to_numpy() for f in FEATURES]) if len(picked) else np.zeros((0, len(FEATURES)))
    forest = Forest.grow(rows, trees, sample)

    def run(batches):
        for batch in batches:
            columns = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", *_COUNTS)), pa.array(forest.score(columns))],
                names=["doc_id", *_COUNTS, "score"],
            )

    ddl = ", ".join(["doc_id long", *(f"{c} long" for c in _COUNTS), "score double"])
    scored = keep(measured.mapInArrow(run, ddl), "quality-scores")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("_quality"))
    bins = (
        scored.where(~failed)
        .join(known, "doc_id")
        .groupBy(F.floor(F.col("score") * BINS).cast("int").alias("bin"), "_quality")
        .count()
    )
    threshold = calibrate([tuple(r) for r in bins.collect()])
    return scored.select(
        "doc_id", *_COUNTS, failed.alias("base_failed"), "score",
        (~failed & (F.floor(F.col("score") * BINS) < threshold * BINS)).alias("kept"),
    )
