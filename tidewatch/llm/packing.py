"""Packing documents into fixed windows by minimum bin slack.

Documents are tokenized; whole windows are cut off as they are, and the remaining lengths
are packed: each window takes the longest remainder and then the multiset of others that
comes closest to the capacity, found by dynamic programming over the counts of equal
lengths with the reachable sums as bits of one integer, and read back from its history.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import lean

WINDOW = 2048
END_ID = 1
#: Remainders held by a task at a time; beyond it windows are closed until half are left.
POOL = 8192


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_names() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: tiktoken's splitting of a text gives up on white space of about 900,000 characters in a
#: row; texts with a run of so many go to `tokenizers`.
LONG_BLANK = 50_000
_BLANK = re.compile(r"\s{%d}" % LONG_BLANK)


@lru_cache(maxsize=1)
def encoder(path: str, plain: bool = False):
    """text -> little-endian 32-bit ids as bytes, for texts of any length.

    The vocabulary file is the one of the `tokenizers` library. Its merges are in the order
    of their ids, so tiktoken gives the same ids from the same file, five times as fast; a
    test holds both against each other. A special token's string in a text becomes its id,
    or with `plain` is a text like any other.
    """
    import numpy as np
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    special = {x["content"]: x["id"] for x in raw["added_tokens"]}
    names = _byte_names()
    ranks = {bytes(names[c] for c in tok): i for tok, i in raw["model"]["vocab"].items() if tok not in special}
    coder = tiktoken.Encoding(
        path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
    )
    slow: list[Tokenizer] = []

    def encode(text: str) -> bytes:
        if len(text) < LONG_BLANK or not _BLANK.search(text):
            ids = coder.encode_to_numpy(text, allowed_special=set() if plain else "all", disallowed_special=())
            return ids.astype("<u4").tobytes()
        if not slow:
            slow.append(Tokenizer.from_file(path))
            slow[0].encode_special_tokens = plain
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    return encode


def fill(counts: dict[int, int], capacity: int) -> list[int]:
    """The lengths, at most counts[length] of each, whose sum comes closest to capacity
    without exceeding it."""
    mask, reach, history = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((n for n in counts if n <= capacity), reverse=True):
        copies = min(counts[length], capacity // length)
        history.append((length, copies, reach))
        for _ in range(copies):
            wider = reach | (reach << length) & mask
            if wider == reach:
                break
            reach = wider
        if reach >> capacity:
            break
    left, chosen = reach.bit_length() - 1, []
    for length, copies, before in reversed(history):
        for n in range(copies + 1):
            if n * length <= left and before >> (left - n * length) & 1:
                chosen += [length] * n
                left -= n * length
                break
    return chosen


class _Pool:
    """Remainders by length."""

    def __init__(self, window: int):
        self.window, self.by_length, self.counts, self.size = window, {}, {}, 0

    def add(self, piece: tuple, length: int) -> None:
        self.by_length.setdefault(length, []).append(piece)
        self.counts[length] = self.counts.get(length, 0) + 1
        self.size += 1

    def _take(self, length: int) -> tuple:
        self.size -= 1
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length]
        return self.by_length[length].pop()

    def windows(self, down_to: int) -> Iterator[list[tuple]]:
        while self.size > down_to:
            longest = max(self.counts)
            chosen = [self._take(longest)]
            for length in fill(self.counts, self.window - longest):
                chosen.append(self._take(length))
            yield chosen


def pack_rows(rows: Iterable[tuple], encode, window: int = WINDOW, pool: int = POOL) -> Iterator[tuple]:
    """(doc_id, start, ids, doc_tokens, number of the window, offset) for rows (doc_id, text)."""
    held, number = _Pool(window), 0
    end = END_ID.to_bytes(4, "little")

    def placed(pieces):
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, number, at
            at += len(ids) // 4

    for doc, text in rows:
        ids = encode(text or "") + end
        total = len(ids) // 4
        for start in range(0, total, window):
            part = ids[4 * start : 4 * (start + window)]
            if len(part) == 4 * window:
                yield from placed([(doc, start, part, total)])
                number += 1
            else:
                held.add((doc, start, part, total), len(part) // 4)
        if held.size > pool:
            for pieces in held.windows(pool // 2):
                yield from placed(pieces)
                number += 1
    for pieces in held.windows(0):
        yield from placed(pieces)
        number += 1


PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ]
)


def pack_pieces(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, pool: int = POOL) -> DataFrame:
    """One row per piece: doc_id, start, ids (little-endian 32-bit), doc_tokens,
    sequence_id, offset.

    A null text is empty and gives the end id alone; a text of any length is cut into as
    many pieces as it needs. Rows that repeat a doc_id are packed
    each. Columns other than doc_id and text are ignored; an empty table gives no piece.
    Every partition packs its own documents, without a shuffle, in memory bounded by `pool`
    remainders; a sequence's number is its partition's followed by its own, so it follows
    from the partition alone and a task that runs again gives the same rows.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        encode, part = encoder(path), TaskContext.get().partitionId() << 33

        def rows():
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for i, doc in enumerate(ids):
                    yield doc, texts[i].as_py()

        out = []
        for doc, start, ids, total, number, at in pack_rows(rows(), encode, window, pool):
            out.append((doc, start, ids, total, part + number, at))
            if len(out) == 2048:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), PIECES.types, strict=True)], schema=PIECES)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), PIECES.types, strict=True)], schema=PIECES)
        encoder.cache_clear()  # some 25 MB, which other work of this worker has no use for

    return docs.select("doc_id", "text").mapInArrow(
        lean(run), "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def pack(docs: DataFrame) -> DataFrame:
    """The pieces without their ids, which a CRC-32 stands for."""
    return pack_pieces(docs).select(
        "doc_id", "start", F.expr("octet_length(ids) div 4").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )
