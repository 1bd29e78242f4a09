"""Alignment of two tokenizers by external spill counting.

A text's tokens under both tokenizers are cut into groups where both end at the same byte;
tokens of a group are linked, and a pair of ids counts the documents that hold it linked.

1. A task writes records (pair, document) and sorts them in memory; full memory is spilled
   as a chunk: its records radix-partitioned by the bits of the A id, each part a run of
   zstd blocks. A run has two columns: the pairs with the number of the chunk's documents
   that hold each, and those documents. Only the first is moved to be counted, so a pair
   that every document holds costs one entry per chunk.
2. A part's runs are merged through a heap, some at a time where there are many, which adds
   up each pair. The order is by A id first, so an A id's pairs follow each other and its
   highest count is known when they end. Each run is then read again, and the count of each
   of its pairs, and whether it is its A id's highest, stream back to the chunk it is from.
3. Counts meet the chunk's documents, part by part, and are added up per document.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import islice
from tempfile import SpooledTemporaryFile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import packing
from tidewatch.llm.common import keep, lean

A_BITS, B_BITS = 16, 15
#: Multiplying by it permutes the A ids, so that frequent ones, which have small numbers,
#: fall into different parts.
SPREAD = 40503
#: Records that a task holds before it spills a chunk.
CHUNK_RECORDS = 1_000_000
#: Bytes of text aligned at a time.
TEXT_BYTES = 1 << 20
#: A group with more links than this counts its distinct ids before it pairs them.
WIDE_GROUP = 4096
#: Entries in a compressed block of a run; runs merged at a time; bytes of runs held in
#: memory by a merging task, beyond which they lie in a file of its own.
BLOCK, FAN_IN, HELD_BYTES = 16_384, 64, 32 << 20


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Coders:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import json

        import sentencepiece

        with open(a_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        names = packing._byte_names()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(names[c] for c in token) if all(c in names for c in token) else token.encode()
        encode = packing.encoder(a_path, plain=True)
        self.a = lambda text: np.frombuffer(encode(text), "<u4").astype(np.int64)
        pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b = lambda texts: pieces.encode(texts, num_threads=1)
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in ((i, pieces.id_to_piece(i)) for i in range(pieces.get_piece_size()))
        ]
        if len(self.a_bytes) > 1 << A_BITS or len(self.b_bytes) > 1 << B_BITS:
            raise ValueError(f"ids of A must be below {1 << A_BITS}, of B below {1 << B_BITS}")
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.written = np.array([[f"{i}{mark}" for i in range(most)] for mark in (",", "|", ";", "")], object)


@lru_cache(maxsize=1)
def coders(a_path: str, b_path: str) -> Coders:
    return Coders(a_path, b_path)


def _links(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, pair, links) of the distinct pairs of each document; doc is each group's."""
    in_a, in_b = np.bincount(group_a, minlength=len(doc)), np.bincount(group_b, minlength=len(doc))
    first_b = np.cumsum(in_b) - in_b
    wide = in_a * in_b > WIDE_GROUP
    reach = np.where(wide, 0, in_b)[group_a]
    own = np.repeat(np.arange(len(a)), reach)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(reach) - reach, reach)
    spread = (a * SPREAD) & ((1 << A_BITS) - 1)
    keys = [doc[group_a[own]] << (A_BITS + B_BITS) | spread[own] << B_BITS | b[first_b[group_a[own]] + nth]]
    times = [np.ones(len(own), np.int64)]
    for g in np.flatnonzero(wide):
        ids_a, n_a = np.unique(spread[group_a == g], return_counts=True)
        ids_b, n_b = np.unique(b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
        keys.append((doc[g] << (A_BITS + B_BITS) | ids_a[:, None] << B_BITS | ids_b[None, :]).ravel())
        times.append((n_a[:, None] * n_b[None, :]).ravel())
    key, n = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    key, n = key[new], np.add.reduceat(n, new) if len(new) else n
    return key >> (A_BITS + B_BITS), key & ((1 << (A_BITS + B_BITS)) - 1), n


def align_texts(texts: Sequence[str | None], coder: Coders) -> tuple[list[tuple[int, int, int, int, str]], tuple[np.ndarray, ...]]:
    """(n_a, n_b, n_groups, n_links, groups) of each text, and (text, pair, links) of the pairs."""
    out = [(0, 0, 0, 0, "")] * len(texts)
    some = [i for i, t in enumerate(texts) if t]
    ids_a, ids_b, own = [], [], []
    for i, b in zip(some, coder.b([texts[i] for i in some]), strict=True):
        a, whole = coder.a(" " + texts[i]), (" " + texts[i]).encode()
        if b"".join(map(coder.a_bytes.__getitem__, a.tolist())) == whole == b"".join(map(coder.b_bytes.__getitem__, b)):
            own.append(i)
            ids_a.append(a)
            ids_b.append(np.array(b, np.int64))
    if not own:
        return out, (np.zeros(0, np.int64),) * 3
    n_a, n_b = (np.array([len(x) for x in ids]) for ids in (ids_a, ids_b))
    a, b = np.concatenate(ids_a), np.concatenate(ids_b)
    # bytes are numbered through all the texts; each text ends a token of both
    end_a, end_b = np.cumsum(coder.a_size[a]), np.cumsum(coder.b_size[b])
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    doc = np.searchsorted(end_a[np.cumsum(n_a) - 1], cuts)
    links = np.bincount(group_a) * np.bincount(group_b)
    n_groups, n_links = np.bincount(doc, minlength=len(own)), np.zeros(len(own), np.int64)
    np.add.at(n_links, doc, links)

    # the groups of all texts as one list of tokens, each followed by its mark
    side = np.concatenate([2 * group_a, 2 * group_b + 1])
    order = np.argsort(side, kind="stable")
    side, ids = side[order], np.concatenate([a, b])[order]
    mark = np.full(len(ids), 3)
    mark[:-1] = np.where(side[1:] == side[:-1], 0, np.where(side[1:] >> 1 == side[:-1] >> 1, 1, 2))
    stop = np.cumsum(n_a + n_b)
    mark[stop - 1] = 3
    written = coder.written[mark, ids].tolist()
    for k, i in enumerate(own):
        groups = "".join(written[stop[k] - n_a[k] - n_b[k] : stop[k]])
        out[i] = (int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), groups)
    text, pair, times = _links(a, b, group_a, group_b, doc)
    return out, (np.array(own, np.int64)[text], pair, times)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as one zstd frame."""
    body = b""
    for c in columns:
        kind = next((t for t in ("<u1", "<u2", "<u4") if not len(c) or c.max() <= np.iinfo(t).max), "<i8")
        body += struct.pack("<2sI", kind[1:].encode(), len(c)) + c.astype(kind).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(body)


def _unpacked(frame: bytes) -> list[np.ndarray]:
    body, at, out = zstandard.ZstdDecompressor().decompress(frame), 0, []
    while at < len(body):
        kind, n = struct.unpack_from("<2sI", body, at)
        column = np.frombuffer(body, "<" + kind.decode(), n, at + 6)
        out.append(column.astype(np.int64))
        at += 6 + column.nbytes
    return out


def _run(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run of (pair, count) as blocks, each its length and a zstd frame."""
    out = []
    for i in range(0, len(pairs), BLOCK):
        some = pairs[i : i + BLOCK]
        frame = _packed(some[:1], np.diff(some), counts[i : i + BLOCK])
        out.append(struct.pack("<I", len(frame)) + frame)
    return b"".join(out)


_RUNS = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("pairs", pa.binary()), ("docs", pa.binary())])
_DOCS = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
        ("groups", pa.string()), ("groups_sha256", pa.string()),
    ]
)


def _spill(chunk: int, rows: list[tuple], records: list[tuple[np.ndarray, ...]], bits: int) -> Iterator[pa.RecordBatch]:
    """One chunk: its documents (part -1), then a run for each part."""
    table = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DOCS.types, strict=True)], schema=_DOCS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _DOCS) as writer:
        writer.write_batch(table)
    out = [(chunk, -1, None, zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes()))]
    doc, pair, times = (np.concatenate(c) for c in zip(*records, strict=True))
    order = np.lexsort((doc, pair))
    doc, pair, times = doc[order], pair[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    pairs, held = pair[new], np.diff(np.append(new, len(pair)))
    cuts = np.searchsorted(pairs >> (A_BITS + B_BITS - bits), np.arange((1 << bits) + 1))
    at = np.append(new, len(pair))
    for part in np.flatnonzero(np.diff(cuts)):
        some = slice(cuts[part], cuts[part + 1])
        record = slice(at[cuts[part]], at[cuts[part + 1]])
        out.append((chunk, part, _run(pairs[some], held[some]), _packed(held[some], doc[record], times[record])))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _RUNS.types, strict=True)], schema=_RUNS)


class _Spool:
    """The runs of one part, in memory up to a bound and beyond it in a file of the task."""

    def __init__(self):
        self.file, self.end = SpooledTemporaryFile(max_size=HELD_BYTES), 0

    def add(self, run: bytes) -> tuple[int, int]:
        self.file.seek(self.end)
        self.file.write(run)
        self.end += len(run)
        return self.end - len(run), self.end

    def blocks(self, place: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(pairs, counts) of a run, one block at a time."""
        at, end = place
        while at < end:
            self.file.seek(at)
            size = struct.unpack("<I", self.file.read(4))[0]
            first, steps, counts = _unpacked(self.file.read(size))
            at += 4 + size
            yield np.cumsum(np.concatenate([first, steps])), counts

    def entries(self, place: tuple[int, int]) -> Iterator[int]:
        for pairs, counts in self.blocks(place):
            yield from (pairs << 32 | counts).tolist()

    def merged(self, places: Sequence[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(pairs, total counts) of several runs through a heap, in order, each pair once."""
        entries = heapq.merge(*map(self.entries, places))
        pairs = counts = np.zeros(0, np.int64)
        while len(block := np.fromiter(islice(entries, BLOCK), np.int64)):
            pairs, counts = np.append(pairs, block >> 32), np.append(counts, block & 0xFFFFFFFF)
            new = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            pairs, counts = pairs[new], np.add.reduceat(counts, new)
            yield pairs[:-1], counts[:-1]  # the last pair may go on
            pairs, counts = pairs[-1:], counts[-1:]
        yield pairs, counts

    def count(self, places: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of the part with their counts; more runs than the heap takes are merged
        to longer ones first."""
        while len(places) > FAN_IN:
            longer = []
            for i in range(0, len(places), FAN_IN):
                run = b"".join(_run(*x) for x in self.merged(places[i : i + FAN_IN]))
                longer.append(self.add(run))
            places = longer
        pairs, counts = zip(*self.merged(places), strict=True)
        return np.concatenate(pairs), np.concatenate(counts)


def _counted(part_runs: list[tuple[int, tuple[int, int]]], spool: _Spool):
    """(pairs, counts, whether each count is the highest of its A id) and what goes back."""
    pairs, counts = spool.count([place for _, place in part_runs])
    new = np.flatnonzero(np.concatenate([[True], pairs[1:] >> B_BITS != pairs[:-1] >> B_BITS]))
    highest = np.repeat(np.maximum.reduceat(counts, new), np.diff(np.append(new, len(pairs))))
    return pairs, counts, counts == highest


def _merge(batches) -> Iterator[pa.RecordBatch]:
    """(chunk, part, counts and marks of the run's pairs) for rows sorted by part."""
    schema = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("back", pa.binary())])
    part, spool, held = None, None, []

    def finish():
        pairs, counts, best = _counted(held, spool)
        for chunk, place in held:
            back = []
            for some, _ in spool.blocks(place):
                at = np.searchsorted(pairs, some)
                back.append((counts[at], best[at]))
            total, mark = (np.concatenate(c) for c in zip(*back, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([part], pa.int32()), pa.array([_packed(total, mark.astype(np.int64))], pa.binary())], schema=schema)
        spool.file.close()

    for batch in batches:
        for chunk, own, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if own != part:
                if held:
                    yield from finish()
                part, spool, held = own, _Spool(), []
            held.append((chunk, spool.add(run.as_py())))
    if held:
        yield from finish()


def _apply(batches) -> Iterator[pa.RecordBatch]:
    """Documents with their sums, for rows sorted by chunk, part and kind: a run's documents
    come before the counts of its pairs."""
    schema = pa.schema([*_DOCS, ("n_best", pa.int64()), ("count_sum", pa.int64())])
    table = n_best = count_sum = run = None

    def finish():
        return pa.RecordBatch.from_arrays([*table.columns, pa.array(n_best), pa.array(count_sum)], schema=schema)

    for batch in batches:
        for part, kind, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            body = body.as_py()
            if part < 0:
                if table is not None:
                    yield finish()
                table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body)).read_next_batch()
                n_best, count_sum = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
            elif kind == 0:
                run = _unpacked(body)
            else:
                (held, doc, times), (total, mark) = run, _unpacked(body)
                np.add.at(n_best, doc, np.repeat(mark, held) * times)
                np.add.at(count_sum, doc, np.repeat(total, held) * times)
    if table is not None:
        yield finish()


def _part_bits(df: DataFrame) -> int:
    """At least as many parts as the session shuffles into, up to one for each A id."""
    return min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1, 63).bit_length(), A_BITS)


def spilled(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, chunk_records: int = CHUNK_RECORDS, written: bool = False) -> DataFrame:
    """The runs of all chunks, kept: (chunk, part, pairs, docs)."""
    a_path, b_path, bits = a_path or packing.default_vocabulary(), b_path or default_pieces(), _part_bits(docs)

    def run(batches):
        coder, chunk = coders(a_path, b_path), TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        records: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            begin = 0
            while begin < len(ids):
                some, n = [], 0
                while begin + len(some) < len(ids) and n < TEXT_BYTES:
                    some.append(texts[begin + len(some)].as_py())
                    n += len(some[-1] or "")
                facts, (text, pair, times) = align_texts(some, coder)
                records.append((text + len(rows), pair, times))
                for doc, (*numbers, groups) in zip(ids[begin : begin + len(some)], facts, strict=True):
                    sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
                    rows.append((doc, *numbers, groups if written else None, sha))
                begin, size = begin + len(some), size + len(pair)
                if size >= chunk_records:
                    yield from _spill(chunk, rows, records, bits)
                    chunk, rows, records, size = chunk + 1, [], [], 0
        if rows:
            yield from _spill(chunk, rows, records, bits)

    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return keep(runs.mapInArrow(lean(run), "chunk long, part int, pairs binary, docs binary"), "align-runs")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, chunk_records: int = CHUNK_RECORDS, written: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose
    count is the highest of their A id), count_sum (of all links), groups_sha256, and groups
    (`a1,a2|b1;a3|b2,b3`) where `written`, else null.

    Texts that are null or empty, or that one of the tokenizers doesn't give back byte for
    byte, have no tokens: zeros and an empty groups_sha256. Rows that repeat a doc_id, and
    copies, are documents each, and each counts. Columns other than doc_id and text are
    ignored; an empty table gives an empty one.

    A task holds `chunk_records` records and what one slice of texts adds; a text is aligned
    whole, so one text of any length is held by one task. A part's distinct pairs, bounded by
    the vocabularies, are held by one task; its runs lie in a file beyond a bound.
    """
    runs = spilled(docs, a_path, b_path, chunk_records, written)
    to_count = runs.where("part >= 0").select("chunk", "part", "pairs")
    parts = 1 << _part_bits(docs)
    back = to_count.repartition(parts, "part").sortWithinPartitions("part", "chunk").mapInArrow(
        lean(_merge), "chunk long, part int, back binary"
    )
    both = runs.select("chunk", "part", F.lit(0).alias("kind"), F.col("docs").alias("body")).unionByName(
        back.select("chunk", "part", F.lit(1).alias("kind"), F.col("back").alias("body"))
    )
    done = both.repartition("chunk").sortWithinPartitions("chunk", "part", "kind").mapInArrow(
        lean(_apply),
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, n_best long, count_sum long",
    )
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")


def pair_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(a_id, b_id, n_docs, highest) of every linked pair of ids, by the same runs."""
    runs = spilled(docs, a_path, b_path).where("part >= 0").select("chunk", "part", "pairs")
    back_to = pow(SPREAD, -1, 1 << A_BITS)

    def run(batches):
        part, spool, held = None, None, []

        def finish():
            pairs, counts, best = _counted(held, spool)
            spool.file.close()
            a = (pairs >> B_BITS) * back_to & ((1 << A_BITS) - 1)
            columns = [a, pairs & ((1 << B_BITS) - 1), counts, best]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a_id", "b_id", "n_docs", "highest"])

        for batch in batches:
            for chunk, own, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if own != part:
                    if held:
                        yield finish()
                    part, spool, held = own, _Spool(), []
                held.append((chunk, spool.add(some.as_py())))
        if held:
            yield finish()

    dealt = runs.repartition(1 << _part_bits(docs), "part").sortWithinPartitions("part", "chunk")
    return dealt.mapInArrow(lean(run), "a_id long, b_id long, n_docs long, highest boolean")
