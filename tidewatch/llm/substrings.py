"""Dedup of repeated byte strings with suffixes sorted by external induced sorting.

A byte goes when a string of `length` bytes that covers it also starts earlier. Only places
that can repeat are sorted:

1. Of each `length` bytes, the piece of 48 bytes with the least hash is an anchor. Equal
   strings have equal anchors, so a string repeats only where its anchor does. An anchor's
   context is all the bytes that strings with this anchor can cover.
2. Anchors meet by hash. A context that is equal to an earlier one goes as a whole; of equal
   ones in a chunk of documents only the first is moved at all. What is left are the first
   contexts of anchors that have several: where repeats begin and end, and around edits.
3. These contexts are dealt to shards by their anchor. A shard sorts all their suffixes
   (`induced`) with the prefixes that neighbours share; suffixes that share `length` bytes or
   more are one string, and all but the earliest of them go. Anchors with very many contexts
   are dealt by longer pieces that their strings have in common (see `_wanted`).

Texts are kept once, packed in chunks of a table bucketed by chunk, so that what comes back
for a chunk is joined to it without moving texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import keep, lean
from tidewatch.llm.induced import Strings
from tidewatch.llm.near import _mixed
from tidewatch.session import scratch_folder

LENGTH = 100
PIECE = 48
#: Bytes of text in a chunk, and bytes that are hashed at a time.
CHUNK_BYTES, SLICE_BYTES = 16 << 20, 1 << 20
#: An anchor with more contexts than this is dealt by longer pieces.
MANY = 8192
#: Places of the anchor in the strings of one deal then; they share length - STEP + 1 bytes.
STEP = 16
#: Shards for each partition that the session shuffles into.
SHARDS = 2
#: Bits of a chunk's number that count the chunks of a partition.
CHUNK_BITS = 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_TEXTS = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])


def _piece_hashes(flat: np.ndarray) -> np.ndarray:
    """The hash of the piece from each place on."""
    h = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)[flat]
    size = 1
    while size < PIECE:
        step = min(size, PIECE - size)
        h = _mixed(h[: len(h) - step] * _ODD + h[step:])
        size += step
    return h


def _sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """The least or greatest of each `size` neighbours."""
    have = 1
    while 2 * have <= size:
        values = pick(values[: len(values) - have], values[have:])
        have *= 2
    rest = size - have
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def _joined_hash(pieces: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: np.ndarray, longest: int) -> np.ndarray:
    """A hash of the bytes from begin to end, which are at least a piece, from piece hashes."""
    out = _mixed(seed.astype(np.uint64) * _ODD + (end - begin).astype(np.uint64))
    for i in range(0, longest, PIECE):
        out = _mixed(out * _ODD + pieces[np.minimum(begin + i, end - PIECE)])
    return out


def anchors(flat: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(place, hash, context begin, context end, context hash) of the anchors of the texts
    flat[begin:end]; texts below `length` have none. Ties are anchors each."""
    window = length - PIECE + 1
    long = end - begin >= length
    begin, end = begin[long], end[long]
    if not len(begin):
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2, np.zeros(0, np.uint64))
    pieces = _piece_hashes(flat)
    least = _sliding(pieces, window, np.minimum)
    # strings that lie in one text
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end - length + 1, -1)
    least[np.cumsum(edge)[: len(least)] == 0] = 0
    around = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    place = np.flatnonzero(_sliding(around, window, np.maximum)[: len(pieces)] == pieces)
    text = np.searchsorted(begin, place, "right") - 1
    first, last = np.maximum(begin[text], place - window + 1), np.minimum(end[text], place + length)
    context = _joined_hash(pieces, first, last, place - first, 2 * length - PIECE)
    return place, pieces[place], first, last, context


def _text_anchors(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, place, hash, context begin, context end, context hash), some texts at a time;
    a text longer than a slice is looked at in overlapping parts."""

    def some(numbers):
        size = np.array([len(texts[i]) for i in numbers])
        stop = np.cumsum(size)
        flat = np.frombuffer(b"".join(texts[i] for i in numbers), np.uint8)
        place, key, first, last, context = anchors(flat, stop - size, stop, length)
        own = np.searchsorted(stop, place, "right")
        base = (stop - size)[own]
        return np.array(numbers, np.int64)[own], place - base, key, first - base, last - base, context

    waiting, held = [], 0
    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        if len(text) <= 2 * SLICE_BYTES:
            waiting.append(i)
            held += len(text)
            if held >= SLICE_BYTES:
                yield some(waiting)
                waiting, held = [], 0
            continue
        found = []
        for at in range(0, len(text), SLICE_BYTES):
            # strings that start in this part, with all that the contexts of their anchors reach
            low, high = max(0, at - 2 * length), min(len(text), at + SLICE_BYTES + 3 * length)
            if high - low < length:
                continue
            place, *rest = anchors(np.frombuffer(text[low:high], np.uint8), np.array([0]), np.array([high - low]), length)
            place, rest[1], rest[2] = place + low, rest[1] + low, rest[2] + low
            found.append([place, *rest])
        place, key, first, last, context = (np.concatenate(c) for c in zip(*found, strict=True))
        # parts overlap; a context that the edge of one cuts off is whole in another
        whole = (first == np.maximum(0, place - length + PIECE)) & (last == np.minimum(len(text), place + length))
        _, once = np.unique(np.where(whole, place, -1), return_index=True)
        once = once[whole[once]]
        yield np.full(len(once), i), place[once], key[once], first[once], last[once], context[once]
    if waiting:
        yield some(waiting)


def _pack(table: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_batch(table)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def _unpack(body: bytes) -> tuple[list[int | None], list[bytes]]:
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body)).read_next_batch()
    return table.column(0).to_pylist(), table.column(1).to_pylist()


def _chunks(docs: DataFrame) -> DataFrame:
    """(chunk, body): all texts, packed; kept in a table bucketed by chunk."""

    def run(batches):
        chunk, ids, texts, size = TaskContext.get().partitionId() << CHUNK_BITS, [], [], 0

        def packed():
            body = _pack(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], schema=_TEXTS))
            return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([body], pa.binary())], names=["chunk", "body"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                texts.append((text.as_py() or "").encode())
                size += len(texts[-1])
                if size >= CHUNK_BYTES or len(ids) == 1 << DOC_BITS:
                    yield packed()
                    chunk, ids, texts, size = chunk + 1, [], [], 0
        if ids:
            yield packed()

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "chunk long, body binary")
    name, buckets = f"substring_chunks_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, "chunk").option("path", scratch_folder(spark, "substring-chunks")).saveAsTable(name)
    return spark.table(name)


#: What moves: bytes that go (kind 0: `doc_id` is their begin, `spot` their end), and anchors
#: (kind 1); `row` numbers the rows of the table, `spot` is a place and its context's reach.
_FOUND_SCHEMA = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("spot", pa.int64())])
_FOUND = "kind byte, key long, context long, doc_id long, row long, spot long"
#: Bits of a row's number that are its place in its chunk, and of a spot on each side.
DOC_BITS, REACH_BITS = 20, 8
#: Rows without an id come last.
_NO_ID = (1 << 63) - 1


def _spot(place: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return place << 2 * REACH_BITS | (place - begin) << REACH_BITS | (end - place)


def _reach(spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """place, begin and end of the context."""
    place, most = spot >> 2 * REACH_BITS, (1 << REACH_BITS) - 1
    return place, place - (spot >> REACH_BITS & most), place + (spot & most)


def _rows(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    arrays = [pa.array(columns[f.name].astype(f.type.to_pandas_dtype())) for f in _FOUND_SCHEMA]
    return pa.RecordBatch.from_arrays(arrays, schema=_FOUND_SCHEMA)


def _gone(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Bytes that go, merged; they meet no others and are spread over all tasks."""
    rows, own = np.unique(row, return_inverse=True)
    sizes = np.zeros(len(rows), np.int64)
    np.maximum.at(sizes, own, end)
    own, begin, end = spans(sizes, own, begin, end)
    row, n = rows[own], len(own)
    spread = _mixed((row * 1_000_003 + begin).astype(np.uint64)).view(np.int64)
    return _rows({"kind": np.zeros(n), "key": spread, "context": np.zeros(n), "doc_id": begin, "row": row, "spot": end})


def _at(columns: dict[str, np.ndarray], some) -> dict[str, np.ndarray]:
    return {name: c[some] for name, c in columns.items()}


def _contexts_of(columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key and context: where a key and where a context begins."""
    n = len(columns["key"])
    new_key, new = np.ones(n, bool), np.ones(n, bool)
    new_key[1:] = columns["key"][1:] != columns["key"][:-1]
    new[1:] = new_key[1:] | (columns["context"][1:] != columns["context"][:-1])
    return new_key, new


def _known(ids: list[int | None]) -> np.ndarray:
    return np.array([_NO_ID if i is None else i for i in ids], np.int64)


def _anchored(length: int):
    """Per chunk its anchors, without those whose context an earlier one of the chunk has;
    these are bytes that go."""

    def run(batches):
        for batch in batches:
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, texts = _unpack(body.as_py())
                found = list(_text_anchors(texts, length))
                if not found:
                    continue
                doc, place, key, first, last, context = (np.concatenate(c) for c in zip(*found, strict=True))
                columns = {
                    "key": key.view(np.int64), "context": context.view(np.int64), "doc_id": _known(ids)[doc],
                    "row": chunk << DOC_BITS | doc, "spot": _spot(place, first, last),
                }
                columns = _at(columns, np.lexsort([columns[c] for c in ("spot", "row", "doc_id", "context", "key")]))
                _, new = _contexts_of(columns)
                if not new.all():
                    _, begin, end = _reach(columns["spot"][~new])
                    yield _gone(columns["row"][~new], begin, end)
                columns = _at(columns, new) | {"kind": np.ones(int(new.sum()))}
                for i in range(0, len(columns["key"]), 65_536):
                    yield _rows(_at(columns, slice(i, i + 65_536)))

    return run


def _wanted(batches) -> Iterator[pa.RecordBatch]:
    """For rows sorted by kind, key, context and order: the bytes that go, and the first row of
    each context of anchors that have several; `context` then counts them in an anchor.

    What a batch leaves open is its last context: its first row, whether that was given
    already, and its number among the contexts of its anchor.
    """
    held, given, number = None, False, 1
    for batch in batches:
        columns = {f.name: batch.column(i).to_numpy() for i, f in enumerate(_FOUND_SCHEMA)}
        gone = columns["kind"] == 0
        if gone.any():
            yield _rows(_at(columns, gone))
            columns = _at(columns, ~gone)
        if held is not None:
            columns = {name: np.concatenate([held[name], c]) for name, c in columns.items()}
        n = len(columns["key"])
        if not n:
            continue
        new_key, new = _contexts_of(columns)
        if not new.all():
            _, begin, end = _reach(columns["spot"][~new])
            yield _gone(columns["row"][~new], begin, end)
        starts = np.flatnonzero(new_key)
        sizes = np.diff(np.append(starts, n))
        nth = np.cumsum(new)
        nth = nth - np.repeat(nth[starts], sizes) + 1
        if held is not None:
            nth[: sizes[0]] += number - 1
        several = np.repeat(nth[starts + sizes - 1] > 1, sizes)
        ask = several & new
        ask[0] &= held is None or not given
        if ask.any():
            yield _rows(_at(columns, ask) | {"context": nth[ask]})
        last = int(np.flatnonzero(new)[-1])
        held, given, number = _at(columns, slice(last, last + 1)), bool(several[-1]), int(nth[-1])


_CONTEXTS = "deal long, doc_id long, row long, begin int, bytes binary"
_CONTEXTS_SCHEMA = pa.schema([("deal", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("begin", pa.int32()), ("bytes", pa.binary())])
_WANT = ("row", "spot", "key", "many")


def _contexts(length: int):
    """The bytes of the wanted contexts, dealt by anchor.

    An anchor with many contexts is dealt by more of the strings: those whose anchor lies
    `STEP` places or fewer apart have length - STEP + 1 bytes in common, whose hash deals
    them, and form a context that is shorter.
    """

    def run(batches):
        for batch in batches:
            for chunk, body, wants in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                ids, texts = _unpack(body.as_py())
                row, spot, key, many = (wants.values.field(c).to_numpy(zero_copy_only=False) for c in _WANT)
                doc = row - (chunk << DOC_BITS)
                out: list[tuple[int, int, int, bytes]] = []
                for d, place, begin, end, k, m in zip(*(x.tolist() for x in (doc, *_reach(spot), key, many)), strict=True):
                    if not m:
                        out.append((k, d, begin, texts[d][begin:end]))
                        continue
                    for low in range(0, length - PIECE + 1, STEP):
                        # the strings that start at place - high, ..., place - low and lie in the context
                        high = min(low + STEP - 1, length - PIECE)
                        first, last = max(begin, place - high), min(end, place - low + length)
                        if last - first >= length:
                            common = texts[d][place - low : place - high + length]
                            deal = xxhash.xxh64_intdigest(common, low + 1) - (1 << 63)
                            out.append((deal, d, first, texts[d][first:last]))
                for i in range(0, len(out), 65_536):
                    deal, d, begin, bytes_ = zip(*out[i : i + 65_536], strict=True)
                    at = np.array(d)
                    columns = [deal, _known(ids)[at], chunk << DOC_BITS | at, begin, bytes_]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CONTEXTS_SCHEMA.types, strict=True)], schema=_CONTEXTS_SCHEMA)

    return run


_GONE = "row long, begin int, end int"


def _sorted_shard(length: int):
    """The bytes that go by the contexts of a shard: all suffixes in order, and of those that
    share `length` bytes all but the earliest."""

    def run(batches):
        strings, facts = Strings(), []
        for batch in batches:
            bytes_ = batch.column(4).to_pylist()
            strings.add(np.frombuffer(b"".join(bytes_), np.uint8), np.array([len(x) for x in bytes_], np.int64))
            facts.append([batch.column(i).to_numpy() for i in range(1, 4)])
        if not facts:
            return
        doc_id, row, begin = (np.concatenate(c) for c in zip(*facts, strict=True))
        order = np.lexsort((row, doc_id))
        new = np.zeros(len(order), np.int64)
        new[1:] = row[order][1:] != row[order][:-1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        gone, open_ = [np.zeros(0, np.int64)], np.zeros(0, np.int64)

        def late(place: np.ndarray, group: np.ndarray) -> np.ndarray:
            """All but the earliest of each group, as string and place in it."""
            string, at = strings.found(place)
            start = rank[string] << 32 | (begin[string] + at)
            first = np.minimum.reduceat(start, group)
            later = start > np.repeat(first, np.diff(np.append(group, len(start))))
            return string[later] << 32 | at[later]

        # suffixes that share so much follow each other; a block may leave its last ones open
        for place, shared in strings.descending(length):
            same = shared >= length
            if len(open_) and not same[0]:
                if len(open_) > 1:
                    gone.append(late(open_, np.array([0])))
                open_ = open_[:0]
            place, same = np.concatenate([open_, place]), np.concatenate([np.arange(len(open_)) > 0, same])
            if len(open_):
                same[len(open_)] = True
            starts = np.flatnonzero(~same)
            last = int(starts[-1])
            some = np.flatnonzero(same[:last] | np.append(same[1:last], False)[:last])  # in groups of several
            if len(some):
                gone.append(late(place[some], np.flatnonzero(~same[some])))
            open_ = place[last:]
        if len(open_) > 1:
            gone.append(late(open_, np.array([0])))
        found = np.sort(np.concatenate(gone))
        if not len(found):
            return
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1] + 1]))
        last = np.append(first[1:], len(found)) - 1
        string = found[first] >> 32
        low, high = found[first] & 0xFFFFFFFF, (found[last] & 0xFFFFFFFF) + length
        yield pa.RecordBatch.from_arrays(
            [pa.array(row[string]), pa.array((begin[string] + low).astype(np.int32)), pa.array((begin[string] + high).astype(np.int32))],
            names=["row", "begin", "end"],
        )

    return run


def spans(sizes: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, begin, end) of the maximal stretches that the given ones make, in order."""
    base = np.concatenate([[0], np.cumsum(sizes + 1)])  # texts don't touch
    low, high = base[doc] + begin, base[doc] + end
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]])) if len(low) else np.zeros(0, np.int64)
    low, high = low[new], high[np.append(new[1:], len(high)) - 1] if len(low) else high
    own = np.searchsorted(base, low, "right") - 1
    return own, low - base[own], high - base[own]


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _cut(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, body, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            ids, texts = _unpack(body.as_py())
            sizes = np.array([len(t) for t in texts], np.int64)
            row, begin, end = (found.values.field(i).to_numpy().astype(np.int64) for i in range(3)) if found.is_valid else (np.zeros(0, np.int64),) * 3
            own, begin, end = spans(sizes, row - (chunk << DOC_BITS), begin, end)
            removed, n = np.zeros(len(ids), np.int64), np.bincount(own, minlength=len(ids))
            np.add.at(removed, own, end - begin)
            kept, at = texts, np.cumsum(n) - n
            for i in np.flatnonzero(n):
                stops = [0, *np.stack([begin, end], 1)[at[i] : at[i] + n[i]].ravel().tolist(), len(texts[i])]
                kept[i] = b"".join(texts[i][a:b] for a, b in zip(stops[::2], stops[1::2], strict=True))
            for i in range(0, len(ids), 2048):
                some = slice(i, i + 2048)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some], pa.int64()), pa.array(sizes[some]), pa.array(removed[some]), pa.array(n[some]), pa.array(kept[some], pa.binary())],
                    schema=_KEPT,
                )


def _per_chunk(chunks: DataFrame, rows: DataFrame, columns: tuple[str, ...], how: str) -> DataFrame:
    """Each chunk with the rows found for it, whose number its size bounds."""
    found = rows.groupBy(F.shiftright("row", DOC_BITS).alias("chunk")).agg(F.collect_list(F.struct(*columns)).alias("found"))
    return chunks.join(found, "chunk", how).select("chunk", "body", "found")


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans (maximal stretches that
    were removed) and kept, the bytes that are left.

    A byte goes when a string of `length` bytes that covers it also starts earlier: in a row
    of smaller doc_id or earlier in the same text. A null text is empty. Rows with a null
    doc_id come after all others; rows that share a doc_id, or have none, follow each other
    as the table's partitions hold them. Texts of any length are hashed in parts. Columns
    other than doc_id and text are ignored; an empty table gives an empty one.

    A task holds one chunk of texts, or the contexts of a shard's anchors, which it sorts
    with files of its own beyond a bound. Contexts of the same anchor count as equal when two
    64-bit hashes are; where they differ the bytes decide.
    """
    if not PIECE + STEP <= length < PIECE + (1 << REACH_BITS) or length >= 1 << REACH_BITS:
        raise ValueError(f"length must be at least {PIECE + STEP} and below {1 << REACH_BITS}")
    chunks = _chunks(docs)
    rows = chunks.mapInArrow(lean(_anchored(length)), _FOUND).repartition("key").sortWithinPartitions("kind", "key", "context", "doc_id", "row", "spot")
    found = keep(rows.mapInArrow(lean(_wanted), _FOUND), "substring-found")
    wanted = found.where("kind = 1")
    # at most one anchor in MANY wanted contexts has many
    many = wanted.where(F.col("context") > MANY).select("key").distinct().withColumn("many", F.lit(True))
    wanted = wanted.join(many, "key", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    contexts = _per_chunk(chunks, wanted, _WANT, "inner").mapInArrow(lean(_contexts(length)), _CONTEXTS)
    shards = SHARDS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = keep(contexts.repartition(shards, "deal").mapInArrow(lean(_sorted_shard(length)), _GONE), "substring-sorted")
    gone = found.where("kind = 0").select("row", F.col("doc_id").cast("int").alias("begin"), F.col("spot").cast("int").alias("end"))
    return _per_chunk(chunks, gone.unionByName(sorted_), ("row", "begin", "end"), "left").mapInArrow(
        lean(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
