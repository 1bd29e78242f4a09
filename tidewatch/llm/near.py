"""Near-dedup with Order MinHash.

A text's k-mers are windows of five words, labelled with their occurrence number. A sketch
takes the k-mers that are smallest under a random order and keeps them in the order of the
text, so texts share a sketch when they share k-mers in the same order. Texts that share
one of the sketches are candidates; a banded alignment of their k-mers verifies them:
aligned k-mers divided by all k-mers of both must reach the similarity.

However large a group is, its pairs are not written out: copies with equal words count as
one text; of the texts in a bucket each is first compared with two leaders only; and of the
buckets that this leaves with several classes, the large ones are cut into blocks, of
which each two meet in one place and compare their texts there, as long as they are not of
one class. So every two texts with a common sketch are either compared or in one class
through others.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import DOCUMENT_COLUMNS, ROW_GROUP_BYTES, keep, lean, whole_text, word_key

WORDS = 5
SIMILARITY = 0.8
#: (sketches, k-mers in each, largest text in k-mers that gets them). A pair at similarity s
#: shares one sketch of n k-mers with a probability near s ** n: of 28 sketches of 5 k-mers
#: a pair at 0.8 misses all in 15 of a million cases. Short texts, where leaving out one
#: k-mer matters, get sketches of 2 k-mers as well.
SKETCHES = ((28, 5, None), (16, 2, 20))
#: Members of one leader that one group verifies, and texts in a block of a large bucket.
GROUP = 256
#: Open buckets of more texts are compared in blocks, smaller ones as pairs.
PAIRED = 32
#: So many texts may be looked up by broadcast (about 100 bytes each); more go by shuffle.
BROADCAST_TEXTS = 500_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD) | np.uint64(1)


class _WordHashes(dict):
    """Hashes of words; remembers the first 131,072 it meets (about 25 MB)."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < 131_072:
            self[word] = value
        return value


def kmers(words: Sequence[bytes], hashes: dict[bytes, int], k: int = WORDS) -> np.ndarray:
    """The occurrence-labelled k-mers in the order of the text; a text of fewer than k words
    is one k-mer, a text of none has none. All values of a text differ."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n < k:
        whole = np.array([n], np.uint64)
        for i in range(n):
            whole = whole * _ODD + h[i : i + 1]
        return _mixed(whole)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = out * _ODD + h[i : n - k + 1 + i]
    out = _mixed(out)
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if not new.all():
        at = np.arange(len(out))
        occurrence = np.empty(len(out), np.uint64)
        occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
        out = np.where(occurrence > 0, _mixed(out + occurrence * _ODD), out)
    return out


def sketch(labels: np.ndarray, sketches=SKETCHES) -> np.ndarray:
    """Order MinHash values; each holds its own number, so equal values are of one sketch."""
    out, number = [], 0
    for count, size, most in sketches:
        if len(labels) and (most is None or len(labels) <= most):
            n = min(size, len(labels))
            # a long text is hashed for a few sketches at a time
            step = max(1, min(count, 2_000_000 // len(labels)))
            for first in range(number, number + count, step):
                factors = _FACTORS[first : min(first + step, number + count)]
                values = labels[None, :] * factors[:, None]
                least = np.argpartition(values, n - 1, axis=1)[:, :n] if n < len(labels) else np.tile(np.arange(n), (len(factors), 1))
                least.sort(axis=1)  # back into the order of the text
                total = factors.copy()
                for i in range(n):
                    total = _mixed(total * _ODD + labels[least[:, i]])
                out.append(total)
        number += count
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def similarity(a: np.ndarray, b: np.ndarray, at_least: float = SIMILARITY) -> float:
    """Aligned k-mers over all k-mers of both, 0 where it can't reach `at_least`.

    Equal k-mers are at known places of both texts, as the labels of a text differ. Within
    the band that the similarity allows, the longest chain of places that grow in both
    texts is the alignment.
    """
    if not len(a) or not len(b):
        return 0.0
    reach = lambda n: n / (len(a) + len(b) - n)
    if reach(min(len(a), len(b))) < at_least:
        return 0.0
    _, in_a, in_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if reach(len(in_a)) < at_least:
        return 0.0
    band = int((len(a) + len(b)) * (1 - at_least) / (1 + at_least) + 1e-9)
    near = np.abs(in_a - in_b) <= band
    places = in_b[near][np.argsort(in_a[near])]
    if not np.all(places[1:] > places[:-1]):
        ends: list[int] = []
        for p in places.tolist():
            i = bisect_left(ends, p)
            ends[i : i + 1] = [p]
        n = len(ends)
    else:
        n = len(places)
    return reach(n) if reach(n) >= at_least else 0.0


def _sketched(docs: DataFrame, sketches) -> DataFrame:
    """(row, doc_id, key, sketches) of every document, kept."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("sketches", pa.list_(pa.int64()))])

    def run(batches):
        hashes = _WordHashes()
        for batch in batches:
            keys, out = [], []
            for value in batch.column(1):
                words = (value.as_py() or "").encode().split()
                keys.append(hashlib.md5(b" ".join(words)).hexdigest())
                out.append(sketch(kmers(words, hashes), sketches).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(keys), pa.array(out, schema.field(2).type)], schema=schema)

    rows = docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, key string, sketches array<long>")
    return keep(rows.withColumn("row", F.monotonically_increasing_id()), "near-sketches")


def _verified(pairs: DataFrame, texts: DataFrame, at_least: float) -> DataFrame:
    """The pairs (a, b) that are similar. Pairs of one `a` go to several groups when they are
    many; each group gets the text of `a` first and then streams the others past it."""
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    dealt = pairs.join(sizes, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.floor(F.col("_n") / GROUP) + 1).alias("part")
    )
    dealt = keep(dealt, "near-pairs")
    members = dealt.join(texts, dealt["b"] == texts["node"]).select("a", "part", F.lit(1).alias("kind"), "b", "text")
    leaders = dealt.select("a", "part").distinct()
    leaders = leaders.join(texts, leaders["a"] == texts["node"]).select("a", "part", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("b"), "text")
    rows = leaders.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", "kind")

    def run(batches):
        hashes, now, leader = _WordHashes(), None, None
        for batch in batches:
            found = []
            a_col, part_col, kind_col, b_col = (batch.column(i).to_pylist() for i in range(4))
            for a, part, kind, b, text in zip(a_col, part_col, kind_col, b_col, batch.column(4), strict=True):
                labels = kmers((text.as_py() or "").encode().split(), hashes)
                if kind == 0:
                    now, leader = (a, part), labels
                elif now == (a, part) and similarity(leader, labels, at_least):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], names=["a", "b"])

    return rows.mapInArrow(lean(run), "a long, b long")


class _Block:
    """Texts of one block, against which others of the bucket are held.

    Classes that a link joins count as one from then on, so a block and the texts held
    against it give at most one link fewer than they have classes.
    """

    def __init__(self, at_least: float):
        self.at_least, self.members, self.joined = at_least, [], {}

    def add(self, node: int, comp: int, labels: np.ndarray, sketches: np.ndarray) -> None:
        self.members.append((node, comp, labels, sketches))

    def close(self) -> None:
        self.nodes, comps, labels, sketches = zip(*self.members, strict=True)
        self.comps, self.sizes = np.array(comps), np.array([len(x) for x in labels])
        self.labels, self.flat = labels, np.concatenate(labels)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.sketches = np.zeros((len(sketches), max(map(len, sketches))), np.int64)
        for i, x in enumerate(sketches):
            self.sketches[i, : len(x)] = x

    def _class(self, comp: int) -> int:
        while comp in self.joined:
            comp = self.joined[comp]
        return comp

    def links(self, value: int, member: tuple, after: int = -1) -> Iterator[tuple[int, int]]:
        """Links to members, after number `after`, that are still of another class, similar to
        this one and don't share an earlier sketch, whose bucket compares the two."""
        node, comp, labels, sketches = member
        comp = self._class(comp)
        open_ = self.comps != comp
        open_[: after + 1] = False
        first = int(np.flatnonzero(sketches == value)[0])
        open_ &= ~(self.sketches[:, :first] == sketches[:first]).any(axis=1)
        if not open_.any():
            return
        own = np.sort(labels)
        at = np.minimum(np.searchsorted(own, self.flat), len(own) - 1)
        shared = np.add.reduceat((own[at] == self.flat).astype(np.int64), self.starts)
        open_ &= shared >= self.at_least * (len(labels) + self.sizes - shared) - 1e-9
        for i in np.flatnonzero(open_):
            other = int(self.comps[i])
            if other != comp and similarity(labels, self.labels[i], self.at_least):
                self.joined[other] = comp
                self.comps[self.comps == other] = comp
                yield self.nodes[i], node


def _linked_in_blocks(members: DataFrame, texts: DataFrame, at_least: float) -> DataFrame:
    """Similar pairs (a, b) that join the classes of the buckets of (value, node, comp).

    A bucket of n texts is dealt over n / GROUP blocks by a hash; a text goes to each pair
    of blocks that holds its own, so n * n / GROUP rows are moved, and a task holds one
    block and streams the other past it.
    """
    sizes = members.groupBy("value").agg((F.floor(F.count(F.lit(1)) / GROUP) + 1).alias("_blocks"))
    dealt = members.join(sizes, "value").withColumn("own", F.pmod(F.xxhash64("node"), F.col("_blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    dealt = dealt.select(
        "value", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        (F.col("own") > F.col("other")).cast("int").alias("second"), "node", "comp",
    )
    rows = dealt.join(texts, "node").select("value", "lo", "hi", "second", "node", "comp", "sketches", "text")
    rows = rows.repartition("value", "lo", "hi").sortWithinPartitions("value", "lo", "hi", "second", "node")

    def run(batches):
        hashes, now, block, closed = _WordHashes(), None, None, False

        def finish(group, held):
            held.close()
            if group[1] == group[2]:
                for i, member in enumerate(held.members):
                    yield from held.links(group[0], member, i)

        def pairs(found):
            found = sorted(set(found))
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], names=["a", "b"])

        for batch in batches:
            found = []
            keys = [batch.column(i).to_pylist() for i in range(6)]
            for value, lo, hi, second, node, comp, own, text in zip(*keys, batch.column(6), batch.column(7), strict=True):
                if now != (value, lo, hi):
                    if block is not None and not closed:
                        found += finish(now, block)
                    now, block, closed = (value, lo, hi), _Block(at_least), False
                labels = kmers((text.as_py() or "").encode().split(), hashes)
                member = (node, comp, labels, np.array(own.as_py(), np.int64))
                if not second:
                    block.add(*member)
                elif block.members:
                    if not closed:
                        found += finish(now, block)
                        closed = True
                    found += block.links(value, member)
            yield pairs(found)
        if block is not None and not closed and block.members:
            yield pairs(finish(now, block))

    return rows.mapInArrow(lean(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (a, b); comp is the smallest node of the class.

    Each turn gives a node the smallest label among its neighbours and then the label of
    its label, until nothing changes; only counts come to the driver.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = keep(both, "near-edges")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "near-labels")
    while True:
        at_b = labels.select(F.col("node").alias("b"), F.col("comp").alias("other"))
        least = both.join(at_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        hooked = labels.join(least, "node").select("node", F.least("comp", "other").alias("mid"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        moved = keep(hooked.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("comp")), "near-labels")
        labels = moved.select("node", "comp")
        if moved.where("old <> comp").isEmpty():
            return labels


def _looked_up(rows: DataFrame) -> DataFrame:
    """Kept rows as the side of a join with the documents: broadcast when a count shows them few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_TEXTS else rows


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text, sketches) of the nodes, found by id and checked by key, kept.

    Rows that repeat id and words find the same node; one of them is enough, and they are
    cut down to it on the map side.
    """
    nodes = keep(nodes.select("node", F.col("doc_id").alias("_id"), "key", "sketches"), "near-nodes")
    right = _looked_up(nodes.drop("sketches"))
    found = docs.select("doc_id", "text").join(right, F.col("doc_id").eqNullSafe(F.col("_id")))
    found = found.where(word_key(whole_text()) == F.col("key")).groupBy("node").agg(F.first("text").alias("text"))
    return keep(found.join(nodes.select("node", "sketches"), "node"), "near-texts", ROW_GROUP_BYTES)


def near_groups(docs: DataFrame, at_least: float = SIMILARITY, sketches=SKETCHES) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id (smallest doc_id of its class),
    class_size, n_copies (rows with exactly its words), kept (one row of each class).

    Texts with the same words are copies; texts without words, null ones among them, are
    copies of each other. Texts of fewer than five words are near only as copies. Rows that
    repeat a doc_id are rows each; a null doc_id comes after all others. Other columns are
    ignored; an empty table gives an empty one.
    """
    return _grouped(docs, ["doc_id"], at_least, sketches)


def _grouped(docs: DataFrame, own: list[str], at_least: float, sketches=SKETCHES) -> DataFrame:
    """What near_groups gives, with the columns `own` of doc_id and key of each row."""
    rows = _sketched(docs, sketches)
    copies = keep(rows.groupBy("key").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n_copies")), "near-copies")
    each = rows.join(copies.select(F.col("node").alias("row")).hint("merge"), "row")
    values = each.select(F.col("row").alias("node"), F.explode("sketches").alias("value"))
    buckets = values.groupBy("value").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    buckets = keep(buckets.where("low < high"), "near-buckets")
    members = keep(values.join(buckets.hint("merge"), "value"), "near-members")
    nodes = members.select(F.col("node").alias("row")).distinct()
    texts = _texts(docs, rows.join(nodes, "row").select(F.col("row").alias("node"), "doc_id", "key", "sketches"))

    first = (
        members.select(F.col("low").alias("a"), F.col("node").alias("b"))
        .union(members.select(F.col("high").alias("a"), F.col("node").alias("b")))
        .where("a <> b")
        .distinct()
    )
    first = keep(first, "near-first")
    edges = keep(_verified(first, texts, at_least), "near-links")
    classes = components(edges)

    # buckets whose texts are not all in one class: what is left to compare in them
    placed = members.select("value", "node").join(classes, "node", "left").select("value", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = placed.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"))
    open_ = keep(placed.join(mixed.where("lo < hi").select("value", "n"), "value"), "near-open")
    few = open_.where(F.col("n") <= PAIRED).drop("n")
    other = few.select("value", F.col("node").alias("b"), F.col("comp").alias("comp_b"))
    rest = few.withColumnRenamed("node", "a").join(other, "value").where("a < b and comp <> comp_b").select("a", "b").distinct()
    tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = rest.join(tested, ["a", "b"], "left_anti")
    many = open_.where(F.col("n") > PAIRED).drop("n")
    more = keep(_verified(rest, texts, at_least).unionByName(_linked_in_blocks(many, texts, at_least)), "near-links")
    if not more.isEmpty():
        classes = components(edges.unionByName(more))

    facts = rows.select("row", "doc_id", "key").join(copies, "key").join(classes, "node", "left")
    facts = keep(facts.select("row", *own, "n_copies", F.coalesce("comp", "node").alias("comp")), "near-facts")
    best = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    groups = facts.groupBy("comp").agg(
        F.min_by(F.struct("doc_id", "row"), best).alias("_best"), F.count(F.lit(1)).alias("class_size")
    )
    groups = keep(groups, "near-groups")
    return facts.join(groups, "comp").select(
        *own, F.col("_best.doc_id").alias("class_id"), "class_size", "n_copies",
        (F.col("row") == F.col("_best.row")).alias("kept"),
    )


def near_dedup(docs: DataFrame, at_least: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` without all but one of each class, in the columns of documents.

    Rows are told apart by doc_id and words; of rows that repeat both, one stays.
    """
    docs = docs.select(*DOCUMENT_COLUMNS)
    rows = keep(_grouped(docs, ["doc_id", "key"], at_least).select(F.col("doc_id").alias("_id"), "key", "kept"), "near-rows")
    ids = keep(rows.groupBy("_id").agg(F.max("kept").alias("_stays"), F.count(F.lit(1)).alias("_n")), "near-result")
    gone = _looked_up(ids.where("not _stays").select("_id"))
    many = ids.where("_stays and _n > 1").select(F.col("_id").alias("_many"))
    same = F.col("doc_id").eqNullSafe(F.col("_many"))
    kept = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
    if many.isEmpty():
        return kept
    many = _looked_up(many)
    single = kept.join(many, same, "left_anti")
    repeated = kept.join(many, same, "left_semi").withColumn("_key", word_key(whole_text()))
    # a class has one kept row, so its words under its id are wanted once
    wanted = rows.where("kept").join(many, F.col("_id").eqNullSafe(F.col("_many")), "left_semi")
    wanted = _looked_up(keep(wanted.select("_id", "key"), "near-wanted"))
    found = repeated.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("key")), "left_semi")
    return single.unionByName(found.dropDuplicates(["doc_id", "_key"]).drop("_key"))
