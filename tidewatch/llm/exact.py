"""Exact dedup by deterministic block naming.

The text without white space is cut into blocks of fixed size. The distinct blocks are
sorted and numbered, so equal blocks, and only those, have the same integer name. Then
names of adjacent blocks are paired and the distinct pairs sorted and numbered in turn,
round by round, until one name is left for each document. Documents are equal when their
last names (and the number of rounds) are equal: no hash decides it.

What moves between machines: every distinct block of a map task once, to be sorted; after
that only integers. A block finds its name again by a 64-bit hash, and where two
different blocks share that hash, which the sorted table shows, by its bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import keep, whole_text

BLOCK_BYTES = 4096
WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
NO_PARTNER = -1


def without_white(text: Column) -> Column:
    """The text without ASCII white space."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def block_hash(block: Column) -> Column:
    """Where a block looks for its name; never what tells blocks apart."""
    return F.xxhash64(block)


def _blocks(size: int) -> Column:
    """`_raw` in blocks of `size` bytes; an empty text has one empty block."""
    last = F.floor(F.greatest(F.octet_length("_raw") - 1, F.lit(0)) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("_raw", i * size + 1, F.lit(size)))


def _numbered(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Number distinct rows: they lie hashed over the tasks, each sorts its own, and the
    name is the task's number followed by the place in it. Must be kept before use."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _block_names(texts: DataFrame, size: int) -> tuple[DataFrame, DataFrame | None]:
    """(hash, name) of all distinct blocks; (block, name) of those that share a hash."""
    blocks = texts.select(F.explode(_blocks(size)).alias("block"))
    blocks = blocks.select(block_hash(F.col("block")).alias("hash"), "block")
    named = keep(_numbered(blocks.distinct(), ["block"]).select("hash", "name"), "exact-blocks")
    shared = keep(named.groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("hash"), "exact-shared")
    if shared.isEmpty():
        return named, None
    # blocks whose hash is not theirs alone get names below zero, found by their bytes
    twins = _numbered(blocks.join(shared, "hash", "left_semi").select("block").distinct(), ["block"])
    twins = keep(twins.select("block", (F.lit(-2) - F.col("name")).alias("name")), "exact-twins")
    return named.join(shared, "hash", "left_anti"), twins


def _fold(current: DataFrame) -> DataFrame:
    """Name adjacent pairs again and again until every row has one name left."""
    done: list[DataFrame] = []
    rounds = 0
    while True:
        ends = F.max("pos").alias("last")
        lengths = current.groupBy("row").agg(ends, F.max("name").alias("name"))
        done.append(lengths.where("last = 0").select("row", F.lit(rounds).alias("rounds"), "name"))
        pairs = (
            current.withColumn("half", F.shiftright("pos", 1))
            .groupBy("row", "half")
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(NO_PARTNER)).alias("b"),
            )
        )
        # a row that is down to one name has only the pair (name, none) at 0 and leaves here
        pairs = keep(pairs.where(f"half > 0 or b <> {NO_PARTNER}"), "exact-pairs")
        if pairs.isEmpty():
            break
        named = keep(_numbered(pairs.select("a", "b").distinct(), ["a", "b"]), "exact-pair-names")
        current = keep(pairs.join(named, ["a", "b"]).select("row", F.col("half").alias("pos"), "name"), "exact-names")
        rounds += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def exact_groups(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when equal without ASCII white space; a null text counts as empty.
    Of equal texts the row with the most code points stays, then the smallest doc_id (null
    last); of rows that repeat even that, one is kept. Other columns are ignored, whatever
    their names. An empty table gives an empty one; a text of any length is cut into
    blocks. No group meets in one task: groups are counted on the map side, and the
    counts come back by a join whose skewed side Spark can split.
    """
    texts = docs.select(
        "doc_id",
        F.length(whole_text()).alias("chars"),
        without_white(whole_text()).cast("binary").alias("_raw"),
    )
    names, twins = _block_names(texts, size)
    # one pass writes what is needed of each row later, so that row numbers are fixed;
    # the bytes go along only where two different blocks share a hash
    rows = keep(
        texts.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "chars",
            F.sha2("_raw", 256).alias("text_sha256"),
            F.transform(_blocks(size), lambda b: block_hash(b)).alias("hashes"),
            *([] if twins is None else ["_raw"]),
        ),
        "exact-rows",
    )
    each = rows.select("row", F.posexplode("hashes").alias("at", "hash"))
    each = each.select("row", F.col("at").cast("long").alias("pos"), "hash")
    current = each.join(names, "hash").select("row", "pos", "name")
    if twins is not None:
        at_bytes = rows.select("row", F.posexplode(_blocks(size)).alias("at", "block")).join(twins, "block")
        current = current.unionByName(at_bytes.select("row", F.col("at").cast("long").alias("pos"), "name"))
    named = keep(_fold(keep(current, "exact-names")), "exact-identities")

    best = F.struct("chars", F.coalesce(-F.col("doc_id"), F.lit(-(2**63) + 1)).alias("o"), (-F.col("row")).alias("r"))
    facts = keep(rows.select("row", "doc_id", "chars", "text_sha256").join(named, "row"), "exact-facts")
    groups = facts.groupBy("rounds", "name").agg(
        F.max_by(F.struct("doc_id", "row"), best).alias("_best"), F.count(F.lit(1)).alias("group_size")
    )
    groups = keep(groups, "exact-groups")
    return facts.join(groups, ["rounds", "name"]).select(
        "doc_id",
        F.col("_best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_best.row") == F.col("row")).alias("kept"),
        "text_sha256",
    )
