import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F
from helpers import ODD_TEXTS, empty_documents, odd_documents, rows_of
from tidewatch.llm import exact, lines, mixing

WHITE = re.compile(r"[\x20\x09-\x0D]")


def fill_targets(sizes, weights=(1, 2, 3), cap=3):
    """Share, cut at the cap, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(cap * sizes[s] for s in capped)
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return {**share, **{s: cap * sizes[s] for s in capped}}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 5}, {"a": 1, "b": 2, "c": 3, "d": 1000, "e": 4, "é": 7, None: 50}, {"z": 9}])
def test_targets(spark, sizes):
    rows = [(s, 1) for s, n in sizes.items() for _ in range(n)]
    got = mixing.source_targets(spark.createDataFrame(rows, "source string, size long"))
    want = fill_targets(sizes)
    for r in got.collect():
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-12)


def test_mix_of_null_and_repeated_ids(spark):
    """Rows without an id, with one id, and equal rows draw each: sources come near their targets."""
    rows = [(None, " ".join(["w"] * (1 + i % 7)) + f" {i}", "a") for i in range(3000)]
    rows += [(5, f"some words {i}", "b") for i in range(3000)] + [(6, "equal rows of four", "c")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    planned = mixing.plan_mix(docs)
    got = planned.groupBy("source").agg(F.max("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert len(got) == 3 and all(abs(r["taken"] / r["t"] - 1) < 0.1 for r in got)
    again = lambda: sorted(map(str, planned.select("text", "copies").collect()))
    assert again() == again()


def test_mix_odd_rows(spark):
    docs = odd_documents(spark)
    planned = rows_of(mixing.plan_mix(docs))
    assert len(planned) == len(ODD_TEXTS) + 2
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in planned:
        assert r["size"] == words(r["text"]) and 0 <= r["copies"] <= 3 and r["class_id"] == "x"
        assert r["target"] <= 3 * r["source_size"] + 1e-9
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r["copies"] for r in planned)
    assert rows_of(mixing.plan_mix(empty_documents(spark))) == []


def test_mix_without_words(spark):
    docs = odd_documents(spark, [None, "", " "])
    assert all(r["copies"] == 0 and r["target"] == 0 for r in rows_of(mixing.plan_mix(docs)))


def brute_groups(docs):
    groups = {}
    for d in docs:
        groups.setdefault(WHITE.sub("", d["text"] or ""), []).append(d)
    return groups


@pytest.mark.parametrize("size", [4, 64, 4096])
def test_exact_groups(spark, size):
    # long texts that differ in one place, copies with other white space, and prefixes
    texts = [*ODD_TEXTS, "abcdefgh" * 9, "abcdefgh" * 8, "abcdefgh" * 8 + "abcdefgX", "abcd efgh" * 9, "abcdXfgh" + "abcdefgh" * 8]
    docs = odd_documents(spark, texts)
    got = rows_of(exact.exact_groups(docs, size))
    all_docs = rows_of(docs)
    assert len(got) == len(all_docs)
    groups = brute_groups(all_docs)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        same = by_sha[r["text_sha256"]]
        best = min(same, key=lambda d: (-len(d["text"] or ""), d["doc_id"] is None, d["doc_id"]))
        assert r["group_size"] == len(same) and r["keep_id"] == best["doc_id"]
    assert sum(r["kept"] for r in got) == len(groups)
    assert rows_of(exact.exact_groups(empty_documents(spark))) == []


def test_exact_blocks_that_share_a_hash(spark, monkeypatch):
    """With a hash that says little, blocks are told apart by their bytes."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact, "block_hash", lambda b: F.octet_length(b).cast("long"))
    texts = ["abcdefgh", "abcdefgX", "XXXXefgh", "abcdefgh", "abcdefghij", "abcdefghiX", "", None]
    docs = odd_documents(spark, texts)
    got = rows_of(exact.exact_groups(docs, 4))
    groups = brute_groups(rows_of(docs))
    assert sum(r["kept"] for r in got) == len(groups)
    for r in got:
        assert r["group_size"] == len(next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"]))


def test_line_dedup(spark):
    rows = [(i, f"header\n own {i}\n  footer \nbody\n{'body' if i % 4 else 'rare'}", "h", i) for i in range(40)]
    rows += [(100 + i, "header\nfooter", "small", 0) for i in range(5)]
    rows += [(200, None, None, 0), (201, "", None, 0), (202, "header", "h", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines long")
    got = {r["doc_id"]: r for r in rows_of(lines.dedup_lines(docs, ratio=0.5))}
    assert len(got) == len(rows)
    for i in range(40):
        assert got[i]["text"] == (f" own {i}" if i % 4 else f" own {i}\nrare")
        assert got[i]["n_dropped"] == (4 if i % 4 else 3) and got[i]["n_lines"] == 5
    assert got[100]["text"] == "header\nfooter" and got[200]["text"] is None and got[200]["n_lines"] == 0
    assert got[201]["text"] == "" and got[202]["text"] == ""


def test_line_dedup_odd_rows(spark):
    got = rows_of(lines.dedup_lines(odd_documents(spark), min_support=1, ratio=0.9))
    assert len(got) == len(ODD_TEXTS) + 2
    assert rows_of(lines.dedup_lines(empty_documents(spark))) == []
    shuffled = rows_of(lines.dedup_lines(odd_documents(spark), min_support=2, ratio=0.1))
    lines.BROADCAST_BYTES, saved = -1, lines.BROADCAST_BYTES
    try:
        again = rows_of(lines.dedup_lines(odd_documents(spark), min_support=2, ratio=0.1))
    finally:
        lines.BROADCAST_BYTES = saved
    assert sorted(map(str, again)) == sorted(map(str, shuffled))


def test_line_dedup_leaves_whole_copies(spark):
    """A group of copies above the ratio keeps its text; a footer still goes."""
    copy = "first line of a text\nsecond line of it\nfooter"
    rows = [(i, copy if i % 2 else copy.replace(" ", "  "), "h") for i in range(30)]
    rows += [(100 + i, f"own {i}\nfooter", "h") for i in range(60)]
    rows += [(200 + i, f"pair\ntext {max(i, 1)}", "p") for i in range(25)]  # one pair of copies
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for limit in (lines.BROADCAST_BYTES, -1):
        lines.BROADCAST_BYTES, saved = limit, lines.BROADCAST_BYTES
        try:
            got = {r["doc_id"]: r["text"] for r in rows_of(lines.dedup_lines(docs))}
        finally:
            lines.BROADCAST_BYTES = saved
        assert len(got) == len(rows)
        assert got[1] == "first line of a text\nsecond line of it" and got[0] == got[1].replace(" ", "  ")
        assert all(got[100 + i] == f"own {i}" for i in range(60)) and all(got[200 + i] == f"text {max(i, 1)}" for i in range(25))
    assert rows_of(lines.dedup_lines(empty_documents(spark))) == []


def test_pipeline_keeps_a_text_with_copies(spark):
    """One of a group of copies comes out of line dedup and near-dedup with its whole text."""
    import corpus_pipeline

    copy = "a text that many pages of its host have\nand that one of them is to keep"
    rows = [(i, copy, "en", "h", 0) for i in range(30)] + [(100 + i, f"own words {i} of a page like no other", "en", "h", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict((f.__name__, f) for _, f in corpus_pipeline.STAGES)
    docs = stages["drop_near_copies"](spark, corpus_pipeline.keep(stages["drop_boilerplate"](spark, docs, ""), "test-stage"), "")
    texts = [r["text"] for r in rows_of(docs)]
    assert texts.count(copy) == 1 and "" not in texts and len(texts) == 41


def test_pipeline_drops_lines_of_small_hosts(spark):
    """A footer goes on hosts of every size; a line on two pages stays, however few there are."""
    import corpus_pipeline

    sizes = [2, 3, 10, 19, 20]
    rows = [(100 * n + i, f"own {i} of {n}\nfooter\n{'on two' if i < 2 else 'alone ' + str(i)}", "en", f"h{n}", 0) for n in sizes for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in rows_of(corpus_pipeline.drop_boilerplate(spark, docs, ""))}
    for doc, text, _, source, _ in rows:
        assert got[doc] == (text if source == "h2" else text.replace("\nfooter", ""))
