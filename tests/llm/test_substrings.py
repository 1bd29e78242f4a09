"""Induced sorting against plain sorting, and repeated substrings against their definition."""

import hashlib
import random

import numpy as np
import pytest
from helpers import empty_documents, odd_documents, rows_of
from tidewatch.llm import induced, queries, substrings

SMALL = "/root/testdata/sf0.001"


def brute(rows, length=100):
    """Every string of every text, in the order of starts; rows as the partitions hold them."""
    seen, done = set(), {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)):
        text = (rows[i][1] or "").encode()
        gone = bytearray(len(text))
        for at in range(len(text) - length + 1):
            s = text[at : at + length]
            if s in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        n_spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        done[i] = (rows[i][0], len(text), sum(gone), n_spans, hashlib.sha256(kept).hexdigest())
    return list(done.values())


def in_order(rows):
    return sorted(map(repr, rows))


def digest(df):
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()]


@pytest.mark.parametrize("held, in_memory, block", [(10**6, 10**6, 65_536), (20, 10**6, 7), (3, 4, 2)])
def test_induced_sorting(monkeypatch, held, in_memory, block):
    """Order and shared prefixes, with queues in files and by recursion."""
    monkeypatch.setattr(induced, "BLOCK", block)
    rng = random.Random(held)
    for _ in range(60):
        letters = rng.choice([1, 2, 3, 5])
        some = [bytes(rng.choice([0, 97 + rng.randrange(letters)]) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 12))]
        some += [some[0] + some[-1], some[0]]
        strings, cut = induced.Strings(held, in_memory), rng.randrange(len(some) + 1)
        for part in (some[:cut], some[cut:]):
            strings.add(np.frombuffer(b"".join(part), np.uint8), np.array([len(x) for x in part], int))
        most = rng.choice([3, 100])
        got = [(int(k), int(i), int(n)) for p, shared in strings.descending(most) for k, i, n in zip(*strings.found(p), shared, strict=True)]
        every = [(k, i) for k, s in enumerate(some) for i in range(len(s))]
        assert [some[k][i:] for k, i, _ in got] == sorted((some[k][i:] for k, i in every), reverse=True)
        assert sorted((k, i) for k, i, _ in got) == every
        before = b""
        for k, i, n in got:
            now = some[k][i:]
            shared = next((j for j, (x, y) in enumerate(zip(before, now, strict=False)) if x != y), min(len(before), len(now)))
            assert n == min(shared, most)
            before = now


def test_query_against_every_string(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.QUERIES["op13_repeated_substrings"](spark, SMALL).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert in_order(got) == in_order(brute(rows)) and sum(r[2] > 0 for r in got) > 10


def planted(spark):
    """Passages cut out and put elsewhere, copies with edits, runs, null and repeated ids."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long = prose(40), prose(3000)
    texts = [f"{prose(rng.randrange(0, 30))}{passage[rng.randrange(60):]}{prose(rng.randrange(0, 30))}" for _ in range(60)]
    texts += [f"{passage}{word()} {prose(rng.randrange(3))}" for _ in range(60)]
    texts += [long, long[:4000] + "é" + long[4000:], long[100:], passage[:99], passage[:100], passage, "x" * 3000, "ab" * 700, "x" * 99, None, ""]
    rows = [(None if rng.random() < 0.1 else rng.choice([i, i, 7]), t) for i, t in enumerate(texts)]
    rows += rows[:5]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("many", [2, 100])
def test_planted_repeats(spark, monkeypatch, many):
    monkeypatch.setattr(substrings, "MANY", many)
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 5000)
    docs = planted(spark)
    rows = [tuple(r) for r in docs.collect()]
    assert in_order(digest(substrings.cut_repeats(docs))) == in_order(brute(rows))


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(9)
    texts = [bytes(rng.choice(b"abcd") for _ in range(n)) for n in (50, 300, 5000, 2000)] + [b"z" * 4000]
    whole = [np.concatenate(c) for c in zip(*substrings._text_anchors(texts, 100), strict=True)]
    monkeypatch.setattr(substrings, "SLICE_BYTES", 400)
    parts = [np.concatenate(c) for c in zip(*substrings._text_anchors(texts, 100), strict=True)]
    rows = lambda found: sorted(zip(*(c.tolist() for c in found), strict=True))
    assert rows(whole) == rows(parts)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert in_order(digest(substrings.cut_repeats(docs))) == in_order(brute(rows))
    assert rows_of(substrings.cut_repeats(empty_documents(spark))) == []
