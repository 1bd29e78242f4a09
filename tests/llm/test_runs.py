"""Periodic runs against their definition."""

import hashlib
import random
import re
import zlib

import pytest
from helpers import empty_documents, odd_documents, rows_of
from tidewatch.llm import queries, runs

SMALL = "/root/testdata/sf0.001"


def brute_runs(words):
    """Every stretch with its smallest period, by extending from each start."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if plant and h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(found), *(best[:3] if best else (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def in_order(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_of_random_words(letters):
    rng = random.Random(letters)
    texts = [[]]
    for _ in range(120):
        text = []
        while len(text) < rng.randrange(1, 90):
            block = [rng.randrange(letters) for _ in range(rng.randrange(1, 9))]
            text += block * rng.choice([1, 1, 2, 4, 5, 9])
        texts.append(text)
    assert runs.runs_of(texts) == [brute_runs(t) for t in texts]
    assert [runs.runs_of([t])[0] for t in texts[:20]] == [brute_runs(t) for t in texts[:20]]


def test_many_places_with_other_left_words():
    """One passage after many different words, and one word over and over."""
    text = []
    for i in range(300):
        text += [1000 + i, 1, 2, 3, 4, 5, 6, 7]
    assert runs.runs_of([text, [1, 2] * 3000, [5] * 100_000]) == [[], [(0, 6000, 2)], [(0, 100_000, 1)]]


def test_query_against_definition(spark):
    got = [tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, SMALL).collect()]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert in_order(got) == in_order(brute_digest(*d) for d in docs)
    assert sum(r[1] > 0 for r in got) > 5


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = [tuple(r) for r in runs.digest(runs.find_runs(docs)).collect()]
    assert in_order(got) == in_order(brute_digest(r["doc_id"], r["text"], plant=False) for r in docs.select("doc_id", "text").collect())
    assert rows_of(runs.digest(runs.find_runs(empty_documents(spark)))) == []
    row = next(r for r in runs.find_runs(docs).collect() if r["n_words"] == 3000)
    assert [tuple(r) for r in row["runs"]] == [(0, 3000, 1)] and row["collapsed"] == "word"
