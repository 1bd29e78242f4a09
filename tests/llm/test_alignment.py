"""Cross-tokenizer alignment against a plain count of every link."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from helpers import empty_documents, odd_documents, rows_of
from tidewatch.llm import alignment, packing, queries
from tokenizers import Tokenizer

SMALL = "/root/testdata/sf0.001"


def brute(rows):
    """{row number: result} with the libraries the contract names, link by link."""
    a_coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_coder.encode_special_tokens = True
    b_coder = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    names = packing._byte_names()
    per, counts = [], Counter()
    for _, text in rows:
        links, groups = Counter(), []
        a = a_coder.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_coder.encode(text) if text else []
        a_bytes = [bytes(names[c] for c in a_coder.id_to_token(i)) for i in a]
        b_bytes = [
            bytes([int(b_coder.id_to_piece(i)[3:5], 16)]) if b_coder.is_byte(i) else b_coder.id_to_piece(i).replace("▁", " ").encode()
            for i in b
        ]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            per.append((0, 0, 0, links, ""))
            continue
        i = j = at_a = at_b = 0
        now_a, now_b = [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                now_a.append(a[i])
                at_a += len(a_bytes[i])
                i += 1
            else:
                now_b.append(b[j])
                at_b += len(b_bytes[j])
                j += 1
            if at_a == at_b:
                groups.append((now_a, now_b))
                now_a, now_b = [], []
        for x, y in groups:
            links.update((p, q) for p in x for q in y)
        counts.update(links.keys())
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        per.append((len(a), len(b), len(groups), links, hashlib.sha256(written.encode()).hexdigest()))
    highest = defaultdict(int)
    for (p, _), n in counts.items():
        highest[p] = max(highest[p], n)
    return [
        (doc, n_a, n_b, n_groups, sum(links.values()), sum(n for x, n in links.items() if counts[x] == highest[x[0]]),
         sum(n * counts[x] for x, n in links.items()), sha)
        for (doc, _), (n_a, n_b, n_groups, links, sha) in zip(rows, per, strict=True)
    ], counts


def in_order(rows):
    return sorted(map(repr, rows))


def test_query_against_every_link(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.QUERIES["op12_token_alignment"](spark, SMALL).collect()]
    assert in_order(got) == in_order(brute(rows)[0])


def test_many_chunks_and_odd_rows(spark):
    docs = odd_documents(spark, [
        None, "", " ", "  two  blanks ", "▁ is no space", "one", "Über déjà vu 中文 text", "<s> <0x41> </s> <|endoftext|>",
        "same words", "same words", "nul \0 tab\t\n\n\n", "word " * 3000, "中" * 500, "a" * 5000, " " * 60_000, "​﻿①ﬁ",
    ])
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    expected, counts = brute(rows)
    for size in (1, 50, 1_000_000):
        got = [tuple(r)[:8] for r in alignment.align(docs, chunk_records=size).collect()]
        assert in_order(got) == in_order(expected)
    pairs = {(r["a_id"], r["b_id"]): r["n_docs"] for r in alignment.pair_counts(docs).collect()}
    assert pairs == dict(counts)
    assert rows_of(alignment.align(empty_documents(spark))) == []


def test_runs_merge_in_levels(monkeypatch):
    monkeypatch.setattr(alignment, "FAN_IN", 3)
    monkeypatch.setattr(alignment, "BLOCK", 7)
    monkeypatch.setattr(alignment, "HELD_BYTES", 100)
    rng = np.random.default_rng(5)
    spool, places, total = alignment._Spool(), [], Counter()
    for _ in range(40):
        pairs = np.unique(rng.integers(0, 200, rng.integers(1, 60)))
        counts = rng.integers(1, 9, len(pairs))
        places.append(spool.add(alignment._run(pairs, counts)))
        total.update(dict(zip(pairs.tolist(), counts.tolist(), strict=True)))
    pairs, counts = spool.count(places)
    assert dict(zip(pairs.tolist(), counts.tolist(), strict=True)) == total and (np.diff(pairs) > 0).all()


def test_wide_groups(monkeypatch):
    """Groups beyond the bound give the same links as those below it."""
    coder = alignment.coders(packing.default_vocabulary(), alignment.default_pieces())
    texts = ["Über déjà vu 中文字符 ①②③ text", "naïve façade", "🙂🙂🙂 emoji"]
    _, wide = alignment.align_texts(texts, coder)
    monkeypatch.setattr(alignment, "WIDE_GROUP", 0)
    _, narrow = alignment.align_texts(texts, coder)
    assert all((x == y).all() for x, y in zip(wide, narrow, strict=True))
