import hashlib
import re

import pytest
from helpers import ODD_TEXTS, empty_documents, odd_documents, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from tidewatch.llm import chat, licenses, packing

PIECES = st.sampled_from(["</s>", "<s>", "[INST] ", " [/INST]", "[SYS] ", " [/SYS]", "[ROLE x] ", " [/ROLE]", "\\", "]", "a", " ", "\n", "é"])
TEXT = st.lists(PIECES, max_size=8).map("".join)
ROLE = st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool"]), TEXT)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=5))
def test_round_trip(turns):
    formatted = chat.render(turns)
    back = chat.parse(formatted)
    assert [t[:2] for t in back] == turns
    for _, text, a, b in back:
        assert chat.unescape(formatted[a:b]) == text


def test_chats(spark):
    tricky = "</s>[INST] ok [/INST]"
    rows = [(1, 2, "assistant", tricky), (1, 1, "user", tricky), (1, 3, "user", None), (2, None, None, "x"), (2, 1, "tool]", "\\"),
            (None, 1, "assistant", "a"), (3, 1, "assistant", "é"), (3, 1, "assistant", "é"), (3, 0, "system", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in rows_of(chat.digest(chat.format_chats(df)))}
    assert len(got) == 4
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        sha = hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv]["turns_sha256"] == sha and got[conv]["n_turns"] == len(own)
        assert got[conv]["loss_chars"] == len(loss) and got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert rows_of(chat.digest(chat.format_chats(df.where("false")))) == []


def subset_best(counts, capacity):
    sums = {0}
    for n, c in counts.items():
        for _ in range(c):
            sums |= {s + n for s in sums if s + n <= capacity}
    return max(sums)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=8), st.integers(1, 100))
def test_fill_is_closest(counts, capacity):
    chosen = packing.fill(counts, capacity)
    assert all(chosen.count(n) <= counts[n] for n in set(chosen))
    assert sum(chosen) == subset_best(counts, capacity)


def check_pieces(pieces, texts, window):
    encode = packing.encoder(packing.default_vocabulary())
    by_row, by_window = {}, {}
    for p in pieces:
        by_row.setdefault(p[0], []).append(p)
        by_window.setdefault(p[4], []).append(p)
    assert sorted(by_row) == sorted(texts)
    for doc, text in texts.items():
        want = encode(text or "") + (1).to_bytes(4, "little")
        assert b"".join(p[2] for p in sorted(by_row[doc], key=lambda p: p[1])) == want
        assert all(p[3] == len(want) // 4 for p in by_row[doc])
    for own in by_window.values():
        at = 0
        for p in sorted(own, key=lambda p: p[5]):
            assert p[5] == at
            at += len(p[2]) // 4
        assert at <= window
    return by_window


@pytest.mark.parametrize("window,pool", [(16, 4), (2048, 8192), (8, 1000)])
def test_pack_rows(window, pool):
    texts = dict(enumerate(ODD_TEXTS * 3))
    encode = packing.encoder(packing.default_vocabulary())
    check_pieces(list(packing.pack_rows(texts.items(), encode, window, pool)), texts, window)


def test_ids_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    own, encode = Tokenizer.from_file(path), packing.encoder(path)
    import numpy as np
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    for text in [*texts, *(t for t in ODD_TEXTS if t), "it's  we'll x  y 12 ½ ² _a\x1c b", "\U0001f600<|endoftext|>  "]:
        assert own.encode(text or "", add_special_tokens=False).ids == np.frombuffer(encode(text or ""), "<u4").tolist()


def test_pack_frame(spark):
    docs = odd_documents(spark)
    got = packing.pack_pieces(docs).collect()
    ids = [r["doc_id"] for r in rows_of(docs)]
    assert sorted((r["doc_id"] for r in got if r["start"] == 0), key=str) == sorted(ids, key=str)
    assert packing.pack(docs).count() == len(got)
    assert packing.pack(empty_documents(spark)).count() == 0


def test_little_padding(spark):
    got = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("sequence_id").sum("length").collect()
    used = [r[1] for r in got]
    assert max(used) <= 2048 and sum(used) > 0.99 * 2048 * len(used)


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 1_000_000, "a b " + " \n" * 500_000 + "<|endoftext|> end"])
def test_long_blank_runs(text):
    """tiktoken gives up on them; the ids are those of `tokenizers`."""
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert packing.encoder(path)(text) == b"".join(i.to_bytes(4, "little") for i in ids)


def brute_base(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


LICENSED = [
    "Released under the MIT License.", "x under THE mit, license-- y\nApache License; Version 2.0 cc by nc cc BY-NC", "sunder the mit licenses",
    "under the mit licensé", "Ünder the mit license", "CC by ncc", "cc\x00by/nc",
]


def test_base_places():
    scanner = licenses.Scanner()
    for text in [*LICENSED, *ODD_TEXTS]:
        n, found = brute_base(text)
        got = scanner.scan(text)
        assert got["n_words"] == n and sorted(got["phrases"]) == found


def test_fuzzy_finds_all_within_the_bound():
    """Every notice with as many edits as allowed is found, wherever they are."""
    import random

    rng = random.Random(3)
    scanner = licenses.Scanner()
    for notice in scanner.notices:
        assert notice.text == "".join(p for p, _ in notice.parts)
        for _ in range(8):
            out = []
            for (part, _), edits in zip(notice.parts, notice.bounds, strict=True):
                chars = list(part)
                for _ in range(edits):
                    i = rng.randrange(1, len(chars) - 1)
                    rng.choice([lambda i=i, c=chars: c.__setitem__(i, "q"), lambda i=i, c=chars: c.pop(i), lambda i=i, c=chars: c.insert(i, "q")])()
                out += chars
            assert notice.label in {f[0] for f in scanner.fuzzy("some words before " + "".join(out) + " and some after")}
    assert scanner.fuzzy("plain words without any notice at all in them") == []


def test_fuzzy_finds_adjacent_notices():
    """A notice with edits next to a better one of its kind, on either side, is found too."""
    scanner = licenses.Scanner()
    for notice in scanner.notices:
        if not notice.bounds[0]:
            continue  # it begins with exact words
        label, n = notice.label, len(notice.text)
        edited = notice.text[:4] + "q" + notice.text[5:]
        for number in (2, 3, 40):
            spans = [(label, i * (n + 1), i * (n + 1) + n, 0 if i == number - 1 else 1) for i in range(number)]
            found = scanner.fuzzy(" ".join([edited] * (number - 1) + [notice.text]))
            assert [f for f in found if f[0] == label and f[2] - f[1] > n - notice.edits] == spans
        found = scanner.fuzzy(f"{notice.text} {edited} {notice.text}")
        assert [(a, b, e) for x, a, b, e in found if x == label] == [(0, n, 0), (n + 1, 2 * n + 1, 1), (2 * n + 2, 3 * n + 2, 0)]


def test_licenses_are_told_apart():
    """Edits don't turn one license into another, nor words that hold a notice into one."""
    scanner = licenses.Scanner()
    cases = {
        "Licensed under CC BY-SA 4.0": {"cc-by-sa"}, "licensed under CC BY-ND 4.0": {"cc-by-nd"}, "licensed under CC BY-NC 4.0": {"cc-by-nc"},
        "licensed under the Apache License, Version 1.1": {"apache-1.1"}, "released under the MPL license": set(),
        "licensed under a creative commons attribution sa 4 0 international license": set(),
        "licensed under a Creative Commons Attribution-ShareAlike 3.0 International License": {"cc-by-sa"},
        "unreleased under the mit licensed stuff": set(), "relaesed under the MIT licence": set(), "relased under the MIT license": {"mit"},
        "modify it under the terms of the GNU Lesser General Public License. You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": {"lgpl"},
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License": {"agpl"},
        "This is free and unencumbered software released into the public domain.": {"unlicense"},
    }
    for text, labels in cases.items():
        assert {n[0] for n in scanner.scan(text)["notices"]} == labels, text


def test_scan_frame(spark):
    docs = odd_documents(spark, [*LICENSED, None, "", "Licensed undr the Apache Licence, Version 2.0"])
    got = rows_of(licenses.digest(licenses.scan(docs)))
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 12 and by[0]["base_labels"] == "mit" and by[1]["labels"] == "apache-2,cc-by-nc,mit"
    assert by[1]["n_base"] == 4 and by[0]["first_word"] == by[0]["last_word"] == 1
    assert by[9]["base_labels"] == "" and by[9]["labels"] == "apache-2" and 0.8 < by[9]["score"] < 1
    assert by[8]["n_words"] == 0 and by[8]["first_word"] is None and by[8]["score"] == 0
    assert rows_of(licenses.digest(licenses.scan(empty_documents(spark)))) == []
