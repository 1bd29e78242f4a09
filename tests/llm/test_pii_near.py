import random
import re

import numpy as np
import pytest
from helpers import ODD_TEXTS, empty_documents, odd_documents, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from tidewatch.llm import near, pii

SMALL = "/root/testdata/sf0.01"
# The rules of the contract, as plain patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def brute_spans(text):
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in pii.CARD.finditer(text):
        d = re.sub("[ -]", "", m.group())
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in pii.PHONE.finditer(text) if 10 <= len(re.findall("[0-9]", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1.@+-() \n0925é", max_size=40))
def test_rules(text):
    assert pii.rule_spans(text) == brute_spans(text)


def test_rules_on_long_runs():
    assert pii.rule_spans("1" * 300_000) == [] and pii.rule_spans("a" * 300_000 + "@") == []
    assert pii.rule_spans("a@" * 50_000) == [] and pii.rule_spans("1." * 100_000)[:1] == [(1, 0, 7)]
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_gradient():
    rng = np.random.default_rng(0)
    model = pii.Tagger.fresh(3)
    rows, tags = rng.integers(0, pii.SYMBOLS, (3, 7)), rng.integers(0, pii.TAGS, (3, 7))
    _, grad = model.gradient(rows, tags)
    for name, w in model.weights.items():
        place = tuple(int(rng.integers(0, n)) for n in w.shape) if name != "embed" else (int(rows[0, 0]), 1)
        saved, ends = w[place], []
        for step in (1e-5, -1e-5):
            w[place] = saved + step
            ends.append(model.gradient(rows, tags)[0])
        w[place] = saved
        assert abs((ends[0] - ends[1]) / 2e-5 - grad[name][place]) < 1e-5, name


def test_windows_cover_all_anchors():
    text = "x" * 300 + "12" + "y" * 50 + "a@b" + "9" * 400 + "z"
    regions = pii.window_starts(text)
    for m in re.finditer("[0-9@]", text):
        assert any(s <= m.start() < s + pii.WINDOW for starts in regions for s in starts)
    ones = [[np.full(pii.WINDOW, 2 * (i % 4) + 2) for i in range(len(r))] for r in regions]
    for kind, a, b in pii.reconcile(text, regions, [t for r in ones for t in r]):
        assert 0 <= kind < 4 and a < b <= len(text)


def test_find(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    model = pii.learn(docs)
    found = {r["doc_id"]: r["spans"] for r in rows_of(pii.find(docs, model))}
    assert len(found) == len(texts)
    added = 0
    for doc, text in texts.items():
        base = [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in found[doc] if s["base"]]
        assert base == brute_spans(text)
        added += sum(not s["base"] for s in found[doc])
    assert added < 0.02 * len(texts)
    # held-out accuracy: what the network finds by itself
    right = wrong = missed = 0
    for text in [t for t in texts.values() if pii.ANCHOR.search(t)][:150]:
        regions = pii.window_starts(text)
        own = set(pii.reconcile(text, regions, pii._decode_all(text, regions, model)))
        base = set(brute_spans(text))
        right, wrong, missed = right + len(own & base), wrong + len(own - base), missed + len(base - own)
    assert right > 8 * (wrong + missed)


def test_find_odd_rows(spark):
    docs = odd_documents(spark, [*ODD_TEXTS, "mail a.b@c.de or 10.0.0.1, call +1 (555) 123-4567, pay 4111 1111 1111 1111"])
    got = rows_of(pii.digest(pii.find(docs)))
    assert len(got) == len(ODD_TEXTS) + 3
    last = next(r for r in got if r["doc_id"] == len(ODD_TEXTS))
    assert [last[f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1]
    assert rows_of(pii.digest(pii.find(empty_documents(spark)))) == []


# --- near copies ---------------------------------------------------------------------


def shingles(text):
    w = text.split()
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def jaccard(a, b):
    a, b = set(shingles(a)), set(shingles(b))
    return len(a & b) / len(a | b) if a | b else 0.0


def _corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for size in [6, 9, 12, 20, 40, 120, 300, 1200]:
        for _ in range(4):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for _ in range(3):
                copy = list(base)
                for _ in range(max(1, size // 150)):
                    copy[rng.choice([0, len(copy) - 1, rng.randrange(len(copy))])] = word()
                texts.append(" ".join(copy))
            texts.append("  ".join(base))  # the same words
    # a large group, all near one text but not all near each other; and texts that share a passage only
    base = [word() for _ in range(200)]
    for _ in range(60):
        copy = list(base)
        copy[rng.randrange(200)] = word()
        copy[rng.randrange(200)] = word()
        texts.append(" ".join(copy))
    texts += [" ".join([passage, *(word() for _ in range(60))]) for _ in range(40)]
    return texts


@pytest.mark.parametrize("paired,group", [(32, 256), (1, 5), (1, 256), (1000, 7)])
def test_near_groups(spark, monkeypatch, paired, group):
    """However the comparisons are dealt, classes are those of all pairs."""
    monkeypatch.setattr(near, "PAIRED", paired)
    monkeypatch.setattr(near, "GROUP", group)
    texts = _corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = rows_of(near.near_groups(df))
    cls = {r["doc_id"]: r["class_id"] for r in got}
    assert len(got) == len(texts)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(texts):
        for j in range(i):
            if a.split() == texts[j].split() or jaccard(a, texts[j]) >= near.SIMILARITY:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert cls == {i: root(i) for i in range(len(texts))}
    sizes = {c: sum(x == c for x in cls.values()) for c in cls.values()}
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def brute_similarity(a, b):
    n, m = len(a), len(b)
    row = [0] * (m + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[m] / (n + m - row[m])


def test_alignment():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = rng.permutation(60)[: rng.integers(5, 60)]
        b = a.copy()
        for _ in range(rng.integers(0, 6)):
            i = rng.integers(0, len(b))
            b = np.concatenate([b[:i], b[i + 1 :], b[i : i + 1]]) if rng.random() < 0.4 else np.delete(b, i) if len(b) > 3 else b
        want = brute_similarity(a.tolist(), b.tolist())
        got = near.similarity(a.astype(np.uint64), b.astype(np.uint64))
        assert got == pytest.approx(want) if want >= near.SIMILARITY else got == 0


def test_occurrence_labels_and_long_texts():
    hashes = near._WordHashes()
    labels = near.kmers([b"x"] * 1000, hashes)
    assert len(labels) == 996 == len(set(labels.tolist()))
    assert len(near.sketch(np.arange(3_000_000, dtype=np.uint64))) == 28
    assert len(near.sketch(near.kmers([], hashes))) == 0 and len(near.kmers([b"a", b"b"], hashes)) == 1


def test_near_odd_rows(spark):
    docs = odd_documents(spark)
    got = rows_of(near.near_groups(docs))
    assert len(got) == len(ODD_TEXTS) + 2
    kept = near.near_dedup(docs)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept.count() == sum(r["kept"] for r in got) == len({tuple((t or "").encode().split()) for t in ODD_TEXTS})
    assert rows_of(near.near_groups(empty_documents(spark))) == [] and near.near_dedup(empty_documents(spark)).count() == 0


def test_near_rows_that_share_an_id(spark):
    """Near copies go by row: those under one id, or under none, as those under other ids."""
    texts = [" ".join(f"{group}{i}" for i in range(60)) for group in "abc"]
    rows = [(7, f"{texts[0]} end{i}") for i in range(4)] + [(7, "other words than those of the group")]
    rows += [(None, f"{texts[1]} end{i}") for i in range(6)] + [(None, f"{texts[1]}  end0"), (None, None), (None, "")]
    rows += [(8, f"{texts[2]} end0"), (8, "more words that no other text has"), (9, f"{texts[2]} end1"), (9, f"{texts[2]} end2")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = rows_of(near.near_dedup(docs.repartition(3)))
    # one of each class: three groups, two texts like no other, and one without words
    assert sum(r["kept"] for r in rows_of(near.near_groups(docs))) == len(got) == 6
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:2]) for r in got) == [(0, ""), (0, "b0"), (7, "a0"), (7, "ot"), (8, "c0"), (8, "mo")]


def test_a_block_links_its_classes_once():
    """Texts of one class in the end give a tree of links, not all pairs."""
    hashes = near._WordHashes()
    words = [f"w{i}".encode() for i in range(200)]
    texts = [[*words, f"end{i}".encode()] for i in range(40)]
    labels = [near.kmers(t, hashes) for t in texts]
    block = near._Block(near.SIMILARITY)
    for i in range(30):
        block.add(i, i, labels[i], np.array([7, 8]))
    block.close()
    found = [link for i, m in enumerate(block.members) for link in block.links(7, m, i)]
    assert len(found) == 29
    found += [link for i in range(30, 40) for link in block.links(7, (i, i, labels[i], np.array([7, 8])))]
    assert len(found) == 39
    reached = {0}
    for _ in found:
        reached |= {x for link in found if reached & set(link) for x in link}
    assert reached == set(range(40))
    assert not list(block.links(8, (40, 40, labels[0], np.array([7, 8]))))  # the bucket of 7 compares them


def test_repeated_rows_are_one_text(spark, monkeypatch):
    """Rows that repeat id and words are looked up as one text, however many they are."""
    words = [f"w{i}" for i in range(120)]
    copies = [" ".join(words), " ".join([*words[:60], "x", *words[61:]]), " ".join([*words[:30], "y", *words[31:]])]
    rows = [(None, copies[0])] * 3000 + [(1, copies[1]), (2, copies[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen, whole = [], near._texts

    def counted(*args):
        out = whole(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(near, "_texts", counted)
    got = near.near_groups(docs).collect()
    assert seen == [3] and len(got) == 3002
    assert {r["class_size"] for r in got} == {3002} and sum(r["kept"] for r in got) == 1
    assert {r["class_id"] for r in got} == {1}
