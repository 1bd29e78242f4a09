import re

import numpy as np
import pytest
from helpers import ODD_TEXTS, empty_documents, odd_documents, rows_of
from pyspark.sql import functions as F
from tidewatch.llm import language, quality

SMALL = "/root/testdata/sf0.01"


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)} if len(words) < 4000 else None
    return [
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        sum(x in lines[:i] for i, x in enumerate(lines)), None if covered is None else len(covered),
    ]


@pytest.mark.parametrize("text", [*ODD_TEXTS, "a b c a b c d", "a b c x a b c a b c", "## ## ##\n## ##\n## ##", "é ü é ü é ü é"])
def test_statistics(text):
    got, _ = quality.statistics((text or "").encode())
    for a, b in zip(got, brute_statistics(text), strict=True):
        assert b is None or a == b


def test_repeat_words_of_long_texts():
    words = [b"%d" % (i % 1_500_000) for i in range((1 << 21) + 5)]
    n = len(words) - 1_500_000
    assert quality.repeat_words(words) == (2 * n, 1_500_000)


def test_forest_isolates_outliers():
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.normal(0, 1, (3000, 4)), rng.normal(9, 0.5, (10, 4))])
    scores = quality.Forest.grow(rows).score(rows)
    assert scores[3000:].min() > np.quantile(scores[:3000], 0.99)


def test_calibrate():
    assert quality.calibrate([]) == quality.calibrate([(500, 1, 10)]) == 1.0
    assert quality.calibrate([(400, 1, 1000), (700, 0, 50)]) == 0.7
    assert quality.calibrate([(400, 1, 990), (600, 1, 10), (650, 0, 50)], max_loss=0.005) == 0.65


def test_judge_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0, 0), (2, None, 0), (None, 1, 0), (5, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = rows_of(quality.judge(odd_documents(spark), labels))
    assert len(got) == len(ODD_TEXTS) + 2
    assert all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 50)
    assert rows_of(quality.judge(empty_documents(spark), labels)) == []
    assert len(rows_of(quality.judge(odd_documents(spark), labels.where("false")))) == len(got)


def test_judge_keeps_good_documents(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    got = quality.judge(docs, labels).join(labels, "doc_id").where("not base_failed")
    good = got.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good >= 0.99


def test_language(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    model = language.learn(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    assert model.langs == ["de", "en", "es", "fr"]
    got = language.predict(held, model).where("lang_pred <> 'und'")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_filter_matches_sets():
    """What the filter returns covers the sets it was made of."""
    texts = ["the cat sat on the mat", "der hund lief über den hof"]
    sets = []
    for t in texts:
        code, whole, _ = language.grams([language._padded(t)])
        sets.append(set(code[whole].tolist()))
    masks = np.zeros((1, 1 << language.CELL_BITS), np.uint64)
    for i, s in enumerate(sets):
        for j in range(len(language.HASHES)):
            masks[0, language.cells(np.array(sorted(s), np.uint32), j)] |= np.uint64(1 << i)
    model = language.Model(["en", "de"], masks)
    hits, n = model.hits([language._padded(t) for t in texts])
    assert hits[0, 0] == n[0] and hits[1, 1] == n[1] and hits[0, 1] < n[0] / 2
    assert [d[0] for d in model.decide([*texts, None, "", "123 !?", "a"])] == ["en", "de", "und", "und", "und", "en"]


def test_parts_give_the_same(monkeypatch):
    """A text cut into parts has the n-grams, and the language, of the whole text."""
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abc é"), 3000)), "abc", "b c" * 500]
    masks = rng.integers(0, 4, (1, 1 << language.CELL_BITS)).astype(np.uint64)
    model = language.Model(["x", "y"], masks)
    want = model.decide(texts)
    hits = model.hits([language._padded(texts[0])])
    monkeypatch.setattr(language, "CHUNK_BYTES", 64)
    parts = language._parts(language._padded(texts[0]))
    assert len(parts) > 40
    cut = [model.hits([p]) for p in parts]
    assert sum(c[1][0] for c in cut) == hits[1][0] and (sum(c[0][0] for c in cut) == hits[0][0]).all()
    assert model.decide(texts) == want


def test_language_odd_rows(spark):
    docs = odd_documents(spark)
    model = language.learn(docs)
    got = rows_of(language.predict(docs, model))
    assert len(got) == len(ODD_TEXTS) + 2 and all(r["lang_pred"] in ("en", "de", "und") and 0 <= r["score"] <= 1 for r in got)
    assert all((r["lang_pred"] == "und") == (not language.has_letter(r["text"])) for r in got)
    none = language.learn(empty_documents(spark))
    assert none.langs == [] and {r["lang_pred"] for r in rows_of(language.predict(docs, none))} == {"und"}
    assert rows_of(language.predict(empty_documents(spark), model)) == []


def test_many_languages():
    langs = [f"l{i:03}" for i in range(130)]
    masks = np.zeros((3, 1 << language.CELL_BITS), np.uint64)
    code, whole, _ = language.grams([language._padded("some words")])
    for j in range(len(language.HASHES)):
        masks[2, language.cells(code[whole], j)] |= np.uint64(1 << 1)
    assert language.Model(langs, masks).decide(["some words"])[0] == ("l129", 1.0)
