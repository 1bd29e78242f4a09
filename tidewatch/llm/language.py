"""Language identification with bit-sliced Bloom filters of n-grams.

All languages share one Bloom filter whose cells are bit sets over the languages, so one
look at the cells of an n-gram returns every language that contains it. A text's hits per
language are counted bit by bit, corrected for the hits that the filter's fill alone would
give, and the language with most decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import keep, lean

UNKNOWN = "und"
GRAM = 4  # bytes
CELL_BITS = 20
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: An n-gram is of a language when it makes up this share of the language's n-grams, which
#: bounds a language's n-grams to one over it ...
MIN_RATE = 1e-5
#: ... and at least this part of its rate in the language where it is most frequent.
MIN_PART = 0.1
#: Bytes of text looked at in one go; a longer text is cut into overlapping parts.
CHUNK_BYTES = 1024 * 1024


def _letters() -> np.ndarray:
    """ASCII letters and bytes beyond ASCII stay, zero separates texts, all else is a space."""
    out = np.full(256, 32, np.uint8)
    for b in [0, *range(97, 123), *range(128, 256)]:
        out[b] = b
    return out


_LETTERS = _letters()


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _padded(text: str) -> bytes:
    return b" " + text.lower().encode().replace(b"\0", b" ") + b"  \0"


def _parts(padded: bytes) -> list[bytes]:
    """A padded text in parts that hold each of its windows once."""
    if len(padded) <= 2 * CHUNK_BYTES:
        return [padded]
    return [padded[i : i + CHUNK_BYTES + GRAM - 1] + b"\0" for i in range(0, len(padded), CHUNK_BYTES)]


def grams(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All 4-byte windows of padded texts, whether each is an n-gram, and where texts begin."""
    flat = _LETTERS[np.frombuffer(b"".join(texts) + b"\0\0\0", np.uint8)]
    a, b, c, d = (flat[i : len(flat) - 3 + i] for i in range(4))
    code = a.astype(np.uint32) << 24 | b.astype(np.uint32) << 16 | c.astype(np.uint32) << 8 | d
    whole = (a != 0) & (b != 0) & (c != 0) & (d != 0) & (code != 0x20202020)
    starts = np.cumsum([0, *map(len, texts[:-1])])
    return code, whole, starts


def cells(code: np.ndarray, j: int) -> np.ndarray:
    """The cells of n-grams under hash j."""
    return ((code.astype(np.uint64) + np.uint64(1)) * np.uint64(HASHES[j]) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


@dataclass
class Model:
    """`masks[s][cell]`: which of the languages 64 s to 64 s + 63 have the cell set."""

    langs: list[str]
    masks: np.ndarray

    def __post_init__(self):
        fill = [np.mean(self.masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(self.langs))]
        self.chance = np.array(fill) ** len(HASHES)

    def hits(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) n-grams found in each language; n-grams of each text."""
        code, whole, starts = grams(texts)
        n = np.add.reduceat(whole.astype(np.int64), starts)
        out = np.zeros((len(texts), len(self.langs)))
        for s, masks in enumerate(self.masks):
            found = masks[cells(code, 0)]
            for j in range(1, len(HASHES)):
                found &= masks[cells(code, j)]
            found[~whole] = 0
            for i in range(64 * s, min(64 * s + 64, len(self.langs))):
                out[:, i] = np.add.reduceat(found >> np.uint64(i % 64) & np.uint64(1), starts)
        return out, n

    def _decide(self, parts: list[tuple[int, bytes]], out: list[tuple[str, float]]) -> None:
        """Set the language of the texts whose parts (number, bytes) these are."""
        owners, row = np.unique([i for i, _ in parts], return_inverse=True)
        hits, n = np.zeros((len(owners), len(self.langs))), np.zeros(len(owners))
        for a in range(0, len(parts), 1 if len(parts) > len(owners) else len(parts)):
            some = slice(a, a + 1) if len(parts) > len(owners) else slice(None)
            part_hits, part_n = self.hits([p for _, p in parts[some]])
            np.add.at(hits, row[some], part_hits)
            np.add.at(n, row[some], part_n)
        n = np.maximum(n, 1)[:, None]
        real = np.clip((hits - n * self.chance) / np.maximum(1 - self.chance, 1e-9) / n, 0, 1)
        best = real.argmax(1)
        for i, b, share in zip(owners, best, real, strict=True):
            out[i] = (self.langs[b], float(share[b]))

    def decide(self, texts: Sequence[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; the score is the share of its n-grams found."""
        out = [(UNKNOWN, 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        waiting: list[tuple[int, bytes]] = []
        size = 0
        for i in known:
            parts = _parts(_padded(texts[i]))
            waiting += [(i, p) for p in parts]
            size += sum(map(len, parts))
            if size >= CHUNK_BYTES or i == known[-1]:
                self._decide(waiting, out)
                waiting, size = [], 0
        return out


def _counts(batches):
    """(lang, gram, n) of the partition's texts."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merge(lang):
        code, n = (np.concatenate(x) for x in zip(*held[lang], strict=True))
        unique, place = np.unique(code, return_inverse=True)
        held[lang] = [(unique, np.bincount(place, n, len(unique)).astype(np.int64))]

    def count(lang, texts):
        code, whole, _ = grams(texts)
        held.setdefault(lang, []).append(np.unique(code[whole], return_counts=True))
        if len(held[lang]) >= 16:
            merge(lang)

    for batch in batches:
        waiting: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            for part in _parts(_padded(text.as_py())):
                waiting.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part)
                if sizes[lang] >= CHUNK_BYTES:
                    count(lang, waiting.pop(lang))
                    sizes[lang] = 0
        for lang, texts in waiting.items():
            count(lang, texts)
    for lang in list(held):
        merge(lang)
        code, n = held.pop(lang)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang]).take(pa.array(np.zeros(len(code), np.int64))), pa.array(code.astype(np.int64)), pa.array(n)],
            names=["lang", "gram", "n"],
        )


def learn(docs: DataFrame, min_rate: float = MIN_RATE, min_part: float = MIN_PART) -> Model:
    """A model of all rows of `docs` with a text and a lang.

    N-grams are counted per task and added up; each language's share of an n-gram decides
    whether it belongs to it. Only the finished filter comes to the driver: at most
    2 ** CELL_BITS cells for each 64 languages. Rows with a null text or lang teach
    nothing; without any row the model knows no language.
    """
    taught = docs.select("text", "lang").where("text is not null and lang is not null")
    counts = taught.mapInArrow(lean(_counts), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = keep(counts, "language-grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = sorted(r["lang"] for r in totals.select("lang").collect())
    rated = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total")).where(F.col("rate") >= min_rate)
    most = rated.groupBy("gram").agg(F.max("rate").alias("most"))
    belongs = rated.join(most, "gram").where(F.col("rate") >= min_part * F.col("most")).select("lang", "gram")
    number = {lang: i for i, lang in enumerate(langs)}

    def place(batches):
        for batch in batches:
            index = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            code = batch.column(1).to_numpy().astype(np.uint32)
            at = np.concatenate([cells(code, j) for j in range(len(HASHES))])
            bit = np.left_shift(np.uint64(1), (index % 64).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(index // 64, len(HASHES))), pa.array(at), pa.array(np.tile(bit, len(HASHES)))],
                names=["slice", "cell", "mask"],
            )

    placed = belongs.mapInArrow(lean(place), "slice long, cell long, mask long")
    filled = placed.groupBy("slice", "cell").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    masks = np.zeros(((len(langs) + 63) // 64, 1 << CELL_BITS), np.uint64)
    masks[filled.column("slice").to_numpy(), filled.column("cell").to_numpy()] = filled.column("mask").to_numpy().view(np.uint64)
    return Model(langs, masks)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of `docs` with `lang_pred` and `score`, from the whole text alone.

    A text that is null or has no letter gives `und` with score 0, as does a model that
    knows no language. Of equal languages the first by name is taken. Input columns named
    lang_pred or score are replaced, other columns stay; an empty table gives an empty one.
    """
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType(docs.select(*own).schema.fields).add("lang_pred", "string").add("score", "double")

    def run(batches):
        for batch in batches:
            found = model.decide(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return docs.select(*own).mapInArrow(lean(run), schema)
