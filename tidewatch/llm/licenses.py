"""License scans with a fuzzy search for short notices.

A notice found with at most k edits holds at least one of its k + 1 parts unchanged. All
parts of all notices are looked for at once (Aho-Corasick); where one is found, the regex
library matches the whole notice with bounded errors around it and reports its span.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import lean

# Phrases that name a license by themselves.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Short notices as licenses give them, in lower case, words only. The words in
# brackets tell a license from its neighbours and must stand as they are.
NOTICES = {
    "permission is hereby granted free of charge to [any person obtaining a copy]": "mit",
    "released under the [mit] license": "mit",
    "permission is hereby granted free of charge to [any person or organization obtaining a copy]": "bsl",
    "distributed under the [boost software license] version 1 0": "bsl",
    "permission to use copy modify and or distribute this software for any purpose [with or without fee] is hereby granted": "isc",
    "released under the [isc] license": "isc",
    "[in no event will the authors] be held liable for any damages arising from the use of this software": "zlib",
    "released under the [zlib] license": "zlib",
    "redistribution and use [in source and binary forms] with or without modification are permitted": "bsd",
    "released under the [bsd] license": "bsd",
    "licensed under the [apache] license [version 2] 0": "apache-2",
    "licensed under the [apache] license [version 1 1]": "apache-1.1",
    "this work is licensed under the [gnu general public license]": "gpl",
    "you can redistribute it and or modify it under the terms of the [gnu general public license]": "gpl",
    "you can redistribute it and or modify it under the terms of the [gnu lesser general public license]": "lgpl",
    "you can redistribute it and or modify it under the terms of the [gnu library general public license]": "lgpl",
    "you can redistribute it and or modify it under the terms of the [gnu affero general public license]": "agpl",
    "subject to the terms of the [mozilla public license]": "mpl",
    "made available under the terms of the [eclipse public license]": "epl",
    "this is free and unencumbered software released into the [public domain]": "unlicense",
    "has waived all [copyright and related or neighboring rights] to this work": "cc0",
    "licensed under [cc0 1 0] universal": "cc0",
}
# The Creative Commons licenses in words and in short, each version by itself.
_CC = {
    "by": "attribution", "by sa": "attribution sharealike", "by nd": "attribution noderivatives", "by nc": "attribution noncommercial",
    "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives",
}
for _short, _words in _CC.items():
    for _version in ("2 0", "2 5", "3 0", "4 0"):
        NOTICES[f"licensed under a creative commons [{_words} {_version}] international license"] = "cc-" + _short.replace(" ", "-")
        NOTICES[f"licensed under [cc {_short} {_version}]"] = "cc-" + _short.replace(" ", "-")
#: One edit for so many characters of a stretch, rounded.
CHARS_PER_EDIT = 12

# words of lower-cased text, in UTF-8: digits, a to z and every byte beyond ASCII
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_WORD = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def _phrase_pattern() -> re.Pattern[bytes]:
    ways = [GAP.join(w.encode() for w in phrase.split()) for phrase in PHRASES]
    joined = b"|".join(b"(" + w + b")" for w in ways)
    return re.compile(rb"(?:(?<=" + NO_WORD + rb")|\A)(?:" + joined + rb")(?=" + NO_WORD + rb"|\Z)")


def _matches(pattern: regex.Pattern, words: str, begin: int, end: int, least: int) -> Iterator[regex.Match]:
    """The best match between `begin` and `end`, and then those on both sides of it, as the
    best one need not be the first. No match has fewer than `least` characters."""
    open_ = [(begin, end)]
    while open_:
        a, b = open_.pop()
        if b - a >= least and (m := pattern.search(words, a, b)):
            yield m
            open_ += [(a, m.start()), (m.end(), b)]


class Notice:
    """A notice with the pattern that finds it: whole words, the bracketed ones exact, and in
    each stretch between them one edit for so many characters."""

    def __init__(self, marked: str, label: str, chars_per_edit: int):
        self.text, self.label = marked.replace("[", "").replace("]", ""), label
        # stretches of the text, (text, exact); spaces beside exact words are exact too
        self.parts = []
        for k, part in enumerate(re.split(r"[\[\]]", marked)):
            if exact := k % 2 == 1:
                before, after = bool(self.parts), marked.find("]", marked.find(part)) + 1 < len(marked)
                part = " " * before + part + " " * after
            else:
                part = part.strip()
            if part:
                self.parts.append((part, exact))
        self.bounds = [0 if exact else (len(part) + chars_per_edit // 2 - 1) // chars_per_edit for part, exact in self.parts]
        self.edits = sum(self.bounds)
        ways = [
            regex.escape(part, special_only=True) if exact else f"(?:{regex.escape(part, special_only=True)}){{e<={edits}}}"
            for (part, exact), edits in zip(self.parts, self.bounds, strict=True)
        ]
        # (?b) asks for the match with the fewest errors
        self.pattern = regex.compile(f"(?b)(?<![^ ])(?:{''.join(ways)})(?![^ ])")

    def seeds(self) -> list[tuple[str, int]]:
        """(seed, its place): a match leaves one of them as it is. A stretch with k edits is
        split into k + 1 pieces; the one stretch with the longest pieces is enough."""
        at, best = 0, []
        for (part, _), edits in zip(self.parts, self.bounds, strict=True):
            cuts = [round(j * len(part) / (edits + 1)) for j in range(edits + 2)]
            pieces = [(part[a:b], at + a) for a, b in zip(cuts, cuts[1:], strict=False)]
            if not best or min(len(p) for p, _ in pieces) > min(len(p) for p, _ in best):
                best = pieces
            at += len(part)
        return best


class Scanner:
    """Searches one text at a time."""

    def __init__(self, notices: dict[str, str] | None = None, chars_per_edit: int = CHARS_PER_EDIT):
        self.phrase = _phrase_pattern()
        self.phrase_labels = list(PHRASES.values())
        self.notices = [Notice(n, label, chars_per_edit) for n, label in (NOTICES if notices is None else notices).items()]
        self.seeds = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(self.notices):
            for seed, at in notice.seeds():
                found.setdefault(seed, []).append((i, at))
        for seed, where in found.items():
            self.seeds.add_word(seed, (len(seed), where))
        self.seeds.make_automaton()

    def base(self, low: bytes) -> list[tuple[int, str]]:
        """(byte at which it starts, label) of every phrase; `low` is lower-cased."""
        if b"license" not in low and not (b"cc" in low and b"nc" in low):
            return []  # each phrase has one of these
        return [(m.start(), self.phrase_labels[m.lastindex - 1]) for m in self.phrase.finditer(low)]

    def fuzzy(self, words: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, errors) of the notices in words joined by single spaces; of
        notices that overlap the one with fewest errors, then the longest, is reported."""
        near: dict[int, list[tuple[int, int]]] = {}
        for last, (size, where) in self.seeds.iter(words):
            for i, offset in where:
                notice = self.notices[i]
                begin = max(0, last + 1 - size - offset - notice.edits)
                end = min(len(words), last + 1 - size - offset + len(notice.text) + notice.edits)
                spans = near.setdefault(i, [])
                if spans and begin <= spans[-1][1]:
                    spans[-1] = (min(begin, spans[-1][0]), max(end, spans[-1][1]))
                else:
                    spans.append((begin, end))
        found = set()
        for i, spans in near.items():
            notice = self.notices[i]
            for begin, end in spans:
                for m in _matches(notice.pattern, words, begin, end, len(notice.text) - notice.edits):
                    found.add((sum(m.fuzzy_counts), m.start() - m.end(), m.start(), m.end(), notice.label))
        # a winner ends what overlaps it; winners lie apart, so neighbours are enough to look at
        starts: list[int] = []
        ends: list[int] = []
        out = []
        for errors, _, a, b, label in sorted(found):
            at = bisect_left(starts, a)
            if (at and ends[at - 1] > a) or (at < len(starts) and starts[at] < b):
                continue
            starts.insert(at, a)
            ends.insert(at, b)
            out.append((label, a, b, errors))
        return sorted(out, key=lambda x: x[1])

    def scan(self, text: str | None) -> dict:
        low = (text or "").encode().lower()
        tokens = WORDS.findall(low)
        joined = b" ".join(tokens).decode()
        base, fuzzy = self.base(low), self.fuzzy(joined)
        places, notices = [], []
        if base:
            starts = [m.start() for m in WORDS.finditer(low)]
            places = [(bisect_left(starts, at), label) for at, label in base]
        if fuzzy:
            gaps = [m.start() for m in re.finditer(" ", joined)]
            notices = [
                (label, bisect_left(gaps, a), bisect_left(gaps, b), errors, round(1 - errors / max(1, b - a), 6))
                for label, a, b, errors in fuzzy
            ]
        return {"n_words": len(tokens), "phrases": places, "notices": notices}


_SCHEMA = (
    "doc_id long, n_words long, phrases array<struct<word: long, label: string>>,"
    " notices array<struct<label: string, first_word: long, last_word: long, errors: long, likeness: double>>"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("phrases", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
        (
            "notices",
            pa.list_(
                pa.struct(
                    [
                        ("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                        ("errors", pa.int64()), ("likeness", pa.float64()),
                    ]
                )
            ),
        ),
    ]
)


def scan(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, phrases (the word they start at, and
    label) and notices (label, first and last word, errors, likeness 0 to 1).

    Texts are scanned whole, one at a time, without a shuffle. A null text counts as empty
    and has no word. Repeated rows are scanned each; other columns are ignored; an empty
    table gives an empty one. Notices begin and end at words; of those that overlap the one
    with fewest edits, then the longest, is reported.
    """
    wanted = dict(NOTICES if notices is None else notices)

    def run(batches: Iterator[pa.RecordBatch]):
        scanner = Scanner(wanted)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            found = [scanner.scan(t.as_py()) for t in texts]
            rows = [
                {
                    "doc_id": d,
                    "n_words": f["n_words"],
                    "phrases": [{"word": w, "label": x} for w, x in f["phrases"]],
                    "notices": [dict(zip(("label", "first_word", "last_word", "errors", "likeness"), n, strict=True)) for n in f["notices"]],
                }
                for d, f in zip(ids, found, strict=True)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return docs.select("doc_id", "text").mapInArrow(lean(run), _SCHEMA)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, first and last place, and labels of scanned documents. The score is 1 with a
    phrase, else the likeness of the best notice."""

    def names(*columns):
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in columns]))), ",")

    starts, base = F.col("phrases.word"), F.col("phrases.label")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(base, F.col("notices.label")).alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(F.array_max("notices.likeness"), F.lit(0.0))).alias("score"),
        "notices",
    )
