"""Personal data: rules, and a character-level bidirectional LSTM with CRF transitions.

The rules find emails, IP addresses, card and phone numbers. The network is trained in
numpy on the rules' spans in a sample of documents and reads windows around digits and
at signs, without which no such data is written. Windows overlap; each character takes its
tag from the window in which it lies most central, and the tags of a whole text are then
joined to spans. Its spans are added where they overlap none of the rules'.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
WINDOW, STRIDE, CONTEXT = 64, 32, 12
#: Bounds of the training sample: documents read and windows collected.
SAMPLE_DOCS, SAMPLE_WINDOWS = 40_000, 4096
HIDDEN, EMBED, STEPS, BATCH, RATE, SEED = 16, 10, 160, 96, 0.03, 11

# The rules of the contract.
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]+")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches, in time linear in the text: an address starts where the run of
    local characters before its at sign does, or where the last address ended."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        if start < at and (m := EMAIL_DOMAIN.match(text, at)):
            yield 0, start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def rule_spans(text: str) -> list[Span]:
    """Spans of the rules by start, then kind."""
    if not ANCHOR.search(text):
        return []
    out = list(_emails(text))
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


# --- windows -------------------------------------------------------------------------

_PUNCTUATION = " \n.@+-()_%:/,;=\"'"
PAD, DIGIT, OTHER_LETTER, OTHER = 0, 1, 2, 3
SYMBOLS = 4 + 26 + len(_PUNCTUATION)


def _symbol_table() -> np.ndarray:
    out = np.full(128, OTHER, np.int64)
    for i in range(10):
        out[48 + i] = DIGIT
    for i in range(26):
        out[65 + i] = out[97 + i] = 4 + i
    for i, c in enumerate(_PUNCTUATION):
        out[ord(c)] = 30 + i
    return out


_SYMBOLS = _symbol_table()


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(codes < 128, _SYMBOLS[np.minimum(codes, 127)], OTHER_LETTER).astype(np.uint8)


def window_starts(text: str) -> list[list[int]]:
    """For each region around digits and at signs, the starts of its overlapping windows."""
    regions: list[list[int]] = []
    for m in ANCHOR.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = b
        else:
            regions.append([a, b])
    out = []
    for a, b in regions:
        a = max(0, min(a, (a + b - WINDOW) // 2)) if b - a < WINDOW else a
        starts = list(range(a, max(a + 1, b - WINDOW + STRIDE), STRIDE))
        out.append(starts)
    return out


def read_window(codes: np.ndarray, start: int) -> np.ndarray:
    part = codes[start : start + WINDOW]
    return np.pad(part, (0, WINDOW - len(part)), constant_values=PAD)


def tag_row(spans: list[Span], size: int) -> np.ndarray:
    tags = np.zeros(size, np.uint8)
    for kind, a, b in spans:
        if not tags[a:b].any():
            tags[a:b] = 2 + 2 * kind
            tags[a] = 1 + 2 * kind
    return tags


# --- network -------------------------------------------------------------------------


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _run_lstm(x, wx, wh, b):
    """States of all steps and what the backward pass needs; x: (steps, rows, inputs)."""
    steps, rows, _ = x.shape
    n = wh.shape[0]
    h, c = np.zeros((rows, n)), np.zeros((rows, n))
    pre = x @ wx + b
    hs, saved = np.empty((steps, rows, n)), []
    for t in range(steps):
        z = pre[t] + h @ wh
        gates = _sigmoid(z[:, : 3 * n])
        i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        g = np.tanh(z[:, 3 * n :])
        before, h_before = c, h
        c = f * c + i * g
        squashed = np.tanh(c)
        h = o * squashed
        hs[t] = h
        saved.append((i, f, o, g, before, h_before, squashed))
    return hs, saved


def _back_lstm(dhs, x, saved, wx, wh):
    steps, rows, n = dhs.shape
    dh, dc = np.zeros((rows, n)), np.zeros((rows, n))
    dz_all = np.empty((steps, rows, 4 * n))
    dwh = np.zeros_like(wh)
    for t in reversed(range(steps)):
        i, f, o, g, before, h_before, squashed = saved[t]
        dh = dh + dhs[t]
        dc = dc + dh * o * (1 - squashed**2)
        dz = dz_all[t]
        dz[:, :n] = dc * g * i * (1 - i)
        dz[:, n : 2 * n] = dc * before * f * (1 - f)
        dz[:, 2 * n : 3 * n] = dh * squashed * o * (1 - o)
        dz[:, 3 * n :] = dc * i * (1 - g**2)
        dwh += h_before.T @ dz
        dh, dc = dz @ wh.T, dc * f
    flat = dz_all.reshape(-1, 4 * n)
    return x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(0), dz_all @ wx.T


def _logsumexp(x, axis):
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Embedding, two LSTMs, output layer and CRF transitions."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = SEED) -> Tagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        w = {"embed": rng.normal(0, 0.5, (SYMBOLS, EMBED)), "out": draw(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS)}
        for d in "fb":
            bias = np.zeros(4 * HIDDEN)
            bias[HIDDEN : 2 * HIDDEN] = 1
            w |= {f"x{d}": draw(EMBED, 4 * HIDDEN), f"h{d}": draw(HIDDEN, 4 * HIDDEN), f"b{d}": bias}
        return Tagger(w | {"move": np.zeros((TAGS, TAGS)), "start": np.zeros(TAGS)})

    def _emissions(self, rows: np.ndarray):
        w = self.weights
        x = w["embed"][rows.T]
        forward, saved_f = _run_lstm(x, w["xf"], w["hf"], w["bf"])
        backward, saved_b = _run_lstm(x[::-1], w["xb"], w["hb"], w["bb"])
        states = np.concatenate([forward, backward[::-1]], 2)
        return states @ w["out"] + w["out_b"], (x, states, saved_f, saved_b)

    def gradient(self, rows: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood per window and its gradient."""
        w = self.weights
        score, (x, states, saved_f, saved_b) = self._emissions(rows)
        steps, n, _ = score.shape
        gold, every = tags.T, np.arange(n)
        alpha, beta = np.empty_like(score), np.zeros_like(score)
        alpha[0] = w["start"] + score[0]
        for t in range(1, steps):
            alpha[t] = score[t] + _logsumexp(alpha[t - 1][:, :, None] + w["move"], 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsumexp(w["move"] + (score[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _logsumexp(alpha[-1], 1)
        d_score = np.exp(alpha + beta - total[None, :, None])
        path = score[np.arange(steps)[:, None], every, gold].sum(0) + w["start"][gold[0]]
        path = path + w["move"][gold[:-1], gold[1:]].sum(0)
        pair = alpha[:-1, :, :, None] + w["move"] + (score[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None]
        d_move = np.exp(pair).sum((0, 1))
        np.subtract.at(d_move, (gold[:-1], gold[1:]), 1)
        d_start = d_score[0].sum(0) - np.bincount(gold[0], minlength=TAGS)
        d_score[np.arange(steps)[:, None], every, gold] -= 1
        flat = d_score.reshape(-1, TAGS)
        grad = {"out": states.reshape(-1, 2 * HIDDEN).T @ flat, "out_b": flat.sum(0), "move": d_move, "start": d_start}
        d_states = d_score @ w["out"].T
        grad["xf"], grad["hf"], grad["bf"], dx = _back_lstm(d_states[..., :HIDDEN], x, saved_f, w["xf"], w["hf"])
        grad["xb"], grad["hb"], grad["bb"], dx_b = _back_lstm(d_states[::-1, :, HIDDEN:], x[::-1], saved_b, w["xb"], w["hb"])
        grad["embed"] = np.zeros_like(w["embed"])
        np.add.at(grad["embed"], rows.T, dx + dx_b[::-1])
        return float((total - path).mean()), {k: v / n for k, v in grad.items()}

    @staticmethod
    def train(rows: np.ndarray, tags: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Tagger:
        """Adam on batches drawn at random; half of each batch are windows with a span."""
        model, rng = Tagger.fresh(seed), np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in model.weights.items()}
        second = {k: np.zeros_like(v) for k, v in model.weights.items()}
        hot = np.flatnonzero(tags.any(1))
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(hot, BATCH // 2), rng.integers(0, len(rows), BATCH // 2)])
            _, grad = model.gradient(rows[pick], tags[pick])
            rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
            for k, g in grad.items():
                g = np.clip(g, -5, 5)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                step_k = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                model.weights[k] -= rate * step_k
        return model

    def decode(self, rows: np.ndarray) -> np.ndarray:
        """The best tag sequence of every window (Viterbi)."""
        score, _ = self._emissions(rows)
        steps, n, _ = score.shape
        best, back = self.weights["start"] + score[0], np.empty((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            step = best[:, :, None] + self.weights["move"]
            back[t] = step.argmax(1)
            best = step.max(1) + score[t]
        out = np.empty((n, steps), np.int8)
        out[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(n), out[:, t]]
        return out


def _plausible(kind: int, part: str) -> bool:
    """What a span of a kind holds at least."""
    digits = sum(c.isdigit() for c in part)
    if kind == 0:
        return "@" in part[1:-1] and "." in part
    if kind == 1:
        return part.count(".") >= 3 and digits >= 4
    return (13 if kind == 2 else 9) <= digits <= 19


def _snapped(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without words or numbers that it cuts through, and without white space at its ends."""
    if a and text[a - 1].isalnum():
        while a < b and text[a].isalnum():
            a += 1
    if b < len(text) and text[b].isalnum():
        while a < b and text[b - 1].isalnum():
            b -= 1
    while a < b and text[a].isspace():
        a += 1
    while a < b and text[b - 1].isspace():
        b -= 1
    return a, b


def reconcile(text: str, regions: list[list[int]], tags: list[np.ndarray]) -> list[Span]:
    """Spans of a text from the tags of its windows: each character takes the tag of the
    window in which it is farthest from the ends; then runs of one kind become spans."""
    spans, at = [], 0
    for starts in regions:
        first, end = starts[0], min(len(text), starts[-1] + WINDOW)
        row = np.zeros(end - first, np.int64)
        edge = (WINDOW - STRIDE) // 2
        for i, start in enumerate(starts):
            a = start if i == 0 else start + edge
            b = min(end, start + WINDOW)
            row[a - first : b - first] = tags[at][a - start : b - start]
            at += 1
        run, kind = None, -1
        for i, tag in enumerate([*row.tolist(), 0]):
            now = (tag - 1) // 2 if tag else -1
            if run is not None and (now != kind or tag % 2 == 1):
                spans.append((kind, first + run, first + i))
                run = None
            if run is None and now >= 0:
                run, kind = i, now
    return spans


def all_spans(text: str, model: Tagger | None, tags: list[np.ndarray] | None = None) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, from the rules) by start, then kind."""
    base = rule_spans(text)
    out = [(*s, True) for s in base]
    if model is not None:
        regions = window_starts(text)
        for kind, a, b in reconcile(text, regions, tags or _decode_all(text, regions, model)):
            a, b = _snapped(text, a, b)
            if _plausible(kind, text[a:b]) and not any(a < e and s < b for _, s, e in base):
                out.append((kind, a, b, False))
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def _decode_all(text: str, regions: list[list[int]], model: Tagger) -> list[np.ndarray]:
    return _decode_windows([read_window(symbols(text), s) for starts in regions for s in starts], model)


def _decode_windows(windows: list[np.ndarray], model: Tagger, most: int = 512) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for i in range(0, len(windows), most):
        out.extend(model.decode(np.stack(windows[i : i + most])))
    return out


# --- Spark ---------------------------------------------------------------------------


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> Tagger | None:
    """A tagger trained on the rules' spans in about `sample_docs` documents chosen by a
    hash of their id, of whose windows at most `sample_windows` come to the driver; None
    where these hold no span."""
    n = max(1, docs.count())
    share = min(1.0, sample_docs / n)
    some = docs if share == 1 else docs.where(F.xxhash64("doc_id") < F.lit(int(share * 2.0**64) - (1 << 63)))

    def run(batches):
        for batch in batches:
            codes, tags = [], []
            for value in batch.column(0):
                text = value.as_py() or ""
                starts = window_starts(text)
                if starts:
                    read, row = symbols(text), tag_row(rule_spans(text), len(text))
                    for s in (s for region in starts for s in region):
                        codes.append(read_window(read, s).tobytes())
                        tags.append(read_window(row, s).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), pa.array(tags, pa.binary())], names=["codes", "tags"])

    windows = some.select("text").mapInArrow(run, "codes binary, tags binary")
    windows = windows.distinct()  # copies of a document give each window once
    got = windows.orderBy(F.xxhash64("codes", "tags"), "codes", "tags").limit(sample_windows).toArrow()
    as_rows = lambda c: np.frombuffer(b"".join(got.column(c).to_pylist()), np.uint8).reshape(-1, WINDOW).astype(np.int64)
    if not len(got):
        return None
    rows, tags = as_rows("codes"), as_rows("tags")
    return Tagger.train(rows, tags) if tags.any() else None


_FOUND = "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))),
    ]
)


def find(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id and all spans by start, then kind; `base` tells the
    rules' from the network's. Offsets are code points.

    Texts are read whole, in any length; a null text counts as empty and has no span.
    Repeated rows are read each; other columns are ignored; an empty table gives an empty
    one. Without a model one is trained; where there is nothing to train on, the rules
    stand alone.
    """
    tagger = model or learn(docs)

    def spans_of(texts: list[str]):
        # windows of neighbouring texts are decoded together, a bounded number at a time
        regions = [window_starts(t) if tagger is not None else [] for t in texts]
        windows = []
        for text, own in zip(texts, regions, strict=True):
            if own:
                codes = symbols(text)
                windows += [read_window(codes, s) for starts in own for s in starts]
        tags, at = _decode_windows(windows, tagger) if windows else [], 0
        for text, own in zip(texts, regions, strict=True):
            n = sum(map(len, own))
            spans = all_spans(text, tagger, tags[at : at + n]) if own else [(*s, True) for s in rule_spans(text)]
            at += n
            yield [{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in spans]

    def run(batches):
        for batch in batches:
            rows, held, chars = [], [], 0
            for value in batch.column(1):
                held.append(value.as_py() or "")
                chars += len(held[-1])
                if chars > 1 << 20:
                    rows.extend(spans_of(held))
                    held, chars = [], 0
            rows.extend(spans_of(held))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(rows, _ARROW.field(1).type)], schema=_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, _FOUND)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the rules' spans per kind, their digest, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
