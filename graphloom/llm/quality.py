"""Quality by attention-based multiple-instance learning.

A document is a bag of passages (64 words each, the last may be shorter). Every passage
is encoded: histogram of character-class pairs and word repetition, then a learned
hidden layer. Gated attention weighs the passages, learned from document labels alone,
and the weighted passage representation is scored by a logistic output.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_without_columns, small_batches
from .labelled import fit_sample, held_out

MODULUS, FOLD = 3, 1
WORDS = 64
HIDDEN, GATE = 16, 8
STEPS, RATE, DECAY = 250, 0.02, 1e-4
CLASSES = 16
WORD_FEATURES = 4
WIDTH = CLASSES * CLASSES + WORD_FEATURES


def _class_table() -> np.ndarray:
    """Byte to class: letters, digits, blanks, kinds of punctuation, UTF-8 lead and follow bytes."""
    groups = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r", b".", b",", b"!", b"?", b"|", b"$%&*#", b"'\"`", b"()[]{}<>", b"-_=+~^", b"/\\:;@", bytes(range(0xC0, 0x100))]
    table = np.full(256, CLASSES - 1, np.uint8)
    for k, group in enumerate(groups):
        table[list(group)] = k
    return table


_TABLE = _class_table()


def passages(text: str | None) -> tuple[list[str], list[float], list[float]]:
    """The passages of a text, and of each the shares of repeated neighbours and of distinct words."""
    words = (text or "").split()
    out, same, distinct = [], [], []
    for at in range(0, len(words), WORDS):
        part = words[at : at + WORDS]
        out.append(" ".join(part))
        same.append(sum(map(eq, part[1:], part)) / len(part))
        distinct.append(len(set(part)) / len(part))
    return out or [""], same or [0.0], distinct or [1.0]


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Raw passage features (a row for each passage of all texts) and the number of passages of each text."""
    parts, same, distinct, counts = [], [], [], []
    for t in texts:
        p, s, d = passages(t)
        parts += p
        same += s
        distinct += d
        counts.append(len(p))
    raw = [p.encode() for p in parts]
    sizes = np.array([len(r) for r in raw])
    code = _TABLE[np.frombuffer(b"".join(raw), np.uint8)].astype(np.int64)
    which = np.repeat(np.arange(len(raw)), sizes)
    pair = code[:-1] * CLASSES + code[1:] + which[:-1] * CLASSES * CLASSES
    pair = pair[which[:-1] == which[1:]] if len(code) > 1 else np.zeros(0, np.int64)
    hist = np.bincount(pair, minlength=len(raw) * CLASSES * CLASSES).reshape(len(raw), -1)
    out = np.empty((len(raw), WIDTH), np.float32)
    out[:, :-WORD_FEATURES] = np.sqrt(hist / np.maximum(hist.sum(1, keepdims=True), 1))
    words = np.array([p.count(" ") + bool(p) for p in parts])
    out[:, -4], out[:, -3] = same, distinct
    out[:, -2] = np.log1p(sizes / np.maximum(words, 1))
    out[:, -1] = words / WORDS
    return out, np.array(counts)


class AttentionModel:
    """Weights of encoder, gated attention and output; ``constant`` where there was nothing to learn."""

    def __init__(self, constant: float | None = None):
        self.constant, self.w = constant, {}

    def _forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w, starts = self.w, np.concatenate([[0], np.cumsum(counts)[:-1]])
        h = np.tanh(x @ w["We"] + w["be"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * g) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        att = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(h * att[:, None], starts, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
        return {"h": h, "t": t, "g": g, "att": att, "z": z, "p": p}

    def score(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document scores, and the attention weight of every passage."""
        if self.constant is not None:
            return np.full(len(counts), self.constant), np.repeat(1 / counts, counts)
        f = self._forward(x, counts)
        return f["p"].astype(np.float64), f["att"]

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> AttentionModel:
        rng = np.random.default_rng(7)
        shapes = {"We": (x.shape[1], HIDDEN), "be": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": (1,)}
        self.w = {k: (rng.standard_normal(s) / np.sqrt(s[0]) if k not in ("be", "d") else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
        weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
        m, v = ({k: np.zeros_like(p) for k, p in self.w.items()} for _ in range(2))
        for step in range(1, STEPS + 1):
            f, w = self._forward(x, counts), self.w
            do = ((f["p"] - y) * weight).astype(np.float32)
            dz = np.repeat(do[:, None] * w["c"], counts, axis=0)
            datt = (dz * f["h"]).sum(1)
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            de = f["att"] * (datt - np.repeat(np.add.reduceat(datt * f["att"], starts), counts))
            dt = de[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2)
            dg = de[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
            dh = (dz * f["att"][:, None] + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
            grad = {"We": x.T @ dh, "be": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ do, "d": do.sum(keepdims=True)}
            for k, g in grad.items():
                g = g + DECAY * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                w[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def fit(docs: DataFrame, labels: DataFrame) -> AttentionModel:
    """Learn from a bounded sample outside the held-out fold.

    Without labels the score is 0.5 for all; with labels of one class only, 0.01 or 0.99.
    """
    found = fit_sample(docs, labels, "quality", MODULUS, FOLD)
    y = found["y"].to_numpy()
    if len(np.unique(y)) < 2:
        return AttentionModel(constant=0.5 if not len(y) else 0.01 + 0.98 * float(y[0]))
    parts = [encode(some) for some in _bounded(found["text"].tolist(), 500_000)]
    x, counts = (np.concatenate(p) for p in zip(*parts, strict=True))
    return AttentionModel().fit(x, counts, y)


def score(docs: DataFrame, model: AttentionModel, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of every document with ``score``, ``n_passages`` and ``top_passage`` (the one with most attention).

    A null or empty text is one empty passage. Whole texts are scored; repeated rows each get their score.
    """
    small_batches(docs)
    fields = [docs.schema[c] for c in columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, n_passages int, top_passage int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(batch.num_columns - 1).to_pylist()
            scores, tops, n = [], [], []
            for some in _bounded(texts):
                x, counts = encode(some)
                p, att = model.score(x, counts)
                starts = np.concatenate([[0], np.cumsum(counts)])
                scores += p.tolist()
                n += counts.tolist()
                tops += [int(np.argmax(att[a:b])) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            names = [*(f.name for f in fields), "score", "n_passages", "top_passage"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array(n, pa.int32()), pa.array(tops, pa.int32())], names)

    return docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias("text_")).mapInArrow(run, schema)


def _bounded(texts: list[str | None], chars: int = 2_000_000) -> Iterator[list[str | None]]:
    """Runs of texts of about ``chars`` characters in all, so that features stay small beside the texts."""
    some, n = [], 0
    for t in texts:
        some.append(t)
        n += len(t or "")
        if n >= chars:
            yield some
            some, n = [], 0
    if some:
        yield some


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5) of every document."""
    scored = score(rows_without_columns(docs, ["doc_id", "text"]), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), MODULUS, FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "top_passage")
