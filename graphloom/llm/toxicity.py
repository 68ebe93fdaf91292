"""Toxic spans by a linear-chain conditional random field with two states (clean, toxic).

Labels exist for documents only, so token labels are derived from them: a token of a
toxic document is labelled toxic where one of its features (the word itself or a prefix)
occurs in toxic documents far more often than in clean ones, beyond chance; all other tokens
are clean.
The CRF learns emission weights of word, prefix and suffix features and transition
weights from these labelled tokens by maximum likelihood. Forward-backward marginals
give each token's probability; tokens of 0.5 or more form the offending spans, and a
document's score is a logistic function of its marginals, fitted on document labels.

A chain is a line of the text, cut every ``CHAIN`` tokens, so a whole text is scored in
bounded memory. Tokens are separated by white space.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_without_columns, small_batches
from .labelled import fit_sample, held_out

MODULUS, FOLD = 5, 0
CHAIN = 128
PREFIXES, SUFFIXES = (4, 5, 6), (3,)
LEAST_DOCS = 3  # documents a feature must occur in
MAX_FEATURES = 200_000
SEED_ODDS = 4.0  # log odds from which a feature labels tokens as toxic
SEED_SHARE = 0.02  # share of toxic documents such a feature must occur in
FAINT = 0.05  # marginals below count as nothing in a document's score
STEPS, RATE, DECAY = 30, 0.5, 1e-3
FIT_ROWS = 1500  # labelled documents of each class to fit on, at most
CACHE_TOKENS = 500_000

_WORD = re.compile(r"\w+")
_TOKEN = re.compile(r"\S+")


def features(token: str) -> list[str]:
    """Features of each word within a token: the word, its prefixes and its suffix, without regard to case."""
    out = []
    for w in _WORD.findall(token.lower()):
        out.append(f"w {w}")
        out += [f"p {w[:n]}" for n in PREFIXES if len(w) >= n]
        out += [f"s {w[-n:]}" for n in SUFFIXES if len(w) > n]
    return out


class Emissions(dict):
    """Token to log emission of the toxic state over the clean one; filled as tokens are met."""

    def __init__(self, weights: dict[str, float], bias: float):
        super().__init__()
        self.weights, self.bias = weights, bias

    def __missing__(self, token: str) -> float:
        get = self.weights.get
        found = self.bias + sum([get(f, 0.0) for f in features(token)])
        if len(self) >= CACHE_TOKENS:
            self.clear()
        if len(token) <= 100:
            self[token] = found
        return found


def chains(text: str | None) -> Iterator[list[str]]:
    """The chains of a text in order; blank lines have none."""
    for line in (text or "").split("\n"):
        tokens = line.split()
        for at in range(0, len(tokens), CHAIN):
            yield tokens[at : at + CHAIN]


def forward_backward(x: np.ndarray, counts: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of the toxic state for chains laid end to end; ``x`` is its log emission over the clean one.

    ``trans`` holds log potentials (2 by 2). All chains advance together; forward and
    backward messages are kept as the ratio of their two entries. With ``pairs``, also
    the expected number of each transition.
    """
    p = np.empty(len(x))
    expected = np.zeros((2, 2)) if pairs else None
    a = np.exp(trans)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    order = np.argsort(-counts, kind="stable")
    for lo in range(0, len(order), 4096):
        some = order[lo : lo + 4096]
        n, s = counts[some], starts[some]
        longest = int(n[0])
        grid = np.minimum(s[:, None] + np.arange(longest), s[:, None] + n[:, None] - 1).T
        live = [int(np.searchsorted(-n, -t, side="left")) for t in range(longest)]  # chains longer than t
        e = np.exp(np.clip(x[grid], -40, 40))
        r = np.empty_like(e)
        r[0] = e[0]
        for t in range(1, longest):
            q = r[t - 1]
            r[t] = e[t] * (a[0, 1] + q * a[1, 1]) / (a[0, 0] + q * a[1, 0])
        b = np.ones_like(e)
        for t in range(longest - 2, -1, -1):
            k = live[t + 1]
            q = e[t + 1, :k] * b[t + 1, :k]
            b[t, :k] = (a[1, 0] + a[1, 1] * q) / (a[0, 0] + a[0, 1] * q)
            if pairs and k:
                left = r[t, :k]
                four = np.stack([a[0, 0] * np.ones(k), a[0, 1] * q, left * a[1, 0], left * a[1, 1] * q])
                expected += (four / four.sum(0)).sum(1).reshape(2, 2)
        odds = r * b
        inside = np.arange(longest)[:, None] < n
        p[grid[inside]] = (odds / (1 + odds))[inside]
    return p, expected


class SpanTagger:
    """Weights of the CRF and of the document score; ``constant`` where there was nothing to learn."""

    def __init__(self, constant: float | None = None):
        self.constant = constant
        self.weights: dict[str, float] = {}
        self.bias, self.trans, self.document = -6.0, np.zeros((2, 2)), (0.0, 1.0)
        self.emissions: Emissions | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"emissions": None}

    def marginals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Toxic marginals of all tokens of all texts in order, and the number of tokens of each text."""
        if self.emissions is None:
            self.emissions = Emissions(self.weights, self.bias)
        x: list[float] = []
        counts, sizes, of = [], [], self.emissions.__getitem__
        for t in texts:
            before = len(x)
            for line in (t or "").split("\n"):
                x += map(of, tokens := line.split())
                n = len(tokens)
                if n <= CHAIN:
                    counts.append(n)
                else:
                    counts += [CHAIN] * (n // CHAIN) + [n % CHAIN]
            sizes.append(len(x) - before)
        counts = [n for n in counts if n]
        if not x:
            return np.zeros(0), np.array(sizes)
        return forward_backward(np.array(x), np.array(counts), self.trans)[0], np.array(sizes)

    def scores(self, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Document scores from token marginals."""
        if self.constant is not None:
            return np.full(len(sizes), self.constant)
        z = self.document[0] + self.document[1] * evidence(p, sizes)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, texts: list[str], y: np.ndarray) -> SpanTagger:
        vocab: dict[str, int] = {}
        flat, counts, of_chain = array("i"), [], []
        for d, text in enumerate(texts):
            for chain in chains(text):
                flat.extend([vocab.setdefault(t, len(vocab)) for t in chain])
                counts.append(len(chain))
                of_chain.append(d)
        ids, counts = np.array(flat, np.int64), np.array(counts, np.int64)
        of_token = np.repeat(np.array(of_chain, np.int64), counts)
        names: dict[str, int] = {}
        col, size = array("i"), array("i")
        for token in vocab:
            found = features(token)
            col.extend([names.setdefault(f, len(names)) for f in found])
            size.append(len(found))
        col, size = np.array(col, np.int64), np.array(size, np.int64)
        ends = np.cumsum(size)
        # documents of each class that have a feature; near copies of a text count once
        fresh = _fresh(ids, of_token, len(texts))
        seen = np.zeros((2, len(names)), np.int64)
        starts = np.searchsorted(of_token, np.arange(len(texts) + 1))
        for d in np.where(fresh)[0]:
            own = np.unique(ids[starts[d] : starts[d + 1]])
            if len(own):
                n = size[own]
                at = np.repeat(ends[own] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                seen[y[d], np.unique(col[at])] += 1
        clean, toxic = seen
        total = clean + toxic
        kept = np.argsort(-total, kind="stable")[:MAX_FEATURES]
        kept = np.sort(kept[total[kept] >= LEAST_DOCS])
        docs = np.bincount(y[fresh], minlength=2)
        least, sure, share = max(LEAST_DOCS, SEED_SHARE * docs[1]), np.log(max(len(kept), 1)) + 3, (docs[1] + 0.5) / (docs.sum() + 1)
        odds = np.log((toxic + 0.1) / share) - np.log((clean + 0.1) / (1 - share))
        seed = np.zeros(len(names), bool)
        for f in kept[(toxic[kept] >= least) & (odds[kept] >= SEED_ODDS)]:
            seed[f] = _surprise(int(toxic[f]), int(clean[f]), share) >= sure
        row = np.repeat(np.arange(len(vocab)), size)
        seeded = np.bincount(row, weights=seed[col], minlength=len(vocab)) > 0
        truth = (y[of_token] == 1) & seeded[ids]
        index = np.full(len(names), -1, np.int64)
        index[kept] = np.arange(len(kept))
        row, col = row[index[col] >= 0], index[col][index[col] >= 0]
        last = np.cumsum(counts) - 1
        inner = np.ones(len(ids), bool)
        inner[last] = False
        at = np.where(inner)[0]
        seen = np.bincount(truth[at] * 2 + truth[at + 1], minlength=4).reshape(2, 2)
        w, bias, trans = np.zeros(len(kept)), self.bias, np.zeros((2, 2))
        state = [np.zeros(len(kept) + 5), np.zeros(len(kept) + 5)]
        scale = 1 / max(truth.sum(), 1)
        for step in range(1, STEPS + 1):
            per = np.bincount(row, weights=w[col], minlength=len(vocab)) + bias
            p, pairs = forward_backward(per[ids], counts, trans, pairs=True)
            gap = np.bincount(ids, weights=truth - p, minlength=len(vocab))
            grad = np.concatenate([np.bincount(col, weights=gap[row], minlength=len(kept)), [gap.sum()], (seen - pairs).ravel()]) * scale
            grad -= DECAY * np.concatenate([w, np.zeros(5)]) * (np.abs(np.concatenate([w, np.zeros(5)])) > 0)
            state[0] = 0.9 * state[0] + 0.1 * grad
            state[1] = 0.99 * state[1] + 0.01 * grad**2
            move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-6)
            w, bias, trans = w + move[: len(kept)], bias + move[len(kept)], trans + move[len(kept) + 1 :].reshape(2, 2)
        label = list(names)
        self.weights = {label[f]: float(v) for f, v in zip(kept, w, strict=True) if abs(v) > 1e-3}
        del names, label, vocab
        self.bias, self.trans = float(bias), trans
        p, sizes = self.marginals(texts)
        self.document = _logistic(evidence(p, sizes), y)
        self.emissions = None
        return self


def _fresh(ids: np.ndarray, of_token: np.ndarray, n: int) -> np.ndarray:
    """Whether at least half of a document's runs of five tokens occur in no earlier document."""
    with np.errstate(over="ignore"):
        h = np.zeros(max(len(ids) - 4, 0), np.int64)
        for k in range(5):
            h = h * 1_000_003 + ids[k : len(h) + k]
    whole = of_token[: len(h)] == of_token[4:] if len(h) else np.zeros(0, bool)
    h, d = h[whole], of_token[: len(h)][whole]
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    new_run = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    once = new_run | np.r_[True, d[1:] != d[:-1]] if len(h) else new_run
    total = np.bincount(d[once], minlength=n)
    first = np.bincount(d[new_run], minlength=n)
    return 2 * first >= total


def _surprise(k: int, other: int, share: float) -> float:
    """Log-likelihood gain of k toxic texts among k + other over the overall share of toxic ones."""
    n = k + other
    return sum(m * np.log(m / (n * q)) for m, q in ((k, share), (other, 1 - share)) if m)


def evidence(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document the log of the odds that any of its tokens is toxic (tokens taken as independent), kept within +-12."""
    loss = np.concatenate([[0], np.cumsum(-np.log1p(-np.minimum(np.where(p < FAINT, 0, p), 1 - 1e-9)))])
    ends = np.cumsum(sizes)
    total = np.maximum(loss[ends] - loss[ends - sizes], 1e-5)
    return np.clip(np.log(np.expm1(np.minimum(total, 30))), -12, 12)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a ridge logistic fit, classes weighted alike, by Newton steps."""
    a, b = 0.0, 0.5
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(weight * (y - q)).sum(), (weight * (y - q) * x).sum() - 1e-3 * (b - 0.5)])
        h = weight * np.maximum(q * (1 - q), 1e-6)
        m = np.array([[h.sum() + 1e-4, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 1e-3]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(m, g), -1, 1)
    return float(a), max(float(b), 0.05)


def fit(docs: DataFrame, labels: DataFrame) -> SpanTagger:
    """Learn from a bounded sample outside the held-out fold.

    Without labels every score is 0 (nothing is known to be toxic); with labels of one
    class only, 0.01 or 0.99.
    """
    found = fit_sample(docs, labels, "toxic", MODULUS, FOLD, FIT_ROWS)
    y = found["y"].to_numpy().astype(np.int64)
    if len(np.unique(y)) < 2:
        return SpanTagger(constant=0.0 if not len(y) else 0.01 + 0.98 * float(y[0]))
    return SpanTagger().fit(found["text"].tolist(), y)


def spans(text: str | None, p: np.ndarray, least: float = 0.5) -> list[tuple[int, int, float]]:
    """(start, end, probability) of runs of toxic tokens, as character offsets of the text."""
    out, k, base = [], 0, 0
    for line in (text or "").split("\n"):
        n = len(line.split())
        if n and (p[k : k + n] >= least).any():
            run = False
            for j, m in enumerate(_TOKEN.finditer(line)):
                q = float(p[k + j])
                if q >= least:
                    if run:
                        out[-1] = (out[-1][0], base + m.end(), max(out[-1][2], q))
                    else:
                        out.append((base + m.start(), base + m.end(), q))
                run = q >= least
        k += n
        base += len(line) + 1
    return out


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])


def score(docs: DataFrame, model: SpanTagger, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of every document with ``score`` and ``spans array<struct<start,end,p>>``.

    A null or empty text has no tokens and gets the score of no evidence. Whole texts are
    tagged; repeated rows each get their score.
    """
    small_batches(docs)
    fields = [docs.schema[c] for c in columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, spans array<struct<start:int,end:int,p:double>>"
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(batch.num_columns - 1).to_pylist()
            p, sizes = tagger.marginals(texts)
            ends = np.cumsum(sizes)
            found = [spans(t, p[b - n : b]) if n and p[b - n : b].max() >= 0.5 else [] for t, b, n in zip(texts, ends, sizes, strict=True)]
            found = pa.array([[{"start": a, "end": b, "p": q} for a, b, q in some] for some in found], pa.list_(_SPAN))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(tagger.scores(p, sizes)), found], [*(f.name for f in fields), "score", "spans"])

    return docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias("text_")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5) and spans of every document."""
    scored = score(rows_without_columns(docs, ["doc_id", "text"]), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), MODULUS, FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
