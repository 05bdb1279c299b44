"""Toxic spans by a linear-chain conditional random field over words, and document scores from its marginals.

Labels exist for documents alone, so the words of the training sample are labelled first: in a toxic document, each
word that stands in toxic documents far oftener than in others is offending; all other words, and all words of clean
documents, are not. The field learns from these labelled words and gives each word of a text its marginal probability.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, label_counts, labelled_texts, per_document, table

_WORD = re.compile(r"\w+")
#: Words whose emissions a task remembers.
REMEMBERED = 250_000
#: Words in a row of the blocked recursion.
ROW = 128
#: Lengths of the word beginnings that are features, and the slots they are hashed to.
BEGINNINGS, SLOTS = (4, 5, 6, 7), 1 << 15


def _beginnings(word: str) -> list[int]:
    """Slots of the beginnings of a lower-case word; a shorter word's slots are those of the whole word."""
    return [(zlib.crc32(word[:n].encode("utf-8", "replace")) + n * 7919) % SLOTS for n in BEGINNINGS]


def _shape(word: str) -> int:
    return 0 if word.islower() else 1 if word.isupper() and len(word) > 1 else 2 if word[:1].isupper() else 3


@dataclass(frozen=True)
class ToxicModel:
    """Weights in favour of the offending state, transition weights [from][to], and the calibration of documents."""

    words: dict
    beginning: np.ndarray
    shape: np.ndarray
    bias: float
    transition: np.ndarray
    calibration: tuple[float, float, float, float]

    def emission(self, word: str) -> float:
        low = word.lower()
        return self.bias + self.words.get(low, 0.0) + float(self.beginning[_beginnings(low)].sum()) + float(self.shape[_shape(word)])


def marginals(emissions: list[np.ndarray], transition: np.ndarray) -> list[np.ndarray]:
    """P(offending) of each word of each text, by the exact forward-backward recursion.

    Texts are laid out in rows of ROW words. The 2 x 2 matrices of a row are multiplied for all rows at once, the rows
    of a text are then linked one after another, and a second pass over all rows fills in the messages of each word.
    """
    sizes = [len(e) for e in emissions]
    rows_of = [-(-n // ROW) for n in sizes]
    n_rows = sum(rows_of)
    if not n_rows:
        return [np.zeros(0) for _ in sizes]
    w = np.ones((n_rows, ROW))  # exp(emission)
    used = np.zeros((n_rows, ROW), bool)
    flat_w, flat_used = w.reshape(-1), used.reshape(-1)
    at = 0
    for e, r in zip(emissions, rows_of, strict=True):
        flat_w[at : at + len(e)] = np.exp(np.clip(e, -30, 30))
        flat_used[at : at + len(e)] = True
        at += r * ROW
    t = np.exp(np.clip(transition, -20, 20))
    t00, t01, t10, t11 = t[0, 0], t[0, 1], t[1, 0], t[1, 1]

    a, b, c, d = np.ones(n_rows), np.zeros(n_rows), np.zeros(n_rows), np.ones(n_rows)
    for k in range(ROW):
        x, on = w[:, k], used[:, k]
        na, nb, nc, nd = a * t00 + b * t10, (a * t01 + b * t11) * x, c * t00 + d * t10, (c * t01 + d * t11) * x
        s = 1 / (na + nb + nc + nd)
        a, b, c, d = np.where(on, na * s, a), np.where(on, nb * s, b), np.where(on, nc * s, c), np.where(on, nd * s, d)

    enter, leave = np.zeros(n_rows), np.ones(n_rows)  # ratio of the messages: state 1 over state 0
    at = 0
    for r in rows_of:
        ratio = 0.0  # a text begins in the clean state
        for i in range(at, at + r):
            enter[i] = ratio
            ratio = (b[i] + ratio * d[i]) / (a[i] + ratio * c[i])
        ratio = 1.0
        for i in range(at + r - 1, at - 1, -1):
            leave[i] = ratio
            ratio = (c[i] + ratio * d[i]) / (a[i] + ratio * b[i])
        at += r

    forward = np.empty_like(w)
    ratio = enter
    for k in range(ROW):
        new = w[:, k] * (t01 + ratio * t11) / (t00 + ratio * t10)
        ratio = np.where(used[:, k], new, ratio)
        forward[:, k] = ratio
    ratio = leave
    for k in range(ROW - 1, -1, -1):
        forward[:, k] *= ratio
        x = w[:, k]
        new = (t10 + t11 * x * ratio) / (t00 + t01 * x * ratio)
        ratio = np.where(used[:, k], new, ratio)
    p = (forward / (1 + forward)).reshape(-1)
    out, at = [], 0
    for n, r in zip(sizes, rows_of, strict=True):
        out.append(p[at : at + n])
        at += r * ROW
    return out


def offending_words(toxic: list[list[str]], clean: list[list[str]], least: int = 5, ratio: float = 5.0):
    """A test of words: whether the word, or one of its beginnings, stands in at least ``least`` toxic documents, whose
    share of all toxic ones is ``ratio`` times the clean documents' share, by more than three standard errors."""
    n1, n0 = len(toxic) + 1.0, len(clean) + 1.0

    def over(forms) -> set[str]:
        df1 = Counter(f for d in toxic for f in {x for w in d for x in forms(w.lower())})
        df0 = Counter(f for d in clean for f in {x for w in d for x in forms(w.lower())})
        out = set()
        for f, k in df1.items():
            p1, p0 = (k + 0.5) / n1, (df0[f] + 0.5) / n0
            if k >= least and p1 >= ratio * p0 and (p1 - p0) > 3 * math.sqrt(p1 * (1 - p1) / n1 + p0 / n0):
                out.add(f)
        return out

    words = over(lambda w: (w,))
    begun = over(lambda w: [w[:n] for n in BEGINNINGS if len(w) > n])
    return lambda w: w in words or any(w[:n] in begun for n in BEGINNINGS if len(w) > n)


def _train(docs: list[tuple[list[str], list[int]]], context: int = 8, epochs: int = 12, rate: float = 0.5, ridge: float = 1e-4):
    """Fit the field by AdaGrad on the log likelihood of windows of 2 * context + 1 words: around each offending word,
    and evenly through the rest."""
    size = 2 * context + 1
    tokens, tags = [], []
    for words, y in docs:
        if not words:
            continue
        middles = {i for i, v in enumerate(y) if v} | set(range(context, len(words), 10 * size))
        for i in sorted(middles | {min(context, len(words) - 1)}):
            start = max(0, min(i - context, len(words) - size))
            tokens.append(words[start : start + size])
            tags.append(y[start : start + size])
    counts = Counter(w.lower() for t in tokens for w in t)
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(w for w, c in counts.items() if c >= 2))}
    n = len(tokens)
    wid, hid, tag, on = (np.zeros((n, size), int) for _ in range(4))
    sid = np.zeros((n, size, len(BEGINNINGS)), int)
    for r, (words, y) in enumerate(zip(tokens, tags, strict=True)):
        k = len(words)
        wid[r, :k] = [vocabulary.get(w.lower(), 0) for w in words]
        sid[r, :k] = [_beginnings(w.lower()) for w in words]
        hid[r, :k] = [_shape(w) for w in words]
        tag[r, :k], on[r, :k] = y, 1
    weights = [np.zeros(len(vocabulary) + 1), np.zeros(SLOTS), np.zeros(4), np.zeros(1), np.zeros((2, 2))]
    past = [np.full(w.shape, 1e-6) for w in weights]
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(n), max(1, n // 512)):
            W, S, H, Y, ON = (m[rows] for m in (wid, sid, hid, tag, on))
            e = np.clip(weights[0][W] + weights[1][S].sum(2) + weights[2][H] + weights[3][0], -30, 30)
            x, t = np.exp(e), np.exp(weights[4])
            m = len(rows)
            alpha, beta = np.zeros((m, size, 2)), np.ones((m, size, 2))
            state = np.tile([1.0, 0.0], (m, 1))
            for k in range(size):
                state = state @ t
                state[:, 1] *= x[:, k]
                state /= state.sum(1, keepdims=True)
                alpha[:, k] = state
            state = np.ones((m, 2))
            for k in range(size - 1, -1, -1):
                beta[:, k] = state
                right = state.copy()
                right[:, 1] *= x[:, k]
                state = np.where(ON[:, k : k + 1] > 0, right @ t.T, state)
                state /= state.sum(1, keepdims=True)
            p = alpha * beta
            p /= p.sum(2, keepdims=True)
            grad = (Y - p[:, :, 1]) * ON
            g = [np.zeros_like(w) for w in weights]
            np.add.at(g[0], W, grad)
            np.add.at(g[1], S, grad[:, :, None])
            np.add.at(g[2], H, grad)
            g[3][0] = grad.sum()
            before = np.concatenate([np.tile([[[1.0, 0.0]]], (m, 1, 1)), alpha[:, :-1]], 1)
            after = beta.copy()
            after[:, :, 1] *= x
            pair = before[:, :, :, None] * t[None, None] * after[:, :, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            pair *= ON[:, :, None, None]
            yb = np.concatenate([np.zeros((m, 1), int), Y[:, :-1]], 1)
            for i in (0, 1):
                for j in (0, 1):
                    g[4][i, j] = ((yb == i) & (Y == j) & (ON > 0)).sum() - pair[:, :, i, j].sum()
            g[0][0] = 0
            for w, dg, h in zip(weights, g, past, strict=True):
                dg = dg / m - ridge * w
                h += dg * dg
                w += rate * dg / np.sqrt(h)
    return {w: float(weights[0][i]) for w, i in vocabulary.items() if abs(weights[0][i]) > 1e-3}, weights


def _features(p: np.ndarray) -> tuple[float, float, float]:
    """The largest marginal, the expected number of offending words, and the same for each thousand words."""
    if not len(p):
        return 0.0, 0.0, 0.0
    total = float(p.sum())
    return float(p.max()), math.log1p(total), math.log1p(1000 * total / (len(p) + 50))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", per_class: int = 1500) -> ToxicModel:
    """Train on at most ``per_class`` labels of each value, the field on three quarters of them, the calibration on the
    last. With one label only, scores are that label's share."""
    rows = labelled_texts(docs, labels, label_col, per_class, text_col)
    counts = label_counts(labels, label_col)
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    logit = math.log(prior / (1 - prior))
    split = {k: [_WORD.findall(r["text"]) for r in rows if r["label"] == k] for k in (0, 1)}
    if not split[0] or not split[1]:
        return ToxicModel({}, np.zeros(SLOTS), np.zeros(4), -20.0, np.zeros((2, 2)), (0.0, 0.0, 0.0, logit))
    apart = {k: [d for i, d in enumerate(split[k]) if i % 4 == 3] or split[k] for k in split}
    own = {k: [d for i, d in enumerate(split[k]) if i % 4 != 3] for k in split}
    bad = offending_words(own[1], own[0])
    tagged = [(d, [int(bad(w.lower())) for w in d]) for d in own[1]] + [(d, [0] * len(d)) for d in own[0]]
    words, (_, beginning, shape, bias, transition) = _train(tagged)
    model = ToxicModel(words, beginning, shape, float(bias[0]), transition, (0.0, 0.0, 0.0, 0.0))
    known: dict[str, float] = {}
    x = []
    for k in (0, 1):
        for at in range(0, len(apart[k]), 50):
            part = [np.array([known[w] if w in known else known.setdefault(w, model.emission(w)) for w in d], float) for d in apart[k][at : at + 50]]
            x += [_features(p) for p in marginals(part, transition)]
    y = np.array([k for k in (0, 1) for _ in apart[k]])
    # weights that bring the balanced sample back to the shares of all labels
    sample = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    z = np.column_stack([np.array(x), np.ones(len(x))])
    beta = np.array([0.0, 0.0, 0.0, logit])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (sample * (y - q)) - np.array([0.3, 0.3, 0.3, 0]) * beta
        hess = (z * (sample * q * (1 - q))[:, None]).T @ z + np.diag([0.3, 0.3, 0.3, 1e-6])
        beta = beta + np.clip(np.linalg.solve(hess, grad), -1, 1)  # short steps: the two classes may be separable
    return ToxicModel(words, beginning, shape, float(bias[0]), transition, tuple(map(float, beta)))


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, span_threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: its id, ``score``, ``predicted``, ``max_marginal`` and ``spans``.

    ``spans`` are (start, end, marginal), in code points, end exclusive: neighbouring words whose marginal is at least
    ``span_threshold`` are one span, with the largest marginal of theirs. Null and empty texts have no span and the score
    of a text without any offending word. Repeated rows each give a row; other columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of the bounded sample
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def start():
        m = shared.value
        seen: dict[str, float] = {}

        def emissions(text: str) -> np.ndarray:
            out = []
            for w in _WORD.findall(text):
                e = seen.get(w)
                if e is None:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    e = seen[w] = m.emission(w)
                out.append(e)
            return np.array(out, float)

        def spans(text: str, p: np.ndarray):
            found = []
            hot = p >= span_threshold
            if not hot.any():
                return found
            previous = -2
            for i, at in enumerate(_WORD.finditer(text)):
                if hot[i]:
                    if previous == i - 1:
                        found[-1] = (found[-1][0], at.end(), max(found[-1][2], float(p[i])))
                    else:
                        found.append((at.start(), at.end(), float(p[i])))
                    previous = i
            return found

        def work(ids, texts):
            scores, most, found = [], [], []
            a, b, c, d = m.calibration
            own = [t or "" for t in texts]
            for text, p in zip(own, marginals([emissions(t) for t in own], m.transition), strict=True):
                x = _features(p)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, a * x[0] + b * x[1] + c * x[2] + d)))))
                most.append(x[0])
                found.append([{"start": s, "end": e, "marginal": q} for s, e, q in spans(text, p)])
            return ids, scores, [int(s >= threshold) for s in scores], most, found

        return work

    schema = f"`{id_col}` {kind}, score double, predicted int, max_marginal double, spans array<struct<start:int,end:int,marginal:double>>"
    return per_document(docs, start, schema, id_col, text_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1)
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"), "max_marginal")
