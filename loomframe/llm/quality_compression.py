"""Quality by compression: does text look more like what was labelled good or like what was labelled bad."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, label_counts, labelled_texts, per_document, table
from .zcompress import Sizer, build_content


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries, the calibration's slope and intercept, and the share of good labels."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float
    prior: float
    block: int = 512
    #: Bytes of text at which the compressed sizes and the prior have equal weight.
    half: int = 40


def _encode(text: str) -> bytes:
    return text.encode("utf-8", "replace")


def _difference(sizer: Sizer, data: bytes) -> float:
    good, bad = sizer.sizes(data)
    return (bad - good) / len(data)


def _calibrate(x: list[float], y: list[int], rounds: int = 60) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton's method with a little ridge; targets smoothed as by Platt."""
    n1 = sum(y)
    hi, lo = (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2)
    scale = max(1e-9, sum(map(abs, x)) / max(1, len(x)))
    a, b = 0.0, math.log((n1 + 1) / (len(y) - n1 + 1))
    for _ in range(rounds):
        g = [1e-3 * a, 0.0]
        h = [1e-3, 0.0, 1e-6]
        for xi, yi in zip(x, y, strict=True):
            z = max(-2.5, min(2.5, xi / scale))
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * z + b))))
            d, w = p - (hi if yi else lo), p * (1 - p)
            g[0] += d * z
            g[1] += d
            h[0] += w * z * z
            h[1] += w * z
            h[2] += w
        det = h[0] * h[2] - h[1] * h[1]
        da, db = (h[2] * g[0] - h[1] * g[1]) / det, (h[0] * g[1] - h[1] * g[0]) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-6:
            break
    return a / scale, b


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "quality", per_class: int = 1500, dictionary_bytes: int = 65536) -> QualityModel:
    """Dictionaries from half of a sample of at most ``per_class`` labels of each value, calibration on the other half.

    Null texts and labels teach nothing. With one label only, or none, the score is that label's smoothed share.
    """
    rows = labelled_texts(docs, labels, label_col, per_class, text_col)
    counts = label_counts(labels, label_col)
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    of = {k: [_encode(r["text"]) for r in rows if r["label"] == k and r["text"]] for k in (0, 1)}
    if min(map(len, of.values())) < 2:
        return QualityModel(b"", b"", 0.0, math.log(prior / (1 - prior)), prior)
    good, bad = (build_content(of[k][::2], dictionary_bytes) for k in (1, 0))
    sizer = Sizer([good, bad], QualityModel.block)
    x = [(_difference(sizer, t), k) for k in (0, 1) for t in of[k][1::2]]
    slope, intercept = _calibrate([d for d, _ in x], [k for _, k in x])
    n1 = sum(k for _, k in x)
    # the sample has as many of either label as it could get: back to the shares in all labels
    intercept += math.log(prior / (1 - prior)) - math.log((n1 + 1) / (len(x) - n1 + 1))
    return QualityModel(good, bad, slope, intercept, prior)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: its id, ``difference``, ``score`` and ``predicted``.

    ``difference`` is (size under bad - size under good) / bytes over the whole text; ``score`` its calibrated
    probability of label 1, drawn to the prior as texts get short. Null and empty texts have difference 0 and the prior
    as score. Repeated rows each give a row; other columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of dictionary_bytes at most

    def start():
        m = shared.value
        sizer = Sizer([m.good, m.bad], m.block)

        def one(text):
            data = _encode(text or "")
            if not data:
                return 0.0, m.prior
            d = _difference(sizer, data)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, m.slope * d + m.intercept))))
            w = len(data) / (len(data) + m.half)
            return d, w * p + (1 - w) * m.prior

        def work(ids, texts):
            out = [one(t) for t in texts]
            return ids, [x[0] for x in out], [x[1] for x in out], [int(x[1] >= threshold) for x in out]

        return work

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return per_document(docs, start, f"`{id_col}` {kind}, difference double, score double, predicted int", id_col, text_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    return score(docs, fit(docs, labels)).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "difference")
