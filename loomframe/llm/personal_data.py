"""Personal data: spans of fixed patterns, and further ones by a skip-chain conditional random field.

The field's nodes are the words that hold a digit, an at sign or an at in brackets; all other words are known to be no
personal data. Words that follow each other are linked, and so are, by skip edges, each word and the last one before it in
the document with the same characters or digits, with the same last digits, or of the same form, so a word that is plain
in one place settles what its likes are in others. What the patterns find is given; loopy message passing gives each other
word its marginals.

Weights, those of the skip edges included, are learned from documents whose pattern spans label the words. So that the
field learns what the patterns miss, half of the spans are rewritten in training into forms that no pattern matches, parts
of them are repeated further on, and other numbers of such shapes stand elsewhere.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_document, ranges, table

#: In the order in which spans that begin at one place are listed.
KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is tried once, at its beginning: if that fails, no later digit of it can do better
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[\[({]at[\])}]")
_WORD = re.compile(r"[^\x20\x09-\x0D]*(?:[0-9@]|[\[({]at[\])}])[^\x20\x09-\x0D]*")
_AT = re.compile(r"@|[\[({]at[\])}]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pattern_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, in code points, sorted; kinds are found apart and may overlap."""
    if not text:
        return []
    out = []
    end = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = at = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            out.append((start, end, 0))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def described(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


# ---- the field -------------------------------------------------------------------------------------------------


def _core(word: str, start: int) -> tuple[str, int]:
    """A word without the punctuation around it, and where it begins."""
    left = word.lstrip("\"'([{<,;:!?.*#$%&|=")
    start += len(word) - len(left)
    return left.rstrip("\"'])}>,;:!?.*#$%&|="), start


def _form(core: str) -> str:
    """The word's form: signs as they are, runs of letters and digits by kind and length."""
    return re.sub(r"[0-9]+|[^\W\d_]+", lambda m: f"9{min(len(m[0]), 20)}" if m[0][0].isdigit() else "a", core)


def word_features(core: str, before: str, after: str) -> list[str]:
    """Names of what holds of a word: its form, number of digits, checksum, signs, and the form of its neighbours."""
    digits = "".join(_DIGITS.findall(core))
    out = ["one", f"form={_form(core)[:40]}", f"digits={min(len(digits), 20)}", f"before={_form(before)[-12:]}", f"after={_form(after)[:12]}"]
    if at := _AT.search(core):
        out += ["at", f"local={at.start() > 0}", f"dots={min(core[at.end() :].count('.'), 2)}"]
    if 14 <= len(digits) <= 19:
        out.append(f"luhn={luhn(digits)}")
    parts = re.split(r"[^0-9]+", core)
    if len(parts) == 4:
        out.append(f"quad={all(p and len(p) < 4 and int(p) < 256 for p in parts)}")
    if re.search(r"[^\W\d_]", core):
        out.append("letters")
    if re.search(r"[^\x20().0-9+@-]", core):
        out.append("signs")
    return out


@dataclass
class Graph:
    """Words of one text that may be personal data: where they are, what holds of them, and the edges."""

    places: list[tuple[int, int]]
    features: list[list[str]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int, str]]


#: Kinds of skip edges: the same word, digits or name before an at; the same last four digits; the same form.
SKIPS = ("same", "part", "form")


def graph(text: str) -> Graph:
    places, features, chain, skip = [], [], [], []
    last: dict[tuple[str, str], int] = {}
    previous_end = None
    for m in _WORD.finditer(text):
        core, start = _core(m[0], m.start())
        if not core:
            continue
        i = len(places)
        places.append((start, start + len(core)))
        features.append(word_features(core, text[max(0, m.start() - 13) : m.start()].strip()[-12:], text[m.end() : m.end() + 13].strip()[:12]))
        if previous_end is not None and not text[previous_end : m.start()].strip():
            chain.append((i - 1, i))
        previous_end = m.end()
        digits = "".join(_DIGITS.findall(core))
        keys = [("same", core.lower()), ("form", _form(core))]
        if len(digits) >= 7:
            keys.append(("same", f"#{digits}"))
        if (at := _AT.search(core)) and at.start():
            keys.append(("same", core[: at.start()].lower()))
        if len(digits) >= 4:
            keys.append(("part", digits[-4:]))
        linked = set()
        for key in sorted(keys, key=lambda k: SKIPS.index(k[0])):
            j = last.get(key)
            if j is not None and j not in linked and not (key[0] == "form" and linked):
                linked.add(j)
                skip.append((j, i, key[0]))
            last[key] = i
    return Graph(places, features, chain, skip)


@dataclass(frozen=True)
class FieldModel:
    """Weights of each feature for each label, of neighbouring labels, and of skip edges that agree."""

    weights: dict
    chain: np.ndarray
    skip: dict

    def unary(self, features: list[str]) -> np.ndarray:
        out = np.zeros(OTHER + 1)
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                out += w
        return out


def marginals(g: Graph, m: FieldModel, rounds: int = 12, damping: float = 0.3, given: list[int] | None = None) -> np.ndarray:
    """Loopy sum-product: messages along all edges at once, damped, until they settle. Work is in proportion to edges.
    ``given`` labels other than OTHER are taken as certain."""
    n = len(g.places)
    unary = np.array([m.unary(f) for f in g.features]).reshape(n, OTHER + 1)
    edges = [(i, j, m.chain) for i, j in g.chain] + [(i, j, m.skip[k] * np.eye(OTHER + 1)) for i, j, k in g.skip]
    unary = np.exp(unary - unary.max(1, keepdims=True)) + 1e-12
    for i, k in enumerate(given or ()):
        if k != OTHER:
            unary[i] = 1e-12
            unary[i, k] = 1.0
    if not edges:
        return unary / unary.sum(1, keepdims=True)
    a = np.array([e[0] for e in edges] + [e[1] for e in edges])
    b = np.array([e[1] for e in edges] + [e[0] for e in edges])
    t = np.exp(np.array([e[2] for e in edges] + [e[2].T for e in edges]))
    k = len(edges)
    back = np.concatenate([np.arange(k, 2 * k), np.arange(k)])
    message = np.full((2 * k, OTHER + 1), 1.0 / (OTHER + 1))
    for _ in range(rounds):
        logs = np.log(message)
        total = np.log(unary)
        np.add.at(total, b, logs)
        out = total[a] - logs[back]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.einsum("ei,eij->ej", out, t)
        new /= new.sum(1, keepdims=True)
        new = np.maximum((1 - damping) * new + damping * message, 1e-30)
        change = float(np.abs(new - message).max())
        message = new
        if change < 1e-4:
            break
    total = np.log(unary)
    np.add.at(total, b, np.log(message))
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _labels(g: Graph, spans: list[tuple[int, int, int]]) -> list[int]:
    """The kind of the first span that covers a word, or OTHER."""
    out, at, longest = [], 0, max((b - a for a, b, _ in spans), default=0)
    for s, e in g.places:
        while at < len(spans) and spans[at][0] <= s - longest:
            at += 1
        kind, i = OTHER, at
        while i < len(spans) and spans[i][0] < e:
            if spans[i][1] > s:
                kind = spans[i][2]
                break
            i += 1
        out.append(kind)
    return out


def _rewritten(found: str, kind: int, rnd: random.Random) -> tuple[str, str]:
    """A form of a span that no pattern matches, and a part of it by which it may be named again."""
    digits = "".join(_DIGITS.findall(found))
    if kind == 0:
        name, domain = found.split("@", 1)
        return rnd.choice([f"{name}(at){domain}", f"{name}[at]{domain}", f"{name}@{domain.split('.')[0]}"]), name
    if kind == 1:
        return rnd.choice(["[.]", ",", "-", "_"]).join(found.split(".")), found
    if kind == 2:
        return rnd.choice(["/", ".", "_", "  "]).join(digits[i : i + 4] for i in range(0, len(digits), 4)), digits[-4:]
    area, rest = digits[-10:-7], f"{digits[-7:-4]}-{digits[-4:]}"
    return rnd.choice([f"{digits[:-10]} ({area}) {rest}".strip(), f"({area}) {rest}", f"{area}-{rest}", f"{area}.{rest.replace('-', '.')}", f"00{digits[:-10]} {area} {rest}"]), rest


def _decoy(rnd: random.Random) -> str:
    """A number that is no personal data by itself, of shapes that parts of personal data have."""
    n = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    return rnd.choice([n(4), n(4), f"{n(3)}-{n(4)}", f"{n(1)}.{n(1)}", f"{n(2)}-{n(2)}", f"20{n(2)}-{n(2)}-{n(2)}", n(7), f"{n(1)}.{n(1)}.{n(1)}", f"x{n(2)}"])


def variant(text: str, spans: list[tuple[int, int, int]], rnd: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with half of its spans rewritten, parts of some named again further on, and decoys; and where the spans are."""
    out, labels, size, at = [], [], 0, 0

    def put(piece: str, kind: int | None = None):
        nonlocal size
        out.append(piece)
        if kind is not None:
            labels.append((size, size + len(piece), kind))
        size += len(piece)

    for start, end, kind in spans:
        if start < at:
            continue
        put(text[at:start])
        form, part = _rewritten(text[start:end], kind, rnd)
        put(form if rnd.random() < 0.5 else text[start:end], kind)
        at = end
        if rnd.random() < 0.4:
            put(rnd.choice([" as said ", " or again: ", ", that is "]))
            if rnd.random() < 0.5 or not _ANY.search(part):
                put(_decoy(rnd))
            else:
                put(part, kind)
            put(" and so on ")
    put(text[at:])
    if rnd.random() < 0.5:
        put(f" see {_decoy(rnd)} there")
    return "".join(out), labels


def _dropped(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Where a pattern matched but failed and swallowed more than one thing: the words there have no label to learn from."""
    out = []
    for pattern, most in ((_CARD, 19), (_PHONE, 15)):
        for m in pattern.finditer(text):
            if sum(map(len, _DIGITS.findall(m[0]))) > most:
                out.append(m.span())
    return out


def train(texts: list[str], epochs: int = 10, rate: float = 0.5, ridge: float = 1e-3) -> FieldModel:
    """Weights by pseudo-likelihood: each word's label given its features and the labels of all its neighbours. Every text
    is learned from as it is and as a variant."""
    weights: dict[str, np.ndarray] = {}
    past: dict[str, np.ndarray] = {}
    size = OTHER + 1
    chain, chain_past = np.zeros((size, size)), np.full((size, size), 1e-6)
    skip, skip_past = dict.fromkeys(SKIPS, 0.0), dict.fromkeys(SKIPS, 1e-6)
    data, rnd = [], random.Random(11)
    for t in texts:
        spans = pattern_spans(t)
        for own, labelled in ((t, spans), variant(t, spans, rnd)):
            g = graph(own)
            if g.places:
                unsure = _dropped(own, labelled)
                labels = _labels(g, labelled)
                data.append((g, labels, [k == OTHER and any(a < e and s < b for a, b in unsure) for k, (s, e) in zip(labels, g.places, strict=True)]))
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for at in rng.permutation(len(data)):
            g, y, unsure = data[at]
            near: list[list] = [[] for _ in y]
            for i, j in g.chain:
                near[i].append((0, y[j]))
                near[j].append((1, y[i]))
            for i, j, k in g.skip:
                near[i].append((k, y[j]))
                near[j].append((k, y[i]))
            for i, f in enumerate(g.features):
                if unsure[i]:
                    continue
                z = np.zeros(size)
                for name in f:
                    z += weights.setdefault(name, np.zeros(size))
                for k, other in near[i]:
                    z = z + (chain[:, other] if k == 0 else chain[other] if k == 1 else skip[k] * (np.arange(size) == other))
                p = np.exp(z - z.max())
                p /= p.sum()
                d = -p
                d[y[i]] += 1
                if abs(d).max() < 1e-3:
                    continue
                for name in f:
                    w = weights[name]
                    step = d - ridge * w
                    h = past.setdefault(name, np.full(size, 1e-6))
                    h += step * step
                    w += rate * step / np.sqrt(h + 1)
                for k, other in near[i]:
                    if k in (0, 1):
                        own, own_past = (chain[:, other], chain_past[:, other]) if k == 0 else (chain[other], chain_past[other])
                        own_past += d * d
                        own += rate * d / np.sqrt(own_past + 1)
                    else:
                        skip_past[k] += d[other] ** 2
                        skip[k] = min(12.0, max(0.0, skip[k] + rate * d[other] / math.sqrt(skip_past[k] + 1)))
    return FieldModel(weights, chain, skip)


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = 1500) -> FieldModel:
    """Train on ``sample`` of the texts that hold a digit or an at sign, at most, drawn by a hash of the text and the id;
    equal texts count once. No such document: an untrained field, which adds nothing."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    total = own.count()
    draw = F.pmod(F.xxhash64("text", "id", F.lit(23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = own.where(draw < 1.2 * sample / max(total, 1)).select("text", F.xxhash64("text").alias("h"))
    rows = drawn.groupBy("h").agg(F.min("text").alias("text")).collect()
    texts = sorted((r["text"] for r in rows), key=lambda t: hashlib.sha256(t.encode("utf-8", "replace")).digest())[:sample]
    return train(texts)


def field_spans(text: str, base: list[tuple[int, int, int]], model: FieldModel, threshold: float = 0.9) -> list[tuple[int, int, int]]:
    """What the field adds: words of no base span whose kind has at least ``threshold``; neighbours of one kind are one."""
    if not model.weights:
        return []
    g = graph(text)
    if not g.places:
        return []
    labels = _labels(g, base)
    if all(k != OTHER for k in labels):
        return []
    p, joined = marginals(g, model, given=labels), set(g.chain)
    out: list[tuple[int, int, int]] = []
    previous = -2
    for i, (s, e) in enumerate(g.places):
        k = int(p[i].argmax())
        if labels[i] == OTHER and k != OTHER and p[i, k] >= threshold:
            if previous == i - 1 and out[-1][2] == k and (i - 1, i) in joined:
                out[-1] = (out[-1][0], e, k)
            else:
                out.append((s, e, k))
            previous = i
    # an opening bracket before the first word belongs to a closing one inside
    return [(s - 1, e, k) if s and text[s - 1] == "(" and text.count(")", s, e) > text.count("(", s, e) else (s, e, k) for s, e, k in out]


def all_spans(text: str | None, model: FieldModel, threshold: float = 0.9):
    """(base spans, base and added spans), each sorted."""
    base = pattern_spans(text)
    if not text or not _ANY.search(text):
        return base, base
    added = field_spans(text, base, model, threshold)
    return base, sorted([*base, *added], key=lambda s: (s[0], s[2], s[1])) if added else base


def masked(text: str | None, spans) -> str | None:
    """The text with each span as <KIND>; of spans that overlap, the first gives its kind and all are covered."""
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def find(docs: DataFrame, model: FieldModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """One row per row of ``docs``: its id, ``base`` and ``spans`` as arrays of (kind, start, end), and ``masked``.

    Null text has no spans and stays null. Repeated rows each give a row; other columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features of the bounded sample
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def start():
        m = shared.value

        def work(ids, texts):
            found = [all_spans(t, m, threshold) for t in texts]
            rows = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, e, k in spans]
            return ids, [rows(b) for b, _ in found], [rows(a) for _, a in found], [masked(t, a) for t, (_, a) in zip(texts, found, strict=True)]

        return work

    span = "array<struct<kind:string,start:int,end:int>>"
    return per_document(docs, start, f"`{id_col}` {kind}, base {span}, spans {span}, masked string", id_col, text_col)


def mask(docs: DataFrame, model: FieldModel, text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """``docs``, all rows and columns in their order, with personal data in ``text_col`` replaced by its kind."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        m = shared.value
        for batch in batches:
            for part in ranges(pc.binary_length(batch.column(at)).to_pylist()):
                columns = [c[part] for c in batch.columns]
                columns[at] = pa.array([masked(t, all_spans(t, m, threshold)[1]) for t in columns[at].to_pylist()], batch.column(at).type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, fit(docs))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
