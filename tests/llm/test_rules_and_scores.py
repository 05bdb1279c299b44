"""Statistics and rules against brute force; learned scores on held-out rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.llm import class_lm, language_id, quality_compression, quality_rules, toxicity

from .edges import EDGES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_statistics(docs):
    rnd = random.Random(0)
    texts = [*EDGES, *["".join(rnd.choice(["a ", "b ", "c ", "\n", "*", "é|"]) for _ in range(rnd.randint(0, 60))) for _ in range(60)]]
    got = {r["doc_id"]: r for r in quality_rules.statistics(docs(texts)).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_statistics(t)


def test_rules_are_learned_and_native(spark, docs):
    rnd = random.Random(1)
    texts = ["".join(f"w{rnd.randrange(500)}{'***' if i % 5 == 0 else ''} " for _ in range(40)) for i in range(400)]
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1, 0) for i in range(300)] + [(None, 0, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    stats = quality_rules.statistics(docs(texts))
    rules = quality_rules.learn(stats, labels)
    assert 1 <= len(rules.rules) <= 3
    judged = quality_rules.judge(stats, rules)
    assert [r["doc_id"] for r in judged.where("not kept").orderBy("doc_id").collect()] == list(range(0, 400, 5))
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_without_labels_everything_is_kept(spark, docs):
    stats = quality_rules.statistics(docs(["a b c d e f g h i j"]))
    for rows in ([], [(0, 1)]):
        assert quality_rules.learn(stats, spark.createDataFrame(rows, "doc_id bigint, quality int")).rules == ()
    assert quality_rules.judge(stats, quality_rules.DecisionList(())).first()["kept"]


@pytest.mark.parametrize("n", [0, 1, 5, 127, 128, 129, 300])
def test_marginals_are_exact(n):
    rng = np.random.default_rng(n)
    e, t = rng.normal(size=n) * 3, rng.normal(size=(2, 2))
    m, forward, state = np.exp(t), np.zeros((n, 2)), np.array([1.0, 0.0])
    for k in range(n):
        state = state @ m
        state[1] *= np.exp(e[k])
        state /= state.sum()
        forward[k] = state
    back = np.ones((n, 2))
    for k in range(n - 1, 0, -1):
        v = m @ (back[k] * [1, np.exp(e[k])])
        back[k - 1] = v / v.sum()
    p = forward * back
    want = p[:, 1] / p.sum(1)
    assert np.allclose(toxicity.marginals([e[:2], e], t)[1], want)


def toxic_corpus(n):
    rnd = random.Random(4)
    texts, labels = [], []
    for i in range(n):
        words = [f"w{rnd.randrange(300)}" for _ in range(rnd.randint(20, 80))]
        if i % 4 == 0:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(["vile", "rotten", "foul"])
        texts.append(" ".join(words))
        labels.append((i, 1 if i % 3 else 0, int(i % 4 == 0)))
    return texts, labels


def test_toxic_spans(spark, docs):
    texts, labels = toxic_corpus(600)
    table = docs(texts)
    model = toxicity.fit(table, spark.createDataFrame(labels[:400], "doc_id bigint, quality int, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(table, model).collect()}
    for i in range(400, 600):
        assert got[i]["predicted"] == labels[i][2]
        assert {texts[i][s["start"] : s["end"]] for s in got[i]["spans"]} <= {" ".join(c) for k in (1, 2, 3) for c in __import__("itertools").product(["vile", "rotten", "foul"], repeat=k)}
        assert bool(got[i]["spans"]) == bool(labels[i][2])
    edges = toxicity.score(docs(EDGES), model).collect()
    assert len(edges) == len(EDGES) and all(0 <= r["score"] <= 1 for r in edges) and edges[0]["spans"] == []


def test_scores_without_labels(spark, docs):
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for made in (toxicity.score(docs(EDGES), toxicity.fit(docs(EDGES), empty)), quality_compression.score(docs(EDGES), quality_compression.fit(docs(EDGES), empty))):
        rows = made.collect()
        assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in language_id.identify(docs(EDGES), language_id.fit(docs(EDGES).limit(0))).collect()} == {"und"}


def test_language_edges(spark):
    rows = [(i, " ".join(random.Random(i).choices(w, k=30)), k) for i in range(80) for k, w in (("xx", ["bana", "toru", "kemi"]), ("yy", ["gröl", "ståp", "frem"]))]
    table = spark.createDataFrame([(2 * n + (k == "yy"), t, k) for n, (_, t, k) in enumerate(rows)], "doc_id bigint, text string, lang string")
    model = language_id.fit(table)
    ask = spark.createDataFrame([(1, "toru bana kemi toru bana"), (2, "frem gröl ståp gröl"), (3, None), (4, "12 34!"), (5, ""), (1, "kemi")], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in language_id.identify(ask, model).select("doc_id", "lang_pred").collect())
    assert got == [(1, "xx"), (1, "xx"), (2, "yy"), (3, "und"), (4, "und"), (5, "und")]


def test_learned_rules_on_held_out_rows(spark):
    """The list isn't empty, and most of what it rejects beyond the base rule is labelled so, among rows it hasn't seen."""
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no sample tables")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    unseen = "crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"
    stats = quality_rules.statistics(spark.read.parquet(f"{sf}/documents.parquet"))
    rules = quality_rules.learn(stats, labels.where(f"not {unseen}"))
    assert rules.rules
    rows = quality_rules.judge(stats, rules).where("not base_failed").join(labels.where(unseen), "doc_id").select("rule", "quality").collect()
    hit = [r["quality"] == 0 for r in rows if r["rule"]]
    assert sum(hit) >= 0.9 * len(hit) and sum(hit) >= 0.8 * sum(r["quality"] == 0 for r in rows) > 3


def brute_size(content, data, block):
    """Compressed bytes under a raw-content dictionary, each block by itself; independent of the sizer's own dictionaries."""
    import zstandard

    from loomframe.llm import zcompress

    d = zstandard.ZstdCompressionDict(content + zcompress.PAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)

    def params(search_log):
        return zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, min_match=4, search_log=search_log, window_log=17, hash_log=16, chain_log=16, write_content_size=0, write_checksum=0, write_dict_id=0)

    return lambda search_log: sum(len(zstandard.ZstdCompressor(dict_data=d, compression_params=params(search_log)).compress(zcompress.PAD + data[i : i + block])) for i in range(0, len(data), block))


def test_language_against_brute_force(spark):
    """The language of the least mean size, for short and long texts alike."""
    from loomframe.llm import zcompress

    rnd = random.Random(4)
    words = {"xx": ["bana", "toru", "kemi", "lopa"], "yy": ["gröl", "ståp", "frem", "lopa"], "zz": ["quix", "vemp", "toru"]}
    rows = [(i, " ".join(rnd.choices(words[k], k=rnd.randint(1, 400))), k) for i, k in enumerate(rnd.choices(list(words), k=150))]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    ask = [" ".join(rnd.choices(words[rnd.choice(list(words))] + ["lopa", "toru"], k=rnd.choice([1, 2, 5, 60, 1500]))) for _ in range(40)]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.createDataFrame(list(enumerate(ask)), "doc_id bigint, text string"), model).collect()}
    for i, t in enumerate(ask):
        data = zcompress.letters_only(t)
        sizes = [sum(brute_size(c, data, model.block)(3) for c in shard) for shard in model.shards]
        assert got[i] == model.languages[sizes.index(min(sizes))]
    with pytest.raises(ValueError):
        language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), most_languages=2)


def test_quality_against_brute_force(spark, docs):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choices(["good", "fine", "prose"] if i % 2 else ["buy", "###", "now!!"], k=rnd.randint(5, 200))) for i in range(80)]
    labels = spark.createDataFrame([(str(i), i % 2) for i in range(80)], "doc_id string, quality int")
    table = docs([*texts, *EDGES]).withColumn("doc_id", F.col("doc_id").cast("string"))  # ids may be text
    model = quality_compression.fit(table, labels)
    for r in quality_compression.score(table, model).collect():
        data = ([*texts, *EDGES][int(r["doc_id"])] or "").encode()
        want = (brute_size(model.bad, data, model.block)(2) - brute_size(model.good, data, model.block)(2)) / len(data) if data else 0.0
        assert math.isclose(r["difference"], want, abs_tol=1e-12)
        assert not data or len(data) < 40 or int(r["doc_id"]) >= 80 or r["predicted"] == int(r["doc_id"]) % 2


def test_every_text_gives_to_a_dictionary():
    from loomframe.llm import zcompress

    texts = [bytes([65 + i]) * n for i, n in enumerate([10, 5000, 300, 2000, 1, 900])]
    made = zcompress.build_content(texts, 1200)
    assert set(made.split(b"\n")) >= {texts[0], texts[4]} and len(made) <= 1200 and len({c for c in made if c != 10}) == 6 and len(made) > 1100


def test_toxicity_with_text_ids_and_every_window(spark, docs):
    texts = ["fine words here and there " * 5 if i % 2 else "you vile scum " * 200 for i in range(60)]
    table = docs(texts).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    labels = spark.createDataFrame([(f"d{i}", 1 - i % 2) for i in range(60)], "doc_id string, toxic int")
    rows = toxicity.score(table, toxicity.fit(table, labels)).collect()
    assert all(r["predicted"] == 1 - int(r["doc_id"][1:]) % 2 for r in rows)


def held_out(scored, labels, fold):
    own = {r["doc_id"]: r for r in scored.where("held_out").collect()}
    assert all(zlib.crc32(str(i).encode()) % fold[0] == fold[1] for i in own)
    return [(own[i]["score"], y) for i, y in labels if i in own]


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_held_out_rows(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no sample tables")
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert auc(held_out(quality_compression.query(spark, sf), [(r["doc_id"], r["quality"]) for r in labels], (4, 2))) > 0.9
    assert auc(held_out(toxicity.query(spark, sf), [(r["doc_id"], r["toxic"]) for r in labels], (3, 1))) > 0.75
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = language_id.query(spark, sf).where("held_out").collect()
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in rows) > 0.97 * len(rows)


def test_language_model(docs):
    rnd = random.Random(5)
    texts = [*EDGES, *[" ".join(rnd.choices(["the", "a", "cat", "dog", "sat", "ran", "x%d" % rnd.randrange(50)], k=rnd.randint(1, 30))) for _ in range(60)]]
    table = docs(texts)
    train = table.where("doc_id % 3 <> 0")
    got = {r["doc_id"]: r for r in class_lm.score(table, class_lm.fit(train, units=8, n_classes=3, common=10)).collect()}
    split = lambda t: [*((t or "").encode().lower().split()), b" "]
    counts = collections.Counter(w for i, t in enumerate(texts) if i % 3 for w in split(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        words, r = split(t), got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), abs_tol=1e-9 * len(words))
        assert r["score"] < 0 and math.isclose(r["perplexity"], 10 ** (-r["score"] / r["n_tokens"]))


def test_class_model_against_brute_force(docs):
    """Every word that stands twice has a class, counts are the corpus's, and scores are sums over the path of classes."""
    rnd = random.Random(8)
    texts = [*EDGES, *[" ".join(rnd.choices(["the", "a", "cat", "dog", "sat", "ran", *("x%d" % rnd.randrange(60) for _ in range(4))], k=rnd.randint(1, 30))) for _ in range(80)]]
    table = docs(texts)
    model = class_lm.fit(table.where("doc_id % 4 <> 0"), units=6, n_classes=4, common=9)
    tail = {r["word"].encode(): (r["n"], r["class"]) for r in model.tail.collect()}
    split = lambda t: [*((t or "").encode().lower().split()), b" "]
    counts = collections.Counter(w for i, t in enumerate(texts) if i % 4 for w in split(t))
    assert {w: n for w, (n, _) in [*model.common.items(), *tail.items()]} == counts and len(tail) > 10
    rare = len(model.room) - 1
    assert all((c == rare) == (n == 1) for n, c in tail.values()) and all(c < rare for _, c in model.common.values())
    of = lambda w: model.common.get(w) or tail.get(w) or (0, rare)
    words, mass = collections.Counter({rare: 1}), collections.Counter()
    for w, n in counts.items():
        words[of(w)[1]] += 1
        mass[of(w)[1]] += n
    for c in words:
        assert math.isclose(model.room[c], math.log10(mass[c] + 0.5 * words[c]))
    assert np.allclose((10**model.step).sum(1), 1)
    got = {r["doc_id"]: r["score"] for r in class_lm.score(table, model).collect()}
    for i, t in enumerate(texts):
        path, want = of(b" ")[1], 0.0
        for w in split(t):
            n, c = of(w)
            want += model.step[path, c] + math.log10(n + 0.5) - model.room[c]
            path = c
        assert math.isclose(got[i], want, rel_tol=1e-9, abs_tol=1e-9)


def test_best_class_is_that_of_like_words():
    """Against all classes in turn: the log-likelihood of a word's neighbours with the word in that class."""
    rng = np.random.default_rng(3)
    M = rng.poisson(30, (4, 4))
    before, after = rng.poisson(2, (50, 3)), rng.poisson(2, (50, 3))
    n = before.sum(1) + 1
    for w, c in enumerate(class_lm.best_classes(before, after, n, np.full(50, -1), M)):
        worth = [sum(before[w, x] * math.log(M[x, y] + 0.5) + after[w, x] * math.log(M[y, x] + 0.5) for x in range(3)) - after[w].sum() * math.log(M[y].sum() + after[w].sum() + 0.5) - n[w] * math.log(M[:, y].sum() + n[w] + 0.5) for y in range(3)]
        assert math.isclose(worth[c], max(worth))


def test_model_of_nothing(docs):
    table = docs(EDGES)
    rows = class_lm.score(table, class_lm.fit(table.limit(0))).collect()
    assert len(rows) == len(EDGES) and all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in rows)


def test_exchange_finds_classes_and_never_loses_likelihood():
    rng = np.random.default_rng(0)
    # units 0-4 are followed by 5-9 and the other way round; 10 is fixed
    pairs = np.zeros((11, 11), int)
    for _ in range(4000):
        a, b = rng.integers(5), 5 + rng.integers(5)
        pairs[a, b] += 1
        pairs[b, rng.integers(5)] += 1
    pairs[10, 0] = pairs[4, 10] = 5
    cls = class_lm.exchange(pairs, 10, 2)
    assert len(set(cls[:5])) == 1 and len(set(cls[5:10])) == 1 and cls[0] != cls[5] and cls[10] == 2

    def likelihood(pairs, cls):
        m = np.zeros((cls.max() + 1,) * 2)
        np.add.at(m, (cls[:, None], cls[None, :]), pairs)
        x = lambda a: np.where(a > 0, a * np.log(np.maximum(a, 1e-300)), 0).sum()
        return x(m) - x(m.sum(0)) - x(m.sum(1))

    for seed in range(5):
        pairs = np.random.default_rng(seed).poisson(3, (14, 14))
        cls = class_lm.exchange(pairs, 12, 3, rounds=50)
        for u in range(12):
            for k in range(3):
                other = cls.copy()
                other[u] = k
                assert likelihood(pairs, other) <= likelihood(pairs, cls) + 1e-6


def test_words_looked_up_are_the_tokens():
    """Whole batches at once, against text by text: odd white space, other alphabets' capitals, null and empty texts."""
    import pyarrow as pa

    texts = [*EDGES, "\x1c a\x1d\x85 B c\x00 É\x0b\x0cZ ", " x", "\n\n", None, "", "a X"]
    words = [b"x", class_lm.END, b"a"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])
    ((_, _, own, numbers, sizes),) = class_lm._looked_up([batch], words, 1)
    each = [class_lm.tokens(t) for t in texts]
    assert [w.encode() for w in own.to_pylist()] == [w for t in each for w in t]
    assert numbers.tolist() == [words.index(w) if w in words else 3 for t in each for w in [*t, class_lm.END]]
    assert sizes.tolist() == [len(t) + 1 for t in each]


def test_exchange_counts_in_bounded_memory(spark, monkeypatch):
    """What a task holds while it counts the classes beside words doesn't grow with the words; the parts add up to the whole."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    m, k = 1 << 22, 40  # a table of all words and classes would take 1.4 GB
    texts = [rng.integers(0, m + 1, n) for n in (0, 1, 2, 3000, 50)]
    batch = pa.RecordBatch.from_arrays([pa.array([class_lm.pack(t) for t in texts], pa.binary())], names=["data"])
    classes = np.append(rng.integers(0, k, m), k)
    tracemalloc.start()
    monkeypatch.setattr(class_lm, "PLACES", 64)
    parts = list(class_lm._counted(class_lm._cells([batch], classes, m, k)))
    assert tracemalloc.get_traced_memory()[1] < 10_000_000
    tracemalloc.stop()
    got, want = collections.Counter(), collections.Counter()
    for cells, n in parts:
        assert len(cells) <= 4 * 64
        got.update(dict(zip(cells.tolist(), n.tolist(), strict=True)))
    for t in texts:
        for a, b in zip(t[:-1], t[1:], strict=True):
            want.update([int(b) * 2 * (k + 1) + int(classes[a])] if b < m else [])
            want.update([int(a) * 2 * (k + 1) + k + 1 + int(classes[b])] if a < m else [])
    assert len(parts) > 10 and got == want

    # one round of exchange decides by the sums over all tasks
    m, k, texts = 300, 5, [rng.integers(0, 301, 2000) for _ in range(6)]
    numbers = spark.createDataFrame([(class_lm.pack(t),) for t in texts], "data binary").repartition(3)
    classes = np.append(rng.integers(0, k, m), k).astype(np.int16)
    M = rng.poisson(30, (k + 1, k + 1))
    before, after = np.zeros((2, m + 1, k + 1), int)
    for t in texts:
        np.add.at(before, (t[1:], classes[t[:-1]]), 1)
        np.add.at(after, (t[:-1], classes[t[1:]]), 1)
    want = class_lm.best_classes(before[:m, :k], after[:m, :k], before[:m].sum(1), classes[:m].astype(int), M)
    got = class_lm._exchanged(numbers, classes, M, k)
    assert (got[:m] == want).all() and got[m] == k and (got != classes).any()
