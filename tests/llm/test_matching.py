"""Joins, links and spans against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from loomframe.llm import components, decontamination, near_duplicates, personal_data, tool_calls
from loomframe.llm.common import drop_written, release, shared_dir, written

from .edges import EDGES

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_groups(texts, n, percent):
    sets = [shingles(t, n) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("seed, n, percent", [(0, 4, 85), (1, 2, 60), (2, 5, 80)])
def test_near_duplicates(docs, seed, n, percent):
    """Chains of edited copies, of which neighbours are alike and ends are not, exact copies, short and shared texts."""
    rnd = random.Random(seed)
    texts = [*EDGES, "a b", "A B", "b a", "a b c", "\ta b"]
    shared = " ".join(f"s{i}" for i in range(12))
    for _ in range(6):
        words = [f"w{rnd.randrange(60)}" for _ in range(rnd.randint(5, 60))]
        for _ in range(rnd.randint(1, 12)):
            texts.append(" ".join(words))
            if rnd.random() < 0.7:
                words = list(words)
                words[rnd.randrange(len(words))] = f"v{rnd.randrange(1000)}"
            if rnd.random() < 0.2:
                words = [*words, *shared.split()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.group(docs(texts), n=n, percent=percent).collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(texts, n, percent)
    if seed == 0:
        kept = [r["doc_id"] for r in near_duplicates.deduplicate(docs(texts), n=n, percent=percent).orderBy("doc_id").collect()]
        assert kept == [i for i, (_, c) in enumerate(brute_groups(texts, n, percent)) if c == i]


def test_near_duplicates_of_nothing_and_null_ids(docs):
    assert near_duplicates.group(docs([])).count() == 0
    rows = near_duplicates.group(docs(["a b c d e", "a b c d e", "x"], ids=[None, 7, None]), n=4).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == sorted([(None, 2, 7), (7, 2, 7), (None, 1, None)], key=repr)


def test_one_row_of_each_group_is_kept(docs):
    """Also where ids are null or repeated."""
    table = docs(["a b c d e f", "a b c d e f", "q r s", "q r s", "x", None, None], ids=[1, 1, 1, None, None, None, 1])
    kept = [(r["doc_id"], r["text"]) for r in near_duplicates.deduplicate(table).collect()]
    assert sorted(kept, key=repr) == sorted([(1, "a b c d e f"), (1, "q r s"), (None, "x"), (None, None), (1, None)], key=repr)


def test_counted_strips_are_deleted(spark, docs, monkeypatch):
    """When prefixes are chosen, no table has the strips any more that n-grams were counted from."""
    import glob

    import pyarrow.parquet as pq

    root, seen = shared_dir(spark), []
    before, choose = set(glob.glob(f"{root}/sets-*")), near_duplicates._prefixes

    def look(*given):
        for path in set(glob.glob(f"{root}/sets-*")) - before:
            seen.extend(x for f in glob.glob(f"{path}/**/*.parquet", recursive=True) for x in pq.ParquetFile(f).read(["strip"])["strip"].to_pylist() if x is not None)
        return choose(*given)

    monkeypatch.setattr(near_duplicates, "_prefixes", look)
    rnd = random.Random(7)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(30)) for _ in range(20)]
    got = {r["doc_id"]: r for r in near_duplicates.group(docs(texts * 2), n=3, percent=70).collect()}
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(40)] == brute_groups(texts * 2, 3, 70)
    assert set(seen) == {-1}


def test_shuffle_files_of_the_last_query_go(spark):
    import time

    blocks = lambda: {b for b in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in b}
    before = blocks()
    drop_written(written(spark.range(2000).repartition(7, "id"), "moved"))
    assert blocks() - before
    release(spark)
    for _ in range(50):
        if not blocks() - before:
            break
        time.sleep(0.2)
    assert not blocks() - before


def test_shared_slots(spark):
    """Counts against brute force, n-grams that only other sets have left out; no set is sent through a shuffle."""
    rnd = np.random.default_rng(6)
    some = rnd.integers(-(1 << 63), 1 << 63, 300)
    own = {int(n): np.unique(rnd.choice(some, 40)) for n in rnd.integers(-(1 << 63), 1 << 63, 12)}
    sets = spark.createDataFrame([(n, len(g), bytearray(g.tobytes())) for n, g in own.items()], "node bigint, size int, grams binary")
    wanted = list(own)[:8]
    frame = near_duplicates._shared_slots(spark.createDataFrame([(n,) for n in wanted], "node bigint"), sets)
    got = {r["node"]: r["slots"] for r in frame.collect()}
    times = collections.Counter(int(g) for n in wanted for g in own[n])
    for n in wanted:
        slots = [0] * near_duplicates.SIGNATURE
        for g in own[n].tolist():
            slots[(g % (1 << 64)) >> 58] += times[g] > 1
        assert got[n] == slots
    assert 1 in times.values()
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        frame = near_duplicates._shared_slots(spark.createDataFrame([(n,) for n in wanted], "node bigint"), sets)
        plan = frame._jdf.queryExecution().executedPlan()
        stack = [plan.initialPlan()]
        while stack:
            p = stack.pop()
            assert p.nodeName() != "Exchange" or "grams#" not in p.output().mkString(",")
            stack.extend(p.children().apply(i) for i in range(p.children().size()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)


def test_packed_numbers():
    columns = [np.array([0, 5, 1 << 40], np.uint64), np.zeros(0, np.uint64), np.array([255]), np.zeros(3, int), np.array([(1 << 64) - 1], np.uint64)]
    assert [x.tolist() for x in near_duplicates.unpack(near_duplicates.pack(*columns))] == [x.tolist() for x in columns]


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in nodes}


def test_decontamination(spark, docs):
    rnd = random.Random(2)
    item = [f"b{rnd.randrange(400)}" for _ in range(30)]
    edited = [w if i % 8 != 3 else "zz" for i, w in enumerate(item)]
    other = [f"o{rnd.randrange(400)}" for _ in range(60)]
    pad = [f"p{rnd.randrange(900)}" for _ in range(50)]
    texts = [" ".join(pad + item + pad), " ".join(pad + edited + pad), " ".join(other), " ".join(item[5:25]), " ".join(item[:8]), " ".join(pad + ["one", "Two", "three", "four", "five"]), " ".join(item).upper(), *EDGES]
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, "one two three four five"), (3, None), (4, "two words"), (None, " ".join(other)), (5, "")], "item_id bigint, text string")
    table = docs(texts)
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.find(table, bench).collect()}
    assert set(got) == {(0, 1), (1, 1), (3, 1), (5, 2), (6, 1)}
    assert (got[0, 1]["n_overlap"], got[0, 1]["n_matched"], got[0, 1]["first_word"]) == (30, 30, 50)
    assert 20 <= got[1, 1]["n_matched"] <= sum(a == b for a, b in zip(item, edited, strict=True))
    left = decontamination.decontaminate(table, bench)
    assert left.columns == table.columns and {r["doc_id"] for r in left.collect()} == set(range(len(texts))) - {0, 1, 3, 5, 6}
    assert decontamination.find(table, bench.limit(0)).count() == 0 and decontamination.find(table.limit(0), bench).count() == 0


def test_rows_are_decontaminated_one_by_one(spark, docs):
    """Rows that share an id, or have none, each count for themselves."""
    item = " ".join(f"b{i}" for i in range(20))
    clean = " ".join(f"c{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    table = docs([item, clean, item, clean, None], ids=[None, None, 5, 5, 6])
    left = decontamination.decontaminate(table, bench)
    assert left.columns == table.columns and sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([(None, clean), (5, clean), (6, None)], key=repr)


def test_decontamination_of_capitals(spark, docs):
    """Capitals with accents, of other scripts, and those that change a word's length are the same words."""
    items = ["l'été où la forêt brûlée était à côté du château près de Besançon hélas", "στο τέλος ο δρόμος είναι μακρύς και ο λόγος σοφός εδώ πάντα ΟΔΟΣ", "die straße an der großen schleuße heißt süß und müßig außer für füße"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    texts = [items[0].upper(), items[1].upper(), items[2].upper(), items[0], "x " + items[1].title(), "nothing of them at all"]
    got = {(r["doc_id"], r["item_id"], r["n_matched"]) for r in decontamination.find(docs(texts), bench).collect()}
    assert got == {(d, i, len(items[i].split())) for d, i in enumerate((0, 1, 2, 0, 1))}


def test_every_window_is_looked_at(spark, docs):
    """Brute force: any two passages that share twelve words in a row overlap, wherever they stand."""
    rnd = random.Random(3)
    items = [[f"i{k}_{j}" for j in range(rnd.randint(12, 40))] for k in range(20)]
    texts, want = [], set()
    for d in range(60):
        words = [f"d{d}_{j}" for j in range(40)]
        if d % 2:
            k = rnd.randrange(20)
            start = rnd.randint(0, len(items[k]) - 12)
            at = rnd.randint(0, 40)
            words[at:at] = items[k][start : start + 12]
            want.add((d, k))
        texts.append(" ".join(words))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find(docs(texts), bench).collect()} == want


def test_substitutions_at_all_places(spark, docs):
    """Brute force: items of 5 to 20 words with up to a fifth of their words substituted, at all places or at many, and
    passages of 10 words with two; none is missed, none has less than four fifths of its words."""
    rnd = random.Random(9)
    items = {n: [f"i{n}_{k}" for k in range(n)] for n in [*range(5, 21), 40]}
    texts, want = [], {}
    for n, item in items.items():
        for wrong in range(n // 5 + 2 if n < 40 else 0):
            places = list(itertools.combinations(range(n), wrong))
            for at in rnd.sample(places, min(len(places), 60)):
                words = [w if k not in at else "zz" for k, w in enumerate(item)]
                windows = [(lo, hi) for lo in range(n) for hi in range(lo + min(10, n), n + 1)]
                if any(5 * sum(w != "zz" for w in words[lo:hi]) >= 4 * (hi - lo) for lo, hi in windows):
                    want[len(texts)] = n
                texts.append(" ".join(["p", *words, "q"]))
    for at in itertools.combinations(range(10), 2):
        want[len(texts)] = 40
        texts.append(" ".join(["p", *(w if k not in at else "zz" for k, w in enumerate(items[40][17:27])), "q"]))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id bigint, text string")
    got = decontamination.find(docs(texts), bench).collect()
    assert {r["doc_id"]: r["item_id"] for r in got} == want
    assert all(r["n_overlap"] >= min(10, r["item_id"]) and 5 * r["n_matched"] >= 4 * r["n_overlap"] for r in got)


def test_best_overlap_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(200):
        words, item = rng.integers(0, 3, 20).astype(np.uint64), rng.integers(0, 3, 9).astype(np.uint64)
        diagonals = list(range(-8, 20))
        best = max(((same.sum() * 0.2 - (~same).sum() * 0.8) for d in diagonals for lo in range(max(0, d), min(20, d + 9)) for hi in range(lo + 1, min(20, d + 9) + 1) if (same := words[lo:hi] == item[lo - d : hi - d]) is not None), default=0)
        n, matched, _ = decontamination.best_overlap(words, item, diagonals, 0.8)
        assert matched * 0.2 - (n - matched) * 0.8 <= best + 1e-6 and n <= 9


def brute_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(s, e, k) for s, k, e in sorted(out)]


def test_pattern_spans():
    rnd = random.Random(6)
    parts = ["a@b.c", "a@b", "@b.c", "x.y+z@d-e.f.g", "1.2.3.4", "1.2.3.4.5", "300.1.1.1", "0001.2.3.4", "4041894974608795", "4041-8949 7460 8795", "+1 (988) 555-2485", "+12", "+1 2 3 4 5 6 7 8 9 0", " ", ".", "-", "é", "7", "+", "@", "word", "\n"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 10)))
        assert personal_data.pattern_spans(text) == brute_spans(text), text


@pytest.fixture(scope="module")
def field():
    rnd = random.Random(7)
    texts = []
    for i in range(300):
        words = [f"word{chr(97 + rnd.randrange(26))}" for _ in range(12)]
        words[4] = rnd.choice([f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}", f"u{i}@mail.example.com", f"{rnd.randint(1, 255)}.{rnd.randint(1, 255)}.7.9", "4041894974608795", "version 3.0", "2024."])
        texts.append(" ".join(words))
    return personal_data.train(texts)


def test_field_adds_what_is_like_what_it_knows(field):
    text = "call +1 (988) 555-2485 now or 1 (988) 555-2485 later, version 2.0 of 2023"
    base, spans = personal_data.all_spans(text, field)
    assert set(base) <= set(spans)
    assert [text[s:e] for s, e, _ in spans if (s, e) not in {x[:2] for x in base}] == ["1 (988) 555-2485"]
    assert personal_data.masked(text, spans) == "call <PHONE> now or <PHONE> later, version 2.0 of 2023"
    for clean in ("in 2024 version 3.0 came", "a 1 b 2 c 3", "pages 10-12 and 14."):
        assert personal_data.all_spans(clean, field) == ([], [])


def test_field_finds_what_patterns_miss_in_a_table(docs, field):
    """Spans that no pattern matches: rewritten forms, numbers that a pattern swallowed, and parts named again."""
    planted = {
        "write to u7(at)mail.example.com please": ["u7(at)mail.example.com"],
        "call +1 (988) 555-2485 190.137.223.204 now": ["+1 (988) 555-2485"],
        "dial (988) 555-2485 now": ["(988) 555-2485"],
        "it is 4041.8949.7460.8795 then": ["4041.8949.7460.8795"],
        "from 97[.]51[.]17[.]173 again": ["97[.]51[.]17[.]173"],
        "card 4041894974608795 was used, as said 8795 and so on": ["8795"],
        "as said 8795 and so on": [],
        "version 3.0 of 2024. see 12-14 there": [],
    }
    rows = personal_data.find(docs(list(planted)), field).collect()
    added = {t: [t[s["start"] : s["end"]] for s in r["spans"] if s not in r["base"]] for r, t in zip(sorted(rows, key=lambda r: r["doc_id"]), planted, strict=True)}
    assert added == planted


def test_skip_messages_change_labels(field):
    """The part of a number is personal data only because of the whole number elsewhere; the weights were learned."""
    text = "card 4041894974608795 was used, as said 8795 and so on"
    assert field.skip["part"] > 1 and field.skip["same"] > 1
    without = personal_data.FieldModel(field.weights, field.chain, dict.fromkeys(field.skip, 0.0))
    assert len(personal_data.all_spans(text, field)[1]) == 2 and len(personal_data.all_spans(text, without)[1]) == 1


def test_variants_keep_their_labels():
    rnd = random.Random(1)
    text = "a u1@mail.example.com b +1 (988) 555-2485 c 4041894974608795 d 1.2.3.4 e"
    spans = personal_data.pattern_spans(text)
    for _ in range(50):
        new, labels = personal_data.variant(text, spans, rnd)
        assert labels == sorted(labels) and len(labels) >= 4 and all(re.search("[0-9]|at|@", new[s:e]) for s, e, _ in labels)
        assert re.sub(r"\s", "", new).startswith("a")


def test_message_passing_is_exact_on_chains(field):
    import itertools

    g = personal_data.graph("7 8.8 +1 (988) x@y.zz 555-2485")
    assert g.chain and len(g.places) >= 5
    chain = personal_data.Graph(g.places, g.features, g.chain, [])
    n, size = len(g.places), personal_data.OTHER + 1
    unary = np.array([field.unary(f) for f in g.features])
    total = np.zeros((n, size))
    weights = []
    for y in itertools.product(range(size), repeat=n):
        weights.append((y, sum(unary[i, k] for i, k in enumerate(y)) + sum(field.chain[y[i], y[j]] for i, j in g.chain)))
    most = max(w for _, w in weights)
    for y, w in weights:
        for i, k in enumerate(y):
            total[i, k] += np.exp(w - most)
    assert np.allclose(personal_data.marginals(chain, field, rounds=60, damping=0.0), total / total.sum(1, keepdims=True), atol=1e-4)


def test_personal_data_tables(docs, field):
    table = docs([*EDGES, EDGES[-1]])
    rows = sorted(personal_data.find(table, field).collect(), key=lambda r: r["doc_id"])
    for r, t in zip(rows, [*EDGES, EDGES[-1]], strict=True):
        assert [(s["start"], s["end"], personal_data.KINDS.index(s["kind"])) for s in r["base"]] == brute_spans(t or "")
    masked = personal_data.mask(table, field)
    assert masked.columns == table.columns and masked.where("doc_id = 0").first()["text"] is None
    assert masked.where("doc_id = 9").first()["text"] == "<EMAIL> <PHONE> <CARD> <IP>"
    untrained = personal_data.fit(docs(["no digits"]))
    assert personal_data.find(table, untrained).where("size(base) <> size(spans)").count() == 0
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(personal_data.described([]).encode()).hexdigest()


SCHEMAS = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["number", "null"]}, "c": {"type": "array", "maxItems": 2, "items": {"enum": [1, "x"]}}, "d": {"type": "string", "pattern": "^q", "minLength": 2}}}}


@pytest.mark.parametrize(
    "arguments, text, problem",
    [
        ('{"b": 1.50, "a": 1.0}', '{"a":1,"b":1.5}', ""),
        ('{"a": -1}', '{"a":-1}', "$.a: out of range"),
        ('{"b": null}', '{"b":null}', "$.a: missing"),
        ('{"a": 1, "z": 2}', '{"a":1,"z":2}', "$.z: not allowed"),
        ('{"a": 1, "c": [1, 2, "x"]}', '{"a":1,"c":[1,2,"x"]}', "$.c: 3 items; $.c[1]: not one of the listed values"),
        ('{"a": 1, "d": "é"}', '{"a":1,"d":"é"}', "$.d: 1 characters; $.d: doesn't match"),
        ('{"a": true}', '{"a":true}', "$.a: not of type integer"),
        ("[]", "[]", "$: not of type object"),
        ("{", None, "$: not JSON"),
        ('{"a": NaN}', None, "$: not JSON"),
        ('{"a": 1, "a": 2}', None, "$: a key stands twice"),
        (None, None, "$: no arguments"),
        ('{"d": "\\ud800", "a": 1}', None, "$: not JSON"),
        ('{"a": 100000000000000000000000000}', '{"a":1e+26}', ""),
        ('{"a": 1' + "0" * 400 + "}", None, "$: not JSON"),
    ],
)
def test_arguments(arguments, text, problem):
    assert tool_calls.checked("add", arguments, SCHEMAS) == (text, problem)


@pytest.mark.parametrize(
    "schema, good, bad",
    [
        ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ["a", 3], [2]),
        ({"oneOf": [{"minimum": 3}, {"multipleOf": 2}]}, [2, 5], [4, 1]),
        ({"allOf": [{"minimum": 3}, {"not": {"const": 4}}]}, [3, 5], [4, 2]),
        ({"exclusiveMinimum": 1, "exclusiveMaximum": 2}, [1.5], [1, 2]),
        ({"multipleOf": 0.1}, [0.3, 7], [0.35]),
        ({"uniqueItems": True, "prefixItems": [{"type": "string"}], "items": {"type": "integer"}}, [["a", 1], []], [["a", 1, 1.0], [1], ["a", "b"]]),
        ({"$ref": "#/$defs/tree", "$defs": {"tree": {"properties": {"sub": {"$ref": "#/$defs/tree"}, "n": {"type": "integer"}}}}}, [{"sub": {"n": 1}}], [{"sub": {"sub": {"n": "x"}}}]),
        ({"patternProperties": {"^x": {"type": "null"}}, "additionalProperties": {"type": "string"}, "maxProperties": 2}, [{"x1": None, "y": "a"}], [{"x1": 1}, {"y": 1}, {"a": "", "b": "", "c": ""}]),
        ({"pattern": "("}, [1], ["a"]),
        ({"$ref": "#/none"}, [], [1]),
        (False, [], [1]),
    ],
)
def test_schema_keywords(schema, good, bad):
    assert [tool_calls.problems(v, schema) for v in good] == [[] for _ in good]
    assert all(tool_calls.problems(v, schema) for v in bad)
    assert tool_calls.checked("loop", "1", {"loop": {"$ref": "#"}})[1] == "$: the schema refers to itself without end"


def test_canonical_json():
    assert tool_calls.canonical({"\u20ac": 1, "\r": 2, "\ufb33": 3, "1": 4, "\U0001f600": 5, "\x80": 6, "ö": 7}) == '{"\\r":2,"1":4,"\x80":6,"ö":7,"\u20ac":1,"\U0001f600":5,"\ufb33":3}'
    numbers = {333333333.33333329: "333333333.3333333", 1e30: "1e+30", 4.5: "4.5", 2e-3: "0.002", 1e-27: "1e-27", -0.0: "0", 1e21: "1e+21", 1e20: "100000000000000000000", 1e-6: "0.000001", 1e-7: "1e-7"}
    assert {k: tool_calls.canonical(k) for k in numbers} == numbers


def brute_order(calls):
    """Free calls by place, one after another, where no cycles are."""
    of = {c: (p, [d for d in deps if d != c]) for c, p, deps in calls}
    done, out = set(), []
    while len(out) < len(of):
        free = [(p, c) for c, (p, deps) in of.items() if c not in done and all(d in done or d not in of for d in deps)]
        p, c = min(free)
        done.add(c)
        out.append(c)
    return out


@pytest.mark.parametrize("seed, local", [(0, 10_000), (1, 10_000), (2, 0)])
def test_order(spark, seed, local, monkeypatch):
    """By tasks in memory, and in rounds."""
    monkeypatch.setattr(tool_calls, "LOCAL", local)
    rnd = random.Random(seed)
    rows, plain = [], collections.defaultdict(list)
    for conv in range(12):
        rank = list(range(9))
        rnd.shuffle(rank)  # any order without cycles
        for p in range(9):
            deps = [f"c{q}" for q in range(9) if rank[q] < rank[p] and rnd.random() < (0.1 if conv % 2 else 0.25)] + rnd.sample(["gone", f"c{p}"], 1)
            rows.append((conv, f"c{p}", p, deps))
            plain[conv].append((f"c{p}", p, deps))
    got = tool_calls.order(spark.createDataFrame(rows, "conv bigint, call string, place bigint, depends_on array<string>")).collect()
    for conv, calls in plain.items():
        at = {r["call"]: r["step"] for r in got if r["conv"] == conv}
        assert sorted(at.values()) == list(range(1, 10)) and not any(r["in_cycle"] for r in got)
        for c, _, deps in calls:
            assert all(at[d] < at[c] for d in deps if d in at and d != c)
        if all(int(d[1:]) < p for _, p, deps in calls for d in deps if d != "gone" and int(d[1:]) != p):
            assert sorted(at, key=at.get) == brute_order(calls)


def test_link(spark):
    ok = '{"a": 1}'
    calls = spark.createDataFrame([(1, "x", 1, "add", ok, ["y"], "e"), (1, "y", 2, "add", ok, None, "e"), (1, "y", 3, "add", ok, None, "e"), (1, "p", 4, "add", ok, ["q"], "e"), (1, "q", 5, "add", ok, ["p"], "e"), (1, "w", 6, "none", "{}", [], "e"), (None, "n", 1, "add", ok, None, "e"), (2, None, 1, "add", None, None, "e")], "conv bigint, call string, place bigint, name string, arguments string, depends_on array<string>, status string")
    results = spark.createDataFrame([(1, "x", 9, "r"), (1, "x", 10, "late"), (1, "zz", 9, "r"), (None, "n", 9, "r"), (2, None, 9, "r"), (1, "q", 7, None)], "conv bigint, call string, place bigint, content string")
    got = sorted((tuple(r[c] for c in ("conv", "call", "step", "status", "in_cycle")) for r in tool_calls.link(calls, results, SCHEMAS).collect()), key=repr)
    assert got == sorted(
        [
            (1, "y", 1, "no result", False), (1, "x", 2, "linked", False), (1, "y", None, "repeated", None), (1, "p", 3, "no result", True), (1, "q", 4, "linked", True), (1, "w", 5, "invalid", False),
            (None, "n", None, "no result", None), (2, None, None, "invalid", None),
            (1, "x", None, "no call", None), (1, "zz", None, "no call", None), (None, "n", None, "no call", None), (2, None, None, "no call", None),
        ], key=repr)
    assert tool_calls.link(calls.limit(0), results.limit(0), SCHEMAS).count() == 0
