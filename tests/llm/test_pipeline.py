"""Each stage of the pipeline against what its operator says of the rows before it, and the queries' SQL."""

import random

import duckdb

import corpus_pipeline
from loomframe.llm import decontamination, near_duplicates, personal_data, quality_rules, registry
from loomframe.llm.common import table, written

from .edges import EDGES
from .test_matching import brute_groups


def test_stages(spark, sample):
    docs = table(spark, sample, "documents")
    before = docs
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, before, sample), "stage")
        outs.append(after)
        if name == "quality rules":
            judged = quality_rules.query(spark, sample)
            assert ids(after) == ids(judged.where("kept"))
        elif name == "near duplicates":
            assert ids(after) == ids(near_duplicates.group(before).where("doc_id = component_id"))
        elif name == "benchmark decontamination":
            assert ids(after) == ids(before) - ids(decontamination.find(before, table(spark, sample, "benchmark")))
        elif name == "personal data":
            assert ids(after) == ids(before)
            assert all(not personal_data.pattern_spans(r["text"]) for r in after.collect())
        if name != "sentencepiece":
            assert after.columns == docs.columns
        before = after
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "sentencepiece"
    assert before.where("not round_trip").count() == 0 and ids(before) == ids(outs[-2])
    assert before.count() > 0.7 * docs.count()


def test_stages_on_edges(spark, docs, sample):
    """Null and repeated ids, null, empty, blank and long texts, repeated rows, no table at all, and other columns."""
    texts = [*EDGES, EDGES[5], " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(40))]
    odd = docs(texts, ids=[None, 1, 1, None, 4, 5, 6, 7, 8, 9, None, 3, None]).drop("lang", "n_chars")
    counts = []
    for before in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            before = written(stage(spark, before, sample), "stage")
            counts.append(before.count())
    assert before.columns == ["doc_id", "source", "n_tokens", "ids", "round_trip"]
    assert counts == [4, 2, 2, 2, 2, 0, 0, 0, 0, 0]


def test_near_duplicate_stage(spark, docs, sample):
    """Brute force with five words and 0.8; some pairs are near copies for that and not for op4's four words and 0.85."""
    rnd = random.Random(8)
    texts = []
    for i in range(40):
        words = [f"w{i}_{k}" for k in range(60)]
        texts += [" ".join(words), " ".join(w if k not in range(20, 20 + i % 5) else f"x{k}" for k, w in enumerate(words))]
        if i % 4 == 0:
            texts.append(" ".join(words[: 60 - rnd.randrange(14)]))
    want = [i for i, (_, c) in enumerate(brute_groups(texts, 5, 80)) if c == i]
    assert want != [i for i, (_, c) in enumerate(brute_groups(texts, 4, 85)) if c == i]
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    assert [r["doc_id"] for r in stage(spark, docs(texts), sample).orderBy("doc_id").collect()] == want


def test_sql(spark, sample):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sample}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, sample)
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
        assert key(df.select(*names).collect()) == key(found.fetchall()), name
