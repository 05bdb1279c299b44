"""Encoding and decoding against the tokenizer's own library."""

import random

import pytest

from loomframe.llm import piece_encoding as pe

from .edges import EDGES

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def both():
    path = pe.model_path()
    return pe.load(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_random_texts(both):
    mine, lib = both
    rnd = random.Random(1)
    parts = ["the", " ", "  ", "   ", "\n", "\t", "a", "in", "<0x0A>", "<s>", "</s>", "<unk>", "▁", "é", "é", "中", "梦", "😀", "　", "\xa0", "\x00", "1", "12", "ing", " th", "_", "=", "//", " " * 9, "function", "return", "ß", "ﬁ", "Ⅷ", "'"]
    for i in range(6000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        if i % 3 == 0:
            text = "".join(chr(rnd.choice([32, 32, 97, 101, 116, 104, 10, rnd.randint(33, 126), rnd.randint(0xA0, 0x2FFF), rnd.randint(0x4E00, 0x9FFF)])) for _ in range(rnd.randint(0, 30)))
        ids = lib.encode(text)
        assert mine.encode(text) == ids
        assert mine.joined(text) == (",".join(map(str, ids)), lib.decode(ids))


def test_runs_of_spaces(both):
    mine, lib = both
    for n in range(70):
        for text in (" " * n, " " * n + "a", "a" + " " * n + "\n"):
            assert mine.encode(text) == lib.encode(text)


def test_decoding_any_ids(both):
    mine, lib = both
    rnd = random.Random(2)
    for _ in range(3000):
        ids = [rnd.randrange(lib.vocab_size()) if rnd.random() < 0.5 else rnd.randrange(3, 259) for _ in range(rnd.randint(0, 8))]
        assert mine.decode(ids) == lib.decode(ids)


def test_table_is_what_merging_gives(both):
    mine, _ = both
    rnd = random.Random(3)
    for _ in range(500):
        text = "".join(rnd.choice("▁theinorasdlgqu") for _ in range(rnd.randint(1, 15))).replace("▁▁", "▁")
        text = text[0] + text[1:].replace("▁", "")
        assert mine._table(text) == pe.merge_encode(text, mine.rank)


def test_chunks_are_encoded_once(both, monkeypatch):
    _, lib = both
    mine = pe.PieceTable(pe.model_path())
    filled = []
    table = mine._table
    monkeypatch.setattr(mine, "_table", lambda text: filled.append(text) or table(text))
    stems, ends = ["the", "word", "house", "entier"], [".", ",", ".\nthe", ".\nword,", ".\nhouse.", "&&&", "###"]
    text = " ".join(s + e for s in stems for e in ends)
    assert mine.encode(text) == lib.encode(text)
    assert len(filled) == len(set(filled)) <= len(stems) + 3 + 4  # with a space before and without, and what stands behind


def test_little_memory_gives_the_same(both, monkeypatch):
    _, lib = both
    mine = pe.PieceTable(pe.model_path())
    monkeypatch.setattr(pe, "REMEMBERED", 6)
    rnd = random.Random(4)
    for _ in range(300):
        text = "".join(rnd.choice(["the", "ing", " ", "  ", "\n", ".", "é", "中", "ß", "x1", "_", "S"]) for _ in range(30))
        assert mine.joined(text) == (",".join(map(str, lib.encode(text))), lib.decode(lib.encode(text)))
        assert all(len(m.new) <= 3 and len(m.old) <= 3 for m in (mine.compatible, mine.encoded, mine.cut))


def test_edges_and_clashing_columns(docs, both):
    mine, lib = both
    table = docs(EDGES)
    got = {r["doc_id"]: r for r in pe.encode(table, pe.model_path()).collect()}
    for i, t in enumerate(EDGES):
        assert got[i]["ids"] == lib.encode(t or "") and got[i]["n_tokens"] == len(got[i]["ids"]) and got[i]["decoded"] == lib.decode(got[i]["ids"])
    back = pe.decode(pe.encode(table, pe.model_path(), with_text=False), pe.model_path())
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == {i: r["decoded"] for i, r in got.items()}
    assert pe.digests(table.limit(0), pe.model_path()).count() == 0


def test_tasks_leave_nothing_remembered(spark, docs):
    """What a task of ``encode`` has remembered goes with it; the process, which may stand by for long, keeps the table alone."""
    import pyarrow as pa

    def forget(batches):
        from loomframe.llm import piece_encoding

        piece_encoding._TABLES.clear()  # what digests of other tests have left
        yield from batches

    spark.range(0, 64, 1, 64).mapInArrow(forget, "id bigint").count()
    texts = docs([f"word{i} is {i} times remembered" for i in range(200)]).repartition(8)
    assert pe.encode(texts, pe.model_path()).agg({"n_tokens": "sum"}).first()[0] > 1000

    def remembered(batches):
        for _ in batches:
            from loomframe.llm import piece_encoding

            for table in piece_encoding._TABLES.values():
                n = sum(len(m.new) + len(m.old) for m in (table.compatible, table.encoded, table.cut))
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    left = [r[0] for r in spark.range(0, 16, 1, 16).mapInArrow(remembered, "n bigint").collect()]
    assert left and max(left) == 0
