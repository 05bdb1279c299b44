import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """A table of texts with the columns of ``documents``; ids from 0 unless given."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", "s", len(t) if t else 0, "extra") for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, id string")

    return make


@pytest.fixture
def sample():
    if not os.path.isdir(SF):
        pytest.skip("no sample tables")
    return SF

