"""Language ID by compression: the language whose zstandard dictionary makes a text smallest."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, per_document, table
from .zcompress import Sizer, build_content, letters_only

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """``languages`` in falling order of frequency (so ties go to the commoner), and a set of dictionaries for each.

    ``shards`` are the dictionaries of a language; every text is sized under all of them. Each has at most
    ``dictionary_bytes``.
    """

    languages: tuple[str, ...]
    shards: tuple[tuple[bytes, ...], ...]
    block: int = 4096


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 1200, n_shards: int = 2, dictionary_bytes: int = 65536, most_languages: int = 200) -> LanguageModel:
    """Build the dictionaries from at most ``per_language`` rows of each non-null ``lang_col``; each of these texts gives
    a piece. Work and memory are in proportion to the languages, so more than ``most_languages`` are refused (ValueError).

    Rows without text or language teach nothing; of rows with one id and language, one does. No rows: a model without
    languages, which answers ``und``.
    """
    named = train.where(F.col(lang_col).isNotNull()).groupBy(lang_col).count().limit(most_languages + 1).collect()
    if len(named) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    own = train.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = labelled_sample(own, "lang", per_language)
    texts: dict[str, list[bytes]] = {}
    for r in rows:
        texts.setdefault(r["lang"], []).append(letters_only(r["text"]))
    counts = {r[0]: r[1] for r in named}
    languages = tuple(sorted(texts, key=lambda k: (-counts[k], k)))
    shards = tuple(tuple(build_content(texts[k][i::n_shards] or texts[k], dictionary_bytes, seed=i) for i in range(n_shards)) for k in languages)
    return LanguageModel(languages, shards)


def scorer(model: LanguageModel, margin: float):
    """A function from text to (language, score, rejected)."""
    n = len(model.shards[0]) if model.shards else 1
    sizer = Sizer([d for s in model.shards for d in s], model.block, search_log=3)

    def classify(text: str | None):
        if not model.languages or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        data = letters_only(text)
        each = sizer.sizes(data)
        sizes = [sum(each[i : i + n]) / n for i in range(0, len(each), n)]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [x for i, x in enumerate(sizes) if i != best]
        gap = (min(rest) - sizes[best]) / max(len(data), 1) if rest else 1.0
        # bytes saved against the runner-up, as a logistic of the saving on the whole text, at most 40 bytes of it
        score = 1 / (1 + math.exp(-min(gap * len(data), 40.0) / 4))
        return model.languages[best], score, gap < margin

    return classify


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", margin: float = 0.01) -> DataFrame:
    """One row per row of ``docs``: its id, ``lang_pred``, ``score`` and ``rejected``.

    The language is the one of the smallest size over the whole text; ``rejected`` says that it is ahead by less than
    ``margin`` bytes per byte of text. Null texts and texts without a letter give ``und``, score 0, rejected. Ties go to
    the commoner language and are rejected. Repeated rows each give a row; other columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most languages x shards x dictionary_bytes

    def start():
        classify = scorer(shared.value, margin)

        def work(ids, texts):
            out = [classify(t) for t in texts]
            return ids, [x[0] for x in out], [x[1] for x in out], [x[2] for x in out]

        return work

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return per_document(docs, start, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean", id_col, text_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
