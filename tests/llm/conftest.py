from __future__ import annotations

import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, `_id` string, H1 int, `a.b` string, score double, _text int, Label int, size int, bucket int, gone int, host int, _times int"
WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work government number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows(texts, ids=None, sources=None):
    n = len(texts)
    ids = list(range(n)) if ids is None else ids
    sources = ["web"] * n if sources is None else sources
    return [(i, t, "en", s, len(t or ""), 7, "x", 1, "y", 0.5, 2, 3, 4, 5, 6, 8, 9) for i, t, s in zip(ids, texts, sources, strict=True)]


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with columns whose names clash with those that the operators use."""
    return lambda texts, ids=None, sources=None: spark.createDataFrame(rows(texts, ids, sources), DOCS)


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, astral, control, repeated and very long texts."""
    return [None, "", " ", "\n\n\t", "a", "😀 b 😀😀", "x\x00y\x1cz", "don't I'll we're", "  two  spaces  ", prose(1, 40), prose(1, 40), "word " * 30_000, "z" * 70_000, "ab\x0bcd \x0b ef", "Ünïcödé ŝtríng ﬁ ſ ß İ", "١٢٣ 123 ⅷ", "<|endoftext|> </w>"]
