import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from treespan.llm import tokenstore
from treespan.llm.common import new_path
from treespan.llm.queries import QUERIES, file_bytes

from .conftest import prose

DATA = file_bytes("word_bpe_49k.json")
OWN = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def plain(text):
    return [*OWN.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), min_size=1, max_size=5))
def test_ids_of_random_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, ends = tokenstore.encoded(pa.array(texts, pa.string()), DATA, 2)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [plain(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "Ab", "e\u0301", "İ", "ß", "a.", "don't", " ", "\n", "\t", "7", "x,;"]), max_size=8).map("".join), min_size=1, max_size=5))
def test_added_tokens_and_marks(texts):
    ids, ends = tokenstore.encoded(pa.array(texts, pa.string()), DATA, 2)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [plain(t) for t in texts]


def test_added_token_in_a_text():
    ids, ends = tokenstore.encoded(pa.array(["a <|endoftext|> b", "a b"]), DATA, 2)
    assert ids.tolist() == [320, 49407, 321, 2, 320, 321, 2] and ends.tolist() == [4, 7]


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokenstore, "KNOWN", 3)
    for texts in (["one two three four five"], ["six one", "two"], ["one"]):
        ids, ends = tokenstore.encoded(pa.array(texts), DATA, 2)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [plain(t) for t in texts]


def test_round_trip_of_odd_texts(frame, odd_texts):
    ids = [*range(100, 100 + len(odd_texts) - 3), None, 7, 7]
    got = tokenstore.round_trip(frame(odd_texts, ids=ids), DATA, 2, with_ids=True).orderBy("start").collect()
    order = [r.doc_id for r in got]
    assert order == sorted(ids, key=lambda x: (x is not None, x or 0))
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    want = sorted((repr(i), plain(t)) for i, t in zip(ids, odd_texts, strict=True))
    assert sorted((repr(r.doc_id), list(r.ids)) for r in got) == want


def test_one_document_is_read_on_its_own(spark, frame):
    texts = [prose(i, 30) for i in range(400)]
    path = new_path(spark, "tokens")
    manifest = tokenstore.write(frame(texts), path, DATA, 2)
    fs, at = tokenstore._fs(path)
    with fs.open_input_stream(f"{at}/dictionary.zdict") as f:
        dictionary = f.read()
    assert dictionary
    seen = 0
    for r in manifest.collect():
        shard = tokenstore.Shard(fs, r.file, dictionary)
        assert r.docs == len(shard.ids) and r.tokens == shard.lens.sum()
        for k in (0, len(shard.ids) // 2, len(shard.ids) - 1):
            assert shard.document(k).tolist() == plain(texts[shard.ids[k]])
        seen += r.docs
        with pytest.raises(ValueError):
            tokenstore.Shard(fs, r.file, dictionary + b"x")
    assert seen == 400


def test_empty_table(frame):
    assert tokenstore.round_trip(frame([]), DATA, 2).collect() == []


def test_query(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: r for r in QUERIES["op10_token_store"](spark, sf_dir).collect()}
    start = 0
    for i, text in docs:
        ids = plain(text)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(docs)
