import base64
import hashlib
import random

import public_tokenizers
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from treespan.llm import bpe
from treespan.llm.queries import QUERIES, file_bytes

DATA = file_bytes("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}
OWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_odd_texts(frame, odd_texts):
    got = {r.doc_id: r for r in bpe.encode(frame(odd_texts), DATA, public_tokenizers.PATTERN, decoded=True).collect()}
    for i, text in enumerate(odd_texts):
        assert got[i].ids == OWN.encode_ordinary(text or ""), repr(text)[:50]
        assert bytes(got[i].decoded) == (text or "").encode()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), min_size=1, max_size=6))
def test_random_texts(texts):
    import pyarrow as pa

    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    own = bpe.codec(DATA, public_tokenizers.PATTERN)
    ids = own.encode(pa.array(texts, pa.string()))
    assert ids.to_pylist() == [OWN.encode_ordinary(t) for t in texts]
    assert own.decode(ids).to_pylist() == [t.encode() for t in texts]


SPACED = st.text(st.sampled_from("ab'1. \n\t\r\x0b\x1c\x85\xa0\u2003é"), max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(SPACED, min_size=1, max_size=6))
def test_white_space_at_any_place(texts):
    import pyarrow as pa

    ids = bpe.codec(DATA, public_tokenizers.PATTERN).encode(pa.array(texts, pa.string()))
    assert ids.to_pylist() == [OWN.encode_ordinary(t) for t in texts]


def test_line_ends_at_the_ends_of_texts():
    import pyarrow as pa

    own = bpe.codec(DATA, public_tokenizers.PATTERN)
    for texts in (["hello world\n", "x y"], ["a", "\n\nfoo"], ["a", "\n"], ["\t", "b c"], ["a b\n", "c d\n", "e f"], ["0", "\r"]):
        assert own.encode(pa.array(texts)).to_pylist() == [OWN.encode_ordinary(t) for t in texts]


def test_long_words_fold_as_short_ones():
    rng = random.Random(3)
    own = bpe.codec(DATA, public_tokenizers.PATTERN)
    for n in (1, 2, 47, 48, 49, 500):
        word = "".join(rng.choice("abcdeé") for _ in range(n))
        ids, lens = own.fold([word])
        assert ids.tolist() == OWN.encode_ordinary(word) and lens.tolist() == [len(ids)]


def test_empty_table_repeats_and_unknown_ids(frame, spark):
    assert bpe.encode(frame([]), DATA, public_tokenizers.PATTERN).collect() == []
    twice = bpe.encode(frame(["a b", "a b"], ids=[1, 1]), DATA, public_tokenizers.PATTERN).collect()
    assert len(twice) == 2 and twice[0].ids == twice[1].ids
    df = spark.createDataFrame([(1, [64, 65]), (2, None), (3, [60_000]), (4, [])], "doc_id bigint, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, DATA, public_tokenizers.PATTERN).collect()}
    assert bytes(got[1]) == OWN.decode_bytes([64, 65]) and got[2] is None and got[3] is None and bytes(got[4]) == b""


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op1_byte_bpe"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = OWN.encode_ordinary(docs[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_pattern_is_the_librarys():
    assert regex.compile(public_tokenizers.PATTERN).findall("a  b") == ["a", " ", " b"]
