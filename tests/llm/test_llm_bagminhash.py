import random
from collections import Counter

import numpy as np
import pyarrow as pa

from treespan.llm import bagminhash
from treespan.llm.queries import QUERIES

from .conftest import WORDS, prose


def bag_of(text):
    words = (text or "").lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(docs):
    """Smallest id of each document's class, by all pairs."""
    ids = sorted(docs)
    bags = {i: bag_of(docs[i]) for i in ids}
    to = {i: i for i in ids}

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            same = (docs[i] or "") == (docs[j] or "")
            size = sum(bags[i].values()), sum(bags[j].values())
            if same or (min(size) and min(size) >= 0.8 * max(size) and jaccard(bags[i], bags[j]) >= 0.8):
                a, b = sorted((root(i), root(j)))
                to[b] = a
    return {i: root(i) for i in ids}


def edited(text, k, rng):
    words = text.split()
    for _ in range(k):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def test_against_all_pairs(frame):
    rng = random.Random(5)
    texts = [None, "", " ", "a b", "A  b", "a b c d e f", "a b c d e f g", "x y " * 200, "x y " * 190, "x y " * 120]
    for k in range(12):
        base = prose(k, rng.randrange(30, 200))
        texts += [base, base, base.upper(), *(edited(base, e, rng) for e in (1, 1, 2, 3, 5))]
    got = {r.doc_id: (r.group_id, r.kept) for r in bagminhash.classes(frame(texts)).collect()}
    want = brute(dict(enumerate(texts)))
    assert got == {i: (g, g == i) for i, g in want.items()}


def test_chain_of_edits_is_one_class(frame):
    rng, texts = random.Random(9), [prose(77, 150)]
    for _ in range(40):
        texts.append(edited(texts[-1], 1, rng))
    got = {r.doc_id: r.group_id for r in bagminhash.classes(frame(texts)).collect()}
    assert got == brute(dict(enumerate(texts)))


def test_signatures_estimate_the_weighted_jaccard():
    a, b = "p q r s t u " * 40 + prose(1, 120), "p q r s t u " * 25 + prose(1, 120)
    rows, h, count = bagminhash.shingles(pa.array([a, b]))
    sig = bagminhash.signatures(rows, h, count, 2)
    assert abs((sig[0] == sig[1]).mean() - jaccard(bag_of(a), bag_of(b))) < 0.15
    assert np.isinf(bagminhash.signatures(rows[:0], h[:0], count[:0], 1)).all()


def test_null_ids_repeats_and_empty(frame):
    texts = [prose(1, 50), prose(1, 50), prose(1, 50), None, "one two"]
    df = frame(texts, ids=[3, 3, None, None, 5])
    got = sorted(((r.doc_id, r.group_id, r.kept) for r in bagminhash.classes(df).collect()), key=repr)
    assert got == sorted([(3, 3, True), (3, 3, True), (None, None, True), (None, None, True), (5, 5, True)], key=repr)
    kept = bagminhash.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, 5, None, None], key=repr)
    assert bagminhash.classes(frame([])).collect() == []
    assert bagminhash.keep_one(frame([])).collect() == []


def test_one_id_with_unlike_texts(frame):
    texts = [prose(1, 60), prose(1, 60), prose(2, 60), prose(3, 60), prose(3, 60) + " more"]
    df = frame(texts, ids=[3, 7, 7, 8, 8])
    got = sorted((r.doc_id, r.group_id, r.kept) for r in bagminhash.classes(df).collect())
    assert got == [(3, 3, True), (7, 3, False), (7, 7, True), (8, 8, True), (8, 8, True)]
    for _ in range(2):
        kept = sorted((r.doc_id, r.text) for r in bagminhash.keep_one(df).collect())
        assert [i for i, _ in kept] == [3, 7, 8] and (7, texts[2]) in kept


def test_pairs_follow_the_size_of_a_group(frame, spark, monkeypatch):
    """Copies with the same share of edits each: pairs are a few a member however many there are."""
    made = []
    real = bagminhash.verified
    monkeypatch.setattr(bagminhash, "verified", lambda pairs, docs, t: made.append(pairs.count()) or real(pairs, docs, t))
    rng, base = random.Random(4), prose(11, 200)
    counts = {}
    for n in (240, 480):
        made.clear()
        texts = [edited(base, 4, rng) for _ in range(n)]
        bagminhash.classes(frame(texts)).count()
        counts[n] = sum(made)
    assert counts[480] < 2.8 * counts[240] and counts[240] < 240 * 64


def test_no_link_of_a_group_around_the_threshold_is_left_out(frame, monkeypatch):
    rng, texts = random.Random(21), []
    for k in range(3):
        base = prose(30 + k, 200)
        texts += [edited(base, 3, rng) for _ in range(110)]
    want = brute(dict(enumerate(texts)))
    assert 3 < len(set(want.values())) < len(texts)
    assert {r.doc_id: r.group_id for r in bagminhash.classes(frame(texts)).collect()} == want
    # The same where more open shingles go to workers, by several small blocks.
    monkeypatch.setattr(bagminhash, "FEW", 16)
    monkeypatch.setattr(bagminhash, "BLOCK", 40)
    assert {r.doc_id: r.group_id for r in bagminhash.classes(frame(texts)).collect()} == want


def test_what_texts_of_a_block_share():
    rng = random.Random(6)
    texts = ["x y " * 60, "x y " * 55 + prose(1, 5), *(edited(prose(k % 3, 60), 3, rng) for k in range(40)), "", "one"]
    rows, h, count = bagminhash.shingles(pa.array(texts))
    got = bagminhash.shared_by_all(rows, h, count, len(texts))
    bags = [bag_of(t) for t in texts]
    assert all(got[i, j] == sum((a & b).values()) for i, a in enumerate(bags) for j, b in enumerate(bags) if i != j)


def test_odd_texts(frame, odd_texts):
    got = {r.doc_id: r.group_id for r in bagminhash.classes(frame(odd_texts)).collect()}
    assert got == brute(dict(enumerate(odd_texts)))


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.group_id for r in QUERIES["op2_near_duplicates"](spark, sf_dir).collect()}
    assert got == brute(docs)
