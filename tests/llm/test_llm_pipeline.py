import hashlib

import corpus_pipeline
from treespan.llm import linededup, toxicity

from .test_llm_bagminhash import brute as classes_of
from .test_llm_bpe import OWN
from .test_llm_linededup import brute_by_length


def test_every_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    tox, line, near, mix, bpe = (f for _, f in corpus_pipeline.STAGES)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    clean = tox(spark, docs, sf_dir).cache()
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, s in scores.items() if s < 0.7}
    texts = {r.doc_id: r.text for r in clean.collect()}
    gone = brute_by_length([(i, t or "") for i, t in texts.items()], linededup.QUERY_TAU, linededup.QUERY_CHARS)
    lined = line(spark, clean, sf_dir).cache()
    want = {i: t and "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in texts.items()}
    assert lined.columns == docs.columns and {r.doc_id: r.text for r in lined.collect()} == want
    kept = near(spark, lined, sf_dir).cache()
    classes = classes_of(want)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, g in classes.items() if i == g)
    mixed = mix(spark, kept, sf_dir).cache()
    assert mixed.columns == docs.columns and {(r.doc_id, r.text) for r in mixed.collect()} <= {(r.doc_id, r.text) for r in kept.collect()}
    out = bpe(spark, mixed, sf_dir).collect()
    assert len(out) == mixed.count()
    for r in out:
        text = want[r.doc_id] or ""
        assert list(r.ids) == OWN.encode_ordinary(text) and r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).collect() == [], name
