"""Trees worked on inside documents: no shuffle of nodes, and the same rows as joins over the table."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from treespan import model
from treespan.functions import segments as sg
from treespan.functions.text import format_node
from treespan.plans import forest as fo
from treespan.plans.path import Compiler, compile_path, find_all, parse
from treespan.queries import QUERIES
from treespan.sources import store

TEXTS = ["", "\n", " ", "a bb\n\n  ccc a", "Ünïcödé 😀 x\nsTRASSE straße\n", "one", None, "a\nb\nc\nd", " lead\ntrail ", "x " * 300]


@pytest.fixture(scope="module")
def lines(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    return docs, model.line_word_tree(docs)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df, kind="Exchange hashpartitioning"):
    return plan(df).count(kind)


def test_line_word_trees_by_hand(lines):
    docs, tree = lines
    want = []
    for d, text in enumerate(TEXTS):
        if text is None:
            continue
        own, at = [[0, 0, None, 0, 0, 0, len(text), "doc"]], 0
        for k, line in enumerate(text.split("\n")):
            top, n = len(own), 0
            own.append([top, top, 0, 1, k, at, at + len(line), "line"])
            place = at
            for w in line.split(" "):
                if w:
                    own.append([len(own), len(own), top, 2, n, place, place + len(w), "word"])
                    n += 1
                place += len(w) + 1
            own[top][1] = len(own) - 1
            at += len(line) + 1
        own[0][1] = len(own) - 1
        want += [(d, *r) for r in own]
    assert sorted(map(tuple, tree.collect()), key=repr) == sorted(want, key=repr)
    assert model.violations(tree).count() == 0


def test_trees_of_texts_and_their_paths_shuffle_no_nodes(lines):
    docs, tree = lines
    assert exchanges(tree) == 0
    for path in ("**[d:word]/..", "*/<<<[d:line]", "**[d:word]/../><", "**[d:line]{*[scf:a]} ^ {*[s:x]}"):
        assert exchanges(find_all(path, fo.Trees.of_lines(docs))) == 0


@pytest.mark.parametrize("name", ["axis_parent", "axis_following", "self_option_always", "filter_casefold", "filter_casefold_affix", "subquery_nested", "subquery_xor", "find_first", "filter_predicate_value", "filter_null_label"])
def test_queries_of_paths_shuffle_no_nodes(spark, sf_dir, name):
    assert exchanges(QUERIES[name](spark, sf_dir)) == 0


PATHS = [
    "**", "-***", "**[d:word]/<!", "*/>>[d:line]", "-*[i:1-]/**[~i:0]", "**/...", "**/-...[i:0]", "**[d:word]/....", "**/../-><", "*/<<<[d:line]", "*/-<<<[i:0-2]", "*/>>>", "**[ssw:a,x]/..!!", "*/.[i:1]",
    "**{*[i:0] & [s:a]}", "**({<} | {>}) & ~{*}", "**[scf:STRASSE]/<<!!", "**[d:word] & [sew:e] ^ [ssw:a]", "**/*/..{*}/><[i:0-3]", "***/-<<[i:0]/....",
]


@pytest.mark.parametrize(("path", "ordered"), [(p, i % 3 > 0) for i, p in enumerate(PATHS)])
def test_walks_find_what_joins_find(lines, path, ordered):
    docs, tree = lines
    some = docs.where("doc_id <> 9")
    rows = tree.where("doc_id <> 9")
    names = ["doc_id", "pre", "origin", *["pos"] * ordered]
    want = sorted(map(tuple, Compiler(rows, some, {}, {}).run(parse(path), None, ordered).select(*names).collect()))
    assert sorted(map(tuple, find_all(path, fo.Trees.of_lines(some), ordered=ordered).select(*names).collect())) == want
    assert sorted(map(tuple, find_all(path, rows, docs=some, ordered=ordered).select(*names).collect())) == want


@pytest.mark.parametrize("path", ["**/...", "**[d:word]/..", "**/<[~s:a]", "*/>>>", "-**/<<<[d:word] | [s:a]"])
def test_trees_with_missing_nodes_and_null_texts(spark, lines, path):
    docs, tree = lines
    rng = random.Random(3)
    gone = [(d, p) for d in range(len(TEXTS)) for p in range(1, 12) if rng.random() < 0.3]
    rows = tree.where("doc_id <> 9").join(spark.createDataFrame(gone, "doc_id bigint, pre int"), ["doc_id", "pre"], "left_anti").select(*tree.columns).localCheckpoint()
    odd = docs.where("doc_id <> 3").replace("one", None, "text")
    names = ["doc_id", "pre", "origin", "pos"]
    want = sorted(map(tuple, Compiler(rows, odd, {}, {}).run(parse(path), None, True).select(*names).collect()))
    assert sorted(map(tuple, find_all(path, rows, docs=odd).select(*names).collect())) == want


def test_predicates_that_know_the_index(lines):
    docs, tree = lines
    got = find_all("*[p:odd]", tree, predicates={"odd": lambda r: r["idx"] % 2 == 1}, ordered=False)
    assert sorted((r.doc_id, r.ord) for r in got.collect()) == sorted((r.doc_id, r.ord) for r in tree.where("depth = 1 AND ord % 2 = 1").collect())
    first = compile_path("**[d:word]").find(fo.Trees.of_lines(docs), columns=["pre"])
    assert first.columns == ["pre", "origin"] and first.count() == 6


def test_documents_across_batches(monkeypatch):
    rng = random.Random(5)
    table = pa.table({"doc_id": [d for d in range(30) for _ in range(rng.randrange(1, 9))]})
    for size in (1, 2, 7, 1000):
        parts = list(fo._whole(table.to_batches(max_chunksize=size)))
        assert pa.concat_tables(parts) == table
        ids = [set(p.column("doc_id").to_pylist()) for p in parts]
        assert sum(map(len, ids)) == 30
    monkeypatch.setattr(fo, "CHARS", 40)
    texts = [t for t in TEXTS if t is not None]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    assert sum(len(f.ids) for f in fo._forests_of_lines([batch], ("doc", "line", "word"))) == len(texts)


def test_parts_of_a_walk_are_bounded(monkeypatch):
    """What many contexts find in a document isn't held at once."""
    from treespan.plans import walk

    monkeypatch.setattr(walk, "NODES", 500)
    f = fo.line_word_forest(pa.array([1]), ["a b\n" * 200])
    parts = [len(p.node) for p in walk.Walker(f, {}).find(parse("*/>>>"), np.array([0]), False)]
    lines = 201
    words = [3] * 200 + [1]
    assert sum(parts) == sum(sum(words[i + 1 :]) for i in range(lines)) and max(parts) <= 1200


def test_texts_in_few_files_are_dealt_out(spark, tmp_path):
    spark.createDataFrame([(i, "a b") for i in range(50)], "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    assert fo.Trees.of_lines(spark.read.parquet(f"{tmp_path}/d")).rows.rdd.getNumPartitions() >= 4


@pytest.mark.parametrize("name", ["canonical_paths", "strip_to_children", "invert_children", "windowed_merge", "gaps_between_words", "json_round_trip", "dumped_trees", "flagship_sections", "sub_segments"])
def test_queries_inside_documents_shuffle_no_nodes(spark, sf_dir, name):
    assert exchanges(QUERIES[name](spark, sf_dir)) == 0


def test_operations_inside_documents(lines):
    """The same on rows, on texts, and by windows over the table."""
    docs, tree = lines
    trees, names = fo.Trees.of_lines(docs), ["doc_id", "start", "stop", "label"]
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=repr)
    words = tree.where("label = 'word'")
    assert rows(sg.gaps_in_documents(trees, "word"), *names) == rows(sg.gaps(words, tree.where("pre = 0")), *names)
    assert rows(sg.joined_windows_in_documents(tree, "word", 3, "three"), *names) == rows(sg.joined_windows(words, 3, label="three"), *names)
    kids = tree.where("parent IS NOT NULL").select("doc_id", tree.parent.alias("pre"), "start", "stop")
    assert rows(sg.invert_children(trees), "pre", *names) == rows(sg.gaps(kids, tree, keys=("doc_id", "pre")), "pre", *names)
    for f in (sg.strip_to_children, sg.invert_children, sg.canonical_paths, store.to_json):
        assert rows(f(trees), *f(trees).columns) == rows(f(tree), *f(trees).columns)
    assert rows(store.from_json(store.to_json(trees)), *tree.columns) == rows(tree, *tree.columns)
    by_id = {r.doc_id: r.dump for r in store.dumped(tree, docs).collect()}
    assert by_id == {r.doc_id: r.dump for r in store.dumped(trees).collect()} and "'ccc'" in by_id[3]


def test_complements_of_nested_and_overlapping_spans():
    rng = random.Random(8)
    spans = sorted((g, a, a + rng.randrange(5)) for g in range(9) for a in rng.sample(range(20), rng.randrange(6)) if g != 4)
    rng.shuffle(spans)
    spans.sort(key=lambda s: s[0])
    got = list(zip(*(x.tolist() for x in fo.complements(*(np.array(x) for x in zip(*spans, strict=True)), np.zeros(9, int), np.full(9, 25))), strict=True))
    for g in range(9):
        free = [i for i in range(25) if not any(a <= i < b for k, a, b in spans if k == g)]
        assert [i for k, a, b in got if k == g for i in range(a, b)] == free


@pytest.mark.parametrize("name", ["xml_elements", "xml_attributes"])
def test_xml_queries_join_nothing(spark, sf_dir, name):
    assert "Join" not in plan(QUERIES[name](spark, sf_dir))


def test_dumped_lines_are_those_of_their_format(lines):
    docs, tree = lines
    by = {}
    for r in tree.collect():
        by.setdefault(r.doc_id, []).append(r.asDict())
    got = {r.doc_id: r.dump for r in store.dumped(fo.Trees.of_lines(docs), style="tree").collect()}
    assert sorted(got) == sorted(by)
    for d, rows in by.items():
        rows.sort(key=lambda r: r["pre"])
        assert len(got[d].splitlines()) == len(rows)
        for shown, r in zip(got[d].split("\n"), rows, strict=False):
            assert shown.endswith(format_node(store.TREE_LINE, TEXTS[d], r["start"], r["stop"], r["label"])), shown
            assert len(shown) - len(format_node(store.TREE_LINE, TEXTS[d], r["start"], r["stop"], r["label"])) == 3 * r["depth"]
