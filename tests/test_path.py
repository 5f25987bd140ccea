"""Paths against a plain tree walk, on random trees."""

from __future__ import annotations

import random

import pytest

from treespan.model import SEGMENTS, violations
from treespan.operators.stages import Node, flattened
from treespan.plans.path import AXES, PathError, compile_path, escape, find_all, parse, split_unescaped, unescape

TEXT = "nine 9 TEN 10 eleven 11 TWELVE 12 thirteen 13"


def grown(rng, start, stop, depth):
    node = Node(start, stop, rng.choice(["a", "b", None]))
    at = start
    while depth and at < stop and len(node.kids) < 4:
        a = rng.randrange(at, stop)
        b = rng.randrange(a + 1, stop + 1)
        node.kids.append(grown(rng, a, b, depth - 1))
        at = b
    return node


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(4)
    rows = [(d, *r[:8]) for d in range(6) for r in flattened([grown(rng, 0, len(TEXT), 3)])]
    df = spark.createDataFrame(rows, SEGMENTS).cache()
    docs = spark.createDataFrame([(d, TEXT) for d in range(6)], "doc_id bigint, text string")
    by = {}
    for r in df.collect():
        by.setdefault(r.doc_id, {})[r.pre] = r
    return df, docs, by


def along(nodes, c, axis):
    """Nodes of an axis, nearest first, by walking."""
    up = lambda n: [] if n.parent is None else [nodes[n.parent], *up(nodes[n.parent])]
    kids = lambda n: sorted((x for x in nodes.values() if x.parent == n.pre), key=lambda x: x.ord)
    down = lambda n: [y for x in kids(n) for y in [x, *down(x)]]
    twins = [] if c.parent is None else kids(nodes[c.parent])
    before, after = [x for x in twins if x.ord < c.ord][::-1], [x for x in twins if x.ord > c.ord]
    order = [nodes[0], *down(nodes[0])]
    kin = {x.pre for x in [c, *up(c), *down(c)]}
    return {
        "....": [nodes[0]] if c.pre else [], "...": up(c), "..": up(c)[:1], ".": [c], "*": kids(c), "**": down(c), "***": [x for x in down(c) if not kids(x)],
        "<<<": [x for x in order[::-1] if x.pre < c.pre and x.pre not in kin], "<<": before, "<": before[:1], ">": after[:1], ">>": after,
        ">>>": [x for x in order if x.pre > c.pre and x.pre not in kin],
    }[axis]


@pytest.mark.parametrize("axis", [a for a in AXES if a != "><"])
def test_axes_from_every_node(forest, axis):
    df, _, by = forest
    for sign in "+-":
        for own in ("", "!", "!!"):
            got = {}
            for r in find_all(f"{sign}{axis}{own}", df, df.select("doc_id", "pre")).collect():
                got.setdefault((r.doc_id, r.origin), []).append((r.pos, r.pre))
            for d, nodes in by.items():
                for c in nodes.values():
                    want = along(nodes, c, axis)
                    want = want[::-1] if sign == "-" and axis != "." else want
                    if axis != "." and (own == "!!" or own == "!" and not want):
                        want = [*want, c] if sign == "-" and own == "!!" else [c, *want]
                    have = [p for _, p in sorted(got.get((d, c.pre), []))]
                    assert have == [x.pre for x in want], (axis, sign, own, c)


def matches(row, index, test):
    sub = TEXT[row.start : row.stop]
    return {
        "[d:a]": row.label == "a", "[~d:a]": row.label != "a", "[d:a,b]": row.label in ("a", "b"), "[i:0]": index == 0, "[i:1-3,5-]": 1 <= index < 3 or index >= 5,
        "[~i:0]": index != 0, "[ssw:1,T]": sub.startswith(("1", "T")), "[sew:e]": sub.endswith("e"), "[scfsw:t]": sub.casefold().startswith("t"), "[lcs:ten]": sub.casefold() == "ten", "[~s:9]": sub != "9",
    }[test]


TESTS = ["[d:a]", "[~d:a]", "[d:a,b]", "[i:0]", "[i:1-3,5-]", "[~i:0]", "[ssw:1,T]", "[sew:e]", "[scfsw:t]", "[lcs:ten]", "[~s:9]"]


def test_filters_and_their_algebra(forest):
    df, docs, by = forest
    rng = random.Random(7)
    for _ in range(14):
        a, b, c = (rng.choice(TESTS) for _ in range(3))
        path = f"**{a} & ~{b} | ({c} ^ {a})"
        got = sorted((r.doc_id, r.pre) for r in find_all(path, df, docs=docs).collect())
        want = []
        for d, nodes in by.items():
            for i, n in enumerate(along(nodes, nodes[0], "**")):
                x, y, z = (matches(n, i, t) for t in (a, b, c))
                if (x and not y) or (z != x):
                    want.append((d, n.pre))
        assert got == sorted(want), path


@pytest.mark.parametrize(
    ("path", "test"),
    [
        ("**{*[d:a]}", lambda n, w: any(x.label == "a" for x in w(n, "*"))),
        ("**~{*}", lambda n, w: not w(n, "*")),
        ("**[d:b]{..[d:a]}", lambda n, w: n.label == "b" and any(x.label == "a" for x in w(n, ".."))),
        ("**{<} ^ {>}", lambda n, w: bool(w(n, "<")) != bool(w(n, ">"))),
        ("**({<} | {>}) & ~{**[d:a]}", lambda n, w: (w(n, "<") or w(n, ">")) and not any(x.label == "a" for x in w(n, "**"))),
        ("**{*{*[d:a]}}", lambda n, w: any(any(y.label == "a" for y in w(x, "*")) for x in w(n, "*"))),
    ],
)
def test_subqueries(forest, path, test):
    df, docs, by = forest
    got = sorted((r.doc_id, r.pre) for r in find_all(path, df, docs=docs).collect())
    want = []
    for d, nodes in by.items():
        walk = lambda n, axis, nodes=nodes: along(nodes, n, axis)
        want += [(d, n.pre) for n in walk(nodes[0], "**") if test(n, walk)]
    assert got == sorted(want)


def test_chains_are_ordered_bags(forest):
    df, _, by = forest
    got = {}
    for r in find_all("**/../-*", df).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.pre))
    for d, nodes in by.items():
        want = [z.pre for x in along(nodes, nodes[0], "**") for y in along(nodes, x, "..") for z in along(nodes, y, "*")[::-1]]
        assert [p for _, p in sorted(got.get(d, []))] == want
    first = {r.doc_id: r.pre for r in compile_path("**/../-*").find(df).collect()}
    assert all(first[d] == min(rows)[1] for d, rows in got.items())
    assert violations(df).count() == 0


@pytest.mark.parametrize("path", ["", " ", "\n", "x", "*[d:a", "*[z:a]", "*[i:-1]", "*[i:x]", "*()", "*[d:a][d:b]", "*([d:a]", "*[d:a])", "*{}", "*{*", "*}", "*[d:a] & ", "*[s:a\\", "[d:a]", "*//*", "*{*}{*}", "*!!!"])
def test_paths_that_are_refused(path):
    with pytest.raises(PathError):
        parse(path)


def test_missing_values_are_refused():
    for path in ("*[v:a]", "*{*[p:a]}"):
        with pytest.raises(PathError):
            compile_path(path)


def test_escapes():
    for text in ("a,b", "[x]", "a/b{c}", "\\"):
        assert unescape(escape(text)) == text
    assert split_unescaped("a\\,b,c", ",") == ["a\\,b", "c"]
    assert parse(f"*[s:{escape('a/b,c]')}]").steps[0].where.values == ("a/b,c]",)
