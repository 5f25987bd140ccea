from __future__ import annotations

import random

import pytest

from treespan.functions import text as tx
from treespan.model import SegmentError, Span, nested
from treespan.operators import nlp, packs
from treespan.operators import stages as st
from treespan.sources import store


def texts(text, nodes):
    return [text[n.start : n.stop] for n in nodes]


def labelled(text, nodes):
    return [(n.label, text[n.start : n.stop]) for n in st.walk(nodes)]


@pytest.mark.parametrize(
    ("keep", "want"),
    [("none", ["PRE", "MID", "MID", "SUF"]), ("leading", ["-MID", "-MID", "-SUF"]), ("trailing", ["PRE-", "MID-", "MID-"]), ("all", ["PRE", "-", "MID", "-", "MID", "-", "SUF"])],
)
def test_split_keeps_boundaries(keep, want):
    text = "PRE-MID-MID-SUF"
    assert texts(text, st.Split("-", keep=keep)(text)) == want
    assert texts(text, st.Split("x", keep=keep)(text)) == [text]
    assert st.Split("x", keep=keep, whole=False)(text) == []
    assert texts("abc", st.Split("(?<=b)", limit=1)("abc")) == ["ab", "c"]


def test_extract_gives_every_capture():
    text = "ten 10 eleven 11 twelve 12 "
    found = st.Extract(r"(?P<phrase>(?P<word>(?P<char>\w)+) (?P<number>(?P<digit>\d)+) )")(text)
    count = {}
    for n in st.walk(found):
        count[n.label] = count.get(n.label, 0) + 1
    assert count == {"phrase": 3, "word": 3, "number": 3, "char": 15, "digit": 6}
    assert len(st.Extract(r"\w+", groups=[0], limit=2)(text)) == 2 and st.Extract(r"\w+", groups=[0], limit=0)(text) == []
    assert [n.label for n in st.Extract(r"(a)(?P<b>b)", groups=[1, "b"])("ab")] == ["1", "b"]
    for bad in (["z"], [3], [1, 1]):
        with pytest.raises(ValueError):
            st.Extract(r"(a)(?P<b>b)", groups=bad)


def test_edges():
    text = " one 123 two 456 "
    word = lambda: st.Extract(r"(?P<word>\S+)")
    digits = lambda text, n: text[n.start].isdigit()
    assert labelled(text, word().to(st.Extract(r"(?P<digit>\d)"), digits).then(st.Relabel("rest"))(text)) == [("rest", "one"), *[("digit", d) for d in "123"], ("rest", "two"), *[("digit", d) for d in "456"]]
    assert texts(text, word().then(st.Where(digits))(text)) == ["123", "456"]
    assert labelled(text, word().children(st.Extract("(?P<c>.)"), digits)(text))[:3] == [("word", "one"), ("word", "123"), ("c", "1")]
    assert texts(text, word().aside(st.Where("none"))(text)) == ["one", "123", "two", "456"]
    both = word().children(st.Extract("(?P<c>.)")).children(st.Extract("(?P<c>[n2])"), how="delete")
    assert "n" not in texts(text, st.walk(both(text))) and "o" in texts(text, st.walk(both(text)))
    again = word().children(st.Extract("(?P<c>.)")).children(st.Extract("(?P<d>..)"), how="replace")
    assert labelled(text, again(text))[:2] == [("word", "one"), ("d", "on")]
    with pytest.raises(SegmentError):
        word().children(st.Extract("(?P<c>.)")).children(st.Extract("(?P<d>..)"))(text)
    nest = word().children(st.Extract("(?P<c>.)")).children(st.Extract("(?P<d>..)"), how="nest")
    assert labelled(text, nest(text))[:4] == [("word", "one"), ("d", "on"), ("c", "o"), ("c", "n")]


def test_a_stage_may_be_its_own_target(spark):
    group = st.Wrap(lambda text, n: [st.Node(n.start + a + 1, n.start + b - 1, "group") for a, b in tx.balanced(text[n.start : n.stop], "(", ")")])
    group.children(group)
    text = "(1(2(3))(4))"
    assert labelled(text, group(text)) == [("group", "1(2(3))(4)"), ("group", "2(3)"), ("group", "3"), ("group", "4")]
    rows = st.segment(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), group).orderBy("pre").collect()
    assert [(r.pre, r.last, r.parent, r.depth, r.ord) for r in rows] == [(0, 4, None, 0, 0), (1, 4, 0, 1, 0), (2, 3, 1, 2, 0), (3, 3, 2, 3, 0), (4, 4, 1, 2, 1)]


@pytest.mark.parametrize(("pattern", "want"), [("a", [" ", "1b2c "]), (r"\d", [" a", "b", "c "]), (" ", ["a1b2c"]), ("x", [" a1b2c "]), (".+", [])])
def test_invert(pattern, want):
    assert texts(" a1b2c ", st.Invert(pattern)(" a1b2c ")) == want


def test_first_of():
    stage = st.FirstOf(st.Extract(r"(?P<number>\d+)"), st.Extract(r"(?P<word>\w+)"))
    assert labelled("She bought 12 eggs", stage("She bought 12 eggs")) == [("number", "12")]
    assert [x for x, _ in labelled("She", stage("She"))] == ["word"]


def test_sequences():
    text = "One Two Three Four"
    words = lambda: st.Split(" ")
    both_t = lambda text, w: all(text[n.start] == "T" for n in w)
    assert texts(text, words().after(st.joined_windows(2, both_t))(text)) == ["One", "Two Three", "Four"]
    assert texts(text, words().after(st.joined_windows(3, lambda t, w: True))(text)) == ["One Two Three", "Four"]
    begins = lambda text, n: text[n.start] == "T"
    reduce = lambda text, ns: st.covering(ns, "run")
    assert texts(text, words().after(st.reduced_runs(reduce, begins))(text)) == ["One", "Two Three Four"]
    assert texts(text, words().after(st.reduced_runs(reduce, begins, lambda t, held, n: begins(t, n)))(text)) == ["One", "Two", "Three Four"]
    with pytest.raises(ValueError):
        st.joined_windows(1, both_t)


def test_nesting_of_shuffled_spans():
    rng = random.Random(2)

    def grown(a, b, depth):
        out, at = [], a
        while depth and b - at > 2:
            x = rng.randrange(at, b - 1)
            y = rng.randrange(x + 1, b)
            out += [(x, y), *grown(x, y, depth - 1)]
            at = y
        return out

    spans = sorted(set(grown(0, 2048, 6)), key=lambda s: (s[0], -s[1]))
    mixed = spans[:]
    rng.shuffle(mixed)
    rows = list(nested(mixed))
    assert [(r[5], r[6]) for r in rows] == spans
    for r in rows:
        inside = [q for q in rows if q[0] < r[0] and q[5] <= r[5] and r[6] <= q[6]]
        assert r[2] == (max(inside)[0] if inside else None)
    with pytest.raises(SegmentError):
        list(nested([(0, 5), (3, 8)]))
    assert len(list(nested([(0, 5), (3, 8)], "drop"))) == 1
    assert [r[2] for r in nested([(0, 3, k) for k in range(3)])] == [None, 0, 1]


def test_spans():
    assert Span.clamped(10, -3) == Span(7, 10) and Span.clamped(10, 8, 2) == Span(8, 8) and Span.clamped(3, 0, 99) == Span(0, 3)
    assert Span(1, 2).moved(-1) == Span(0, 1)
    with pytest.raises(SegmentError):
        Span(1, 2).moved(-2)


SENTENCES = [
    ["Yes."],
    ["The king was John I.", "Henry was his son."],
    ["Mary spake.", "Then John"],
    ["Wait... how can that be?!?", "Tell me!!", "Why is this so hard!?!"],
    ["He lived a long life.", "100 years approximately."],
    ["Hippocrates was born c. 460 bce.", "See pp. 431 in your history book for details."],
    ["Jane et. al. worked for Smith & Co. last year."],
    ["Dr. Francis, brother of Prof.\nMustard, and Brig. Gen. Adams hiked together near Mt. Rainer."],
    ["Ok, Mr.", "There is no Dr.", "What shall we do?"],
    ["The U.S. Government decided against action."],
]


@pytest.mark.parametrize("want", SENTENCES)
def test_sentences(want):
    for gap in ("  ",) if "John I" in want[0] else (" ", "  "):  # one blank after an initial ends nothing
        text = gap.join(want)
        assert texts(text, nlp.sentences()(text)) == want


def test_numbers():
    own = st.Extract(nlp.Number().pattern)
    for text in ("1", "+1", "-1,234.5", ".5", "1.5e-10", "3 x 10^ 5", "12,345,678"):
        assert texts(text, own(text)[:1]) == [text], text
    strict = st.Extract(nlp.Number(thousands_sep_optional=False).pattern)
    assert texts("1,234", strict("1,234")) == ["1,234"] and strict("1234") == []
    with pytest.raises(ValueError):
        nlp.Number(thousands_sep=" ")


def test_nlp_tree():
    text = "It's 3.5 here. Yes.\n\nEnd - of-day"
    got = labelled(text, nlp.nlp()(text))
    assert [x for x in got if x[0] in ("paragraph", "sentence", "word", "number")] == [
        ("paragraph", "It's 3.5 here. Yes."), ("sentence", "It's 3.5 here."), ("word", "It's"), ("number", "3.5"), ("word", "here"), ("sentence", "Yes."), ("word", "Yes"),
        ("paragraph", "End - of-day"), ("sentence", "End - of-day"), ("word", "End"), ("word", "of-day"),
    ]
    assert ("char", "I") in labelled(text, nlp.nlp(number=None, chars=True)(text))
    assert texts(" \n a \n\n b ", nlp.Paragraph(trim=True).stage()(" \n a \n\n b ")) == ["a", " b"]


def test_paragraphs_are_the_same_natively(spark):
    rows = [(0, "a\n\nb \t\n\n\nc"), (1, "\n\na\n"), (2, ""), (3, None), (4, "é😀\n \nx\n\n")]
    got = sorted((r.doc_id, r.start, r.stop) for r in nlp.paragraph_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(d, n.start, n.stop) for d, t in rows if t for n in nlp.Paragraph().stage()(t)]


def test_xml():
    text = '<?xml version="1.0"?><a x:k="é>" xmlns:x="u"><b>1<c>2<d/>3</c></b>4<!--n--><x:e q=\'"\' /></a>'
    root = packs.xml_tree(text)
    got = labelled(text, [root])
    assert [x for k, x in got if k == "text"] == ["1", "2", "3", "4<!--n-->"]
    assert [x for k, x in got if k == "end_tag"] == ["</d>"[:0] + "</c>", "</b>", "</a>"]
    assert [x for k, x in got if k == "value"] == ["é>", "u", "n", '"']
    assert ("comment", "<!--n-->") in got and ("namespace", "x") in got and ("tag", "x:e") in got
    with pytest.raises(packs.XmlError):
        packs.xml_tree("<a><b></a>")


def test_xml_helpers(spark):
    docs = spark.createDataFrame([(1, '<a xmlns="d" xmlns:p="u"><p:b k="v"/><c xmlns="e"><b/></c></a>'), (2, "no xml")], "doc_id bigint, text string")
    trees = packs.segment_xml(docs, on_error="drop").cache()
    assert sorted((r.local, r.prefix or "", r.uri) for r in packs.resolved(trees, docs).collect()) == [("a", "", "d"), ("b", "", "e"), ("b", "p", "u"), ("c", "", "e")]
    assert packs.descendants_by_local_name(trees, docs, "b").count() == 2
    assert trees.where("doc_id = 2").count() == 1
    assert packs.QualifiedName.parse("p:b") == packs.QualifiedName("p", "b") and packs.expanded_name("{u}b") == ("u", "b") and packs.expanded_name("b") == (None, "b")


TABLES = {
    "TYPE_1": "-----+-----+-----\n  A  |  B  |  C\n-----+-----+-----\n aaa | bbb | ccc\n-----+-----+-----",
    "TYPE_2": "-------------------\n|  A  |  B  |  C  |\n|-----------------|\n| aaa | bbb | ccc |\n-------------------",
}


@pytest.mark.parametrize("name", TABLES)
@pytest.mark.parametrize("around", ["", "\n"])
def test_tables(name, around):
    style = getattr(packs, name)
    for indent in ("", " ", "\t", "\t ") if style.indented else ("",):
        text = around + "\n".join(indent + line for line in TABLES[name].split("\n")) + around
        found = packs.tables(style)(text)
        assert [n.label for n in found] == ["table"] and [k.label for k in found[0].kids] == ["row", "row"]


def test_rules(spark):
    rules = packs.Rules({("vehicle", "car"): ["Ford"], ("vehicle", "airplane"): ["Cessna"], (): ["a"]})
    docs = spark.createDataFrame([(1, "a Ford and a Cessna")], "doc_id bigint, text string")
    hits = packs.discover(docs, rules)
    assert sorted(("/".join(r.path), r.start, r.stop) for r in hits.collect()) == sorted([("", 0, 1), ("", 7, 8), ("", 11, 12), ("", 18, 19), ("vehicle/airplane", 13, 19), ("vehicle/car", 2, 6)])
    assert packs.under(hits, ["vehicle"]).count() == 2 and packs.by_path(hits).count() == 3
    assert packs.followed_by(packs.under(hits, ["vehicle", "car"]), packs.under(hits, ["vehicle", "airplane"])).count() == 1
    assert list(rules[["vehicle"]].rules) == [("car",), ("airplane",)]
    with pytest.raises(KeyError):
        rules[("ship",)]


def test_dumps_and_json(spark):
    text = "See Jack run."
    tree = [st.Node(0, 12, "Phrase", kids=[st.Node(0, 3, "Word"), st.Node(4, 8, None)])]
    rows = [dict(zip(("pre", "last", "parent", "depth", "ord", "start", "stop", "label"), r, strict=False)) for r in st.flattened(tree)]
    assert store.dump(rows, text, "compact").split("\n")[1] == "    1: (0, 3) 'Word' : 'See'" or "%desc" not in store.dump(rows, text, "compact")
    assert store.dump(rows, text, "tree").split("\n")[2].startswith("└──(4, 8)")
    import json
    import xml.dom.minidom

    assert json.loads(store.dump(rows, text, "json"))["itos"][0]["children"][0]["substr"] == "See"
    assert len(xml.dom.minidom.parseString(store.dump(rows, text, "xml")).getElementsByTagName("ito")) == 3
    df = spark.createDataFrame([(1, *[r[c] for c in r]) for r in rows], "doc_id bigint, pre int, last int, parent int, depth int, ord int, start int, stop int, label string")
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    for js in (store.to_json(df), store.to_json(df, docs)):
        assert sorted(map(tuple, store.from_json(js).collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("name", tx.CLASSES)
def test_string_classes(spark, name):
    values = ["", "a", "A", "aB1", "1", "²", "½", " ", "\t ", "Ab Cd", "é", "_x", "x\n", "😀"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(99, None)], "i int, s string")
    got = {r.i: r.x for r in df.select("i", tx.is_class(df.s, name).alias("x")).collect()}
    assert got == {**{i: getattr(v, name)() for i, v in enumerate(values)}, 99: None}


def test_text_functions_are_pythons(spark):
    values = ["", "a", "abcabc", "xxabc  ", "\t a  ", "é😀bé", "a b  c", "aXbXXc", "l1\r\nl2\nl3 l4\n"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    s = df.s
    cases = {"count": (lambda x: x.count("b"), tx.count(s, "b")), "empty": (lambda x: x.count(""), tx.count(s, ""))}
    for k, (a, b) in enumerate([(None, None), (1, None), (0, 3), (-3, -1), (9, None), (2, 1)]):
        cases[f"find{k}"] = (lambda x, a=a, b=b: x.find("b", a, b), tx.find(s, "b", a, b))
        cases[f"rfind{k}"] = (lambda x, a=a, b=b: x.rfind("b", a, b), tx.rfind(s, "b", a, b))
        cases[f"find_none{k}"] = (lambda x, a=a, b=b: x.find("", a, b), tx.find(s, "", a, b))
        cases[f"rfind_none{k}"] = (lambda x, a=a, b=b: x.rfind("", a, b), tx.rfind(s, "", a, b))
        cases[f"starts{k}"] = (lambda x, a=a, b=b: x.startswith(("a", "b"), a, b), tx.starts_with(s, "a", "b", start=a, end=b))
        cases[f"ends{k}"] = (lambda x, a=a, b=b: x.endswith(("c", "é"), a, b), tx.ends_with(s, "c", "é", start=a, end=b))
    cut = lambda span: tx.substring_of(s, span["start"], span["stop"])
    for side, f in (("both", str.strip), ("left", str.lstrip), ("right", str.rstrip)):
        for chars in (None, "ax"):
            cases[f"{side}{chars}"] = (lambda x, f=f, c=chars: f(x, c), cut(tx.strip(s, chars, side)))
    for k in range(3):
        cases[f"partition{k}"] = (lambda x, k=k: x.partition("b")[k], cut(tx.partition(s, "b")[k]))
        cases[f"rpartition{k}"] = (lambda x, k=k: x.rpartition("b")[k], cut(tx.rpartition(s, "b")[k]))
    cases["prefix"] = (lambda x: x.removeprefix("ab"), cut(tx.remove_prefix(s, "ab")))
    cases["suffix"] = (lambda x: x.removesuffix("bc"), cut(tx.remove_suffix(s, "bc")))
    for r in df.select("i", *[c.alias(n) for n, (_, c) in cases.items()]).collect():
        for n, (f, _) in cases.items():
            assert r[n] == f(values[r.i]), (n, values[r.i])
    lists = {
        "split": (lambda x: x.split(), tx.split_spans(s)), "rsplit1": (lambda x: x.rsplit(None, 1), tx.split_spans(s, None, 1, True)), "X": (lambda x: x.split("X"), tx.split_spans(s, "X")),
        "rX1": (lambda x: x.rsplit("X", 1), tx.split_spans(s, "X", 1, True)), "lines": (lambda x: x.splitlines(), tx.line_spans(s)), "keep": (lambda x: x.splitlines(True), tx.line_spans(s, True)),
    }
    for r in df.select("i", *[c.alias(n) for n, (_, c) in lists.items()]).collect():
        for n, (f, _) in lists.items():
            assert [values[r.i][x.start : x.stop] for x in r[n]] == f(values[r.i]), (n, values[r.i])


def test_balance_escapes_and_formats():
    assert [x for x in tx.balanced("(123(abc)(def)456)", "(", ")")] == [(0, 18)]
    assert tx.balanced("|a||b|", "|", "|") == [(0, 3), (3, 6)] and tx.unescaped(r"a\&b&", "&") == [4] and tx.escapes("\\\\\\") == [0, 2]
    for bad in ("(", ")", "a\\"):
        with pytest.raises(ValueError):
            tx.balanced(bad, "(", ")")
    own = lambda spec: tx.format_node(spec, "012345 a long tail", 2, 18, "L", None)
    assert own("%span") == "(2, 18)" and own("%start:>4|%stop") == "   2|18" and own("%desc!r %substr:6…") == "'L' 2345 …"
    assert own("%substr:<6…") == "… tail" and own("%substr:^6…") == "234…il" and own("%substr:2....") == ".." and own("a% b") == "ab" and own("") == "2345 a long tail"
