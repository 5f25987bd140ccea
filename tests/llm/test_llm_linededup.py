import random

from pyspark.sql import functions as F

from treespan.llm import linededup
from treespan.llm.queries import QUERIES

from .conftest import prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def near(a, b, tau):
    if abs(len(a) - len(b)) > tau:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    return max(len(a), len(b)) <= tau or distance(a, b) <= tau


def brute(docs, tau=linededup.TAU):
    """(id, pos) of the lines that go -> the occurrence that stays."""
    lines = [(i, p, x.strip(" \t\r")) for i, t in docs if i is not None for p, x in enumerate((t or "").split("\n")) if t is not None]
    lines = sorted({x for x in lines if len(x[2]) >= linededup.MIN_CHARS})
    texts = sorted({x[2] for x in lines}, key=lambda x: (len(x), x))
    to = {x: x for x in texts}

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for n, x in enumerate(texts):
        for y in texts[n + 1 :]:
            if len(y) - len(x) > tau:
                break
            if near(x, y, tau):
                to[root(y)] = root(x)
    first = {}
    for i, p, x in lines:
        first.setdefault(root(x), (i, p))
    return {(i, p): first[root(x)] for i, p, x in lines if (i, p) != first[root(x)]}


def edit(text, rng):
    i = rng.randrange(len(text))
    return rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("eazé") + text[i:], text[:i] + rng.choice("eazé") + text[i + 1 :]])


def corpus(seed):
    rng = random.Random(seed)
    base = [prose(rng.random(), rng.randrange(3, 12)) for _ in range(25)]
    docs = []
    for i in range(60):
        rows = []
        for _ in range(rng.randrange(1, 8)):
            x = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                x = edit(x, rng)
            rows.append(rng.choice([x, f"  {x}\t", x + "\r"]))
        docs.append((i, "\n".join(rows)))
    return docs


def decided(df, tau):
    return {(r.id, r.pos): (r.first_id, r.first_pos) for r in linededup.decisions(df, tau).collect()}


def test_against_all_pairs(frame):
    docs = corpus(3)
    df = frame([t for _, t in docs])
    assert decided(df, 1) == brute(docs, 1)
    assert decided(df, 2) == brute(docs, 2)


def test_bit_parallel_distance(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(400):
        a = b = "".join(rng.choice("ab😀") for _ in range(rng.randrange(4, 24)))
        for _ in range(rng.randrange(0, 4)):
            b = edit(b, rng)
        a, b = sorted((a, b), key=len)
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for tau in (1, 2, 3):
        near = df.where(F.length("b") - F.length("a") <= tau)
        got = near.select("a", "b", linededup.within(F.col("a"), F.col("b"), tau).alias("hit")).collect()
        assert got and all(r.hit == (distance(r.a, r.b) <= tau) for r in got)
        for most in range(1, tau + 1):
            got = near.select("a", "b", linededup.within(F.col("a"), F.col("b"), tau, F.lit(most)).alias("hit"), linededup.part_kept(F.col("a"), F.col("b"), F.lit(most)).alias("part")).collect()
            assert all(r.hit == (distance(r.a, r.b) <= most) and (r.part or not r.hit) for r in got)


def test_dedup_takes_the_lines_out(frame):
    docs = corpus(4)
    df = frame([t for _, t in docs])
    gone = brute(docs)
    out = linededup.dedup(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in docs}


def test_nulls_repeats_odd_and_empty(frame, odd_texts):
    line = "a line of more than twenty characters"
    texts = [line, line, None, "", f"{line}\n{line}", line]
    ids = [4, 4, 5, 6, None, 2]
    out = sorted(((r.doc_id, r.text) for r in linededup.dedup(frame(texts, ids=ids)).collect()), key=repr)
    assert out == sorted([(4, ""), (4, ""), (5, None), (6, ""), (None, f"{line}\n{line}"), (2, line)], key=repr)
    assert decided(frame(odd_texts), 1) == brute(list(enumerate(odd_texts)))
    assert linededup.dedup(frame([])).collect() == [] and linededup.per_document(frame([])).collect() == []


def brute_by_length(docs, tau, chars):
    """As ``brute``, with every non-empty line and a threshold of one edit for each ``chars`` characters of the shorter line."""
    lines = [(i, p, x.strip(" \t\r")) for i, t in docs for p, x in enumerate(t.split("\n"))]
    lines = sorted(x for x in lines if x[2])
    texts = sorted({x[2] for x in lines}, key=lambda x: (len(x), x))
    to = {x: x for x in texts}

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for n, x in enumerate(texts):
        t = min(tau, len(x) // chars)
        for y in texts[n + 1 :]:
            if len(y) - len(x) > t:
                break
            if near(x, y, t):
                to[root(y)] = root(x)
    first = {}
    for i, p, x in lines:
        first.setdefault(root(x), (i, p))
    return {(i, p): first[root(x)] for i, p, x in lines if (i, p) != first[root(x)]}


def decided_by_length(df, tau, chars):
    return {(r.id, r.pos): (r.first_id, r.first_pos) for r in linededup.decisions(df, tau, chars=chars).collect()}


def test_short_lines_are_removed_if_equal(frame):
    docs = list(enumerate(["Les.\nDes.\n\nx", "And ornd.\n Les. \nLes", "x\nAnd ornd.\n\nLes."]))
    got = decided_by_length(frame([t for _, t in docs]), 1, 20)
    assert got == {(1, 1): (0, 0), (2, 0): (0, 3), (2, 1): (1, 0), (2, 3): (0, 0)} == brute_by_length(docs, 1, 20)
    rows = {r.doc_id: (r.n_lines, list(r.gone)) for r in linededup.per_document(frame([t for _, t in docs]), 1, chars=20).collect()}
    assert rows == {0: (3, []), 1: (3, [1]), 2: (3, [0, 1, 3])}


def test_threshold_grows_with_the_length(frame):
    docs = corpus(5) + [(60, prose(7, 40)), (61, prose(7, 40).replace("e", "é", 3)), (62, prose(7, 40)[1:-2]), (63, prose(7, 40)[4:])]
    df = frame([t for _, t in docs])
    want = brute_by_length(docs, linededup.QUERY_TAU, linededup.QUERY_CHARS)
    assert {(61, 0), (62, 0)} <= set(want) and (63, 0) not in want
    assert decided_by_length(df, linededup.QUERY_TAU, linededup.QUERY_CHARS) == want


def test_query(spark, sf_dir):
    """Against all pairs of lines, by the thresholds that the query is registered with."""
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    gone = brute_by_length(docs, linededup.QUERY_TAU, linededup.QUERY_CHARS)
    got = {r.doc_id: r for r in QUERIES["op7_line_dedup"](spark, sf_dir).collect()}
    assert sorted(got) == sorted(i for i, _ in docs)
    for i, r in got.items():
        own = sorted(p for d, p in gone if d == i)
        assert list(r.gone) == own and r.n_gone == len(own)
        assert list(r.first_ids) == sorted({gone[i, p][0] for p in own})


def test_lines_within_the_threshold_share_a_key(spark):
    """And keys are hashed in rows, not by an interpreted function on an array."""
    rng, rows = random.Random(12), []
    for k in range(40):
        a = b = prose(k, rng.randrange(8, 20))
        for _ in range(min(3, len(a) // 20)):
            b = edit(b, rng)
        rows += [(2 * k, a), (2 * k + 1, b)]
    df = spark.createDataFrame(rows, "no long, line string").select("*", F.length("line").alias("length"), F.lit(0).cast("long").alias("counts"))
    held = {}
    for probes in (False, True):
        out = linededup.keys(df, 3, 20, probes)
        assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
        for r in out.collect():
            held.setdefault((r.no, probes), set()).add(r.key)
    text = dict(rows)
    for k in range(40):
        x, y = sorted((2 * k, 2 * k + 1), key=lambda n: len(text[n]))
        if distance(text[x], text[y]) <= min(3, len(text[x]) // 20):
            assert held[x, False] & (held[y, False] | held[y, True])


def test_lines_that_share_a_segment_make_no_rows_but_links(frame, monkeypatch):
    """Variants of a line that differ at eight places or so share segments and all letter counts; only links become rows."""
    rng = random.Random(5)
    base, lines = prose(2, 18), []
    for i in range(40):
        x = list(base)
        for _ in range(3):
            a, b = rng.sample(range(len(x)), 2)
            x[a], x[b] = x[b], x[a]
        lines += ["".join(x)] + (["".join(x[:7] + ["q"] + x[7:])] if i % 5 == 0 else [])
    docs, tables = list(enumerate(lines)), {}
    written = linededup.written

    def noted(df, kind="table", *more):
        out = written(df, kind, *more)
        tables[kind] = tables.get(kind, 0) + out.count()
        return out

    monkeypatch.setattr(linededup, "written", noted)
    df = frame(lines)
    want = brute_by_length(docs, 3, 20)
    for often, share, listed in ((1, 1, 1000), (1, 1, 0), (10**6, 1, 0)):
        monkeypatch.setattr(linededup, "LISTED", listed, raising=False)
        monkeypatch.setattr(linededup, "FREQUENT", often, raising=False)
        monkeypatch.setattr(linededup, "SHARE", share, raising=False)
        tables.clear()
        assert decided_by_length(df, 3, 20) == want
        if often == 1:
            assert 8 <= len(want) < len(lines) and tables["middles"] < len(lines)
    assert tables["middles"] > 2 * len(lines)
    texts = [(rng.choice(lines), rng.choice(lines)) for _ in range(40)] + [("😀" * 9 + a, "😀" * 9 + edit(a, rng)) for a in lines[:20]]
    got = df.sparkSession.createDataFrame(texts, "x string, y string").select("x", "y", linededup.alike(F.col("x"), F.col("y"), 3, 20).alias("hit")).collect()
    assert {r.hit for r in got} == {True, False} and all(r.hit == near(r.x, r.y, min(3, min(len(r.x), len(r.y)) // 20)) for r in got)
