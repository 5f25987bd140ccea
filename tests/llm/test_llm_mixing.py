import random
import re

import pytest

from treespan.llm import mixing
from treespan.llm.queries import QUERIES, SQL

from .conftest import prose


def test_query_against_sql(spark, sf_dir, against_sql):
    against_sql(QUERIES["op3_mixing"](spark, sf_dir), SQL["op3_mixing"], sf_dir)


def rule_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by repeated sharing; sizes are in the order of the sources."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = (total - sum(target[i] for i in range(len(sizes)) if i not in open_)) / sum(w[i] for i in open_)
        over = [i for i in open_ if level * w[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = level * w[i]
            break
        for i in over:
            target[i] = cap * sizes[i]
            open_.remove(i)
    return target


def test_rules(frame):
    rng = random.Random(1)
    names = ["b", "a", None, "é", "Z"]
    share = [300, 40, 60, 5, 20]
    texts, sources = [], []
    for name, n in zip(names, share, strict=True):
        texts += [prose(rng.random(), rng.randrange(0, 60)) for _ in range(n)]
        sources += [name] * n
    texts[3], texts[4] = None, ""
    got = mixing.mix(frame(texts, sources=sources)).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    size = [len(re.findall(mixing.WORD, t or "")) for t in texts]
    order = sorted({s for s in names if s is not None}) + [None]
    total = [sum(n for n, s in zip(size, sources, strict=True) if s == x) for x in order]
    target = rule_targets(total)
    assert sum(target) == pytest.approx(1.5 * sum(total))
    taken = dict.fromkeys(order, 0)
    for r in got:
        at = order.index(sources[r.doc_id])
        assert (r.size, r.source_size) == (size[r.doc_id], total[at])
        assert r.target == pytest.approx(target[at])
        assert 0 <= r.taken <= 2 * r.size
        taken[order[at]] += r.taken
    for x, t in zip(order, target, strict=True):
        assert abs(taken[x] - t) <= 8 + 0.02 * t
    again = mixing.mix(frame(texts, sources=sources)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_highest_quotients(spark):
    votes = [53, 24, 23, 0, 23]
    df = spark.createDataFrame([(i, float(v), 10) for i, v in enumerate(votes)], "tie int, weight double, seats int")
    got = {r.tie: r.seats_won for r in mixing.sainte_lague(df, "weight", "seats", "tie").collect()}
    quotients = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) for k in range(10)))[:10]
    assert got == {i: sum(q[1] == i for q in quotients) for i in range(5)}


def test_empty_and_repeats(frame):
    assert mixing.mix(frame([])).collect() == []
    assert mixing.mixed(frame([])).collect() == []
    got = mixing.mix(frame([None, "", None], ids=[1, 1, None])).collect()
    assert sorted((r.size, r.taken, r.target) for r in got) == [(0, 0, 0.0)] * 3
    df = frame([prose(i, 30) for i in range(50)], ids=[*range(49), 3])
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert 1 <= out.count() <= 100
