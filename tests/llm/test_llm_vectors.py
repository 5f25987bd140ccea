import numpy as np
import pytest

from treespan.llm import collision, multiindex
from treespan.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int, id int, V string, w int, h1 int, block int, cell int"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3, 4, 5, 6) for i, v in zip(range(len(vectors)) if ids is None else ids, vectors, strict=True)], SCHEMA)


def planted(n, d, seed):
    """Random vectors, with groups of copies and of near ones."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for k in range(0, n - 12, 12):
        x[k + 1] = x[k]
        x[k + 2 : k + 8] = x[k] + 0.25 * rng.normal(size=(6, d))
        x[k + 8] = 3 * x[k]
    x[: n // 6] = x[0] + 0.05 * rng.normal(size=(n // 6, d))
    return x.astype(np.float32)


ODD = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0, 2.0], [1.0] * 8, [1.0] * 8, [2.0] * 8]


def linked(x, least=0.9):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    adj = unit @ unit.T >= least
    np.fill_diagonal(adj, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(adj, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            return adj.sum(axis=1), label
        label = new


def test_links_against_all_pairs(spark):
    x = planted(1500, 24, 1).astype(float)
    links, label = linked(x)
    got = {r.vec_id: r for r in multiindex.near_duplicates(frame(spark, x.tolist())).collect()}
    assert sorted(got) == list(range(len(x)))
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.97 * links.sum()
    same = np.array([got[i].component_id for i in range(len(x))]) == label
    assert same.mean() >= 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_vectors_link_with_nothing(spark):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in multiindex.near_duplicates(frame(spark, ODD)).collect()}
    assert got == {**{i: (0, i, True) for i in range(7)}, 7: (2, 7, True), 8: (2, 7, False), 9: (2, 7, False)}
    assert multiindex.near_duplicates(frame(spark, [])).collect() == []
    assert [tuple(r) for r in multiindex.near_duplicates(frame(spark, ODD[:3])).orderBy("vec_id").collect()] == [(i, 0, i, True) for i in range(3)]


def test_equal_vectors_are_a_class_of_any_size(spark):
    got = multiindex.near_duplicates(frame(spark, [[1.0, 2.0, 3.0, 4.0]] * 3000)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(2999, 0)}


def brute(x, ids, k, modulus):
    out = {}
    x = x.astype(float)
    for i, own in enumerate(ids):
        if own % modulus == 0:
            s = (x * x[i]).sum(axis=1)
            rows = [j for j in np.lexsort((ids, -s)) if ids[j] != own][:k]
            out[own] = [(int(ids[j]), s[j]) for j in rows]
    return out


@pytest.mark.parametrize("n", [15, 300, 6000])
def test_search_against_all_rows(spark, n):
    x = planted(max(n, 30), 24, 2)[:n]
    want = brute(x, np.arange(n), 20, 20)
    got = {}
    for r in collision.search(frame(spark, x.tolist())).orderBy("query_id", "rank").collect():
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        assert r.score == pytest.approx(float(x[r.query_id].astype(float) @ x[r.vec_id].astype(float)), rel=1e-12, abs=1e-12)
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == sorted(want) and all(len(got[q]) == len(want[q]) for q in want)
    hit = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hit >= (0.9 if n > 1000 else 1.0) * sum(map(len, want.values()))
    for q, found in got.items():
        assert found == sorted(found, key=lambda p: (-p[1], p[0])), q


def test_search_of_odd_vectors(spark):
    got = collision.search(frame(spark, ODD), modulus=7).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(7, 1, 9, 16.0), (7, 2, 8, 8.0)]
    assert collision.search(frame(spark, [])).collect() == []
    ties = collision.search(frame(spark, [[1.0, 0.0]] * 40)).where("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in ties] == list(range(1, 21))


def test_lengths_are_spaces_of_their_own(spark):
    x = [[1.0, 0.0], [2.0, 0.0], [1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [0.0, 1.0]]
    got = {r.vec_id: (r.n_links, r.component_id) for r in multiindex.near_duplicates(frame(spark, x)).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (1, 2), 3: (1, 2), 4: (0, 4)}
    found = sorted((r.query_id, r.rank, r.vec_id) for r in collision.search(frame(spark, x), modulus=2).collect())
    assert found == [(0, 1, 1), (0, 2, 4), (2, 1, 3), (4, 1, 0), (4, 2, 1)]


def test_a_part_of_the_rows_is_verified(monkeypatch):
    """Of both indexes: most rows are never compared with a query."""
    rng = np.random.default_rng(5)
    x, seen = rng.normal(size=(8000, 64)), []
    real = collision.Windows.candidates
    monkeypatch.setattr(collision.Windows, "candidates", lambda self, at, need: seen.append(len(r := real(self, at, need))) or r)
    ids = np.arange(8000)
    collision.search_block(ids, x, ids[:100], x[:100], 20, collision.SHARE, 1)
    assert len(seen) == 100 and np.mean(seen) <= 0.25 * 8000
    near = multiindex.unit(np.repeat(x[:1000], 8, axis=0) + 0.1 * rng.normal(size=(8000, 64)))
    grid = multiindex.Grid(near[:4000], 8000, 0.9, 0.98)
    home, cell = grid.home(near), grid.visited(near[:500])
    count = np.bincount(home, minlength=len(grid.books[0]) * len(grid.books[1]))
    assert count[cell].sum(axis=1).mean() <= 0.25 * 8000


def test_queries(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    links, label = linked(x.astype(float))
    got = {r.vec_id: r for r in QUERIES["op4_multi_index"](spark, sf_dir).collect()}
    assert sum(got[v].n_links for v in ids) >= 0.9 * links.sum()
    assert np.mean([got[v].component_id == ids[label[i]] for i, v in enumerate(ids)]) >= 0.95
    want = brute(x, ids, 20, 20)
    found = {(r.query_id, r.vec_id) for r in QUERIES["op8_collision_counting"](spark, sf_dir).collect()}
    assert len(found & {(q, v) for q in want for v, _ in want[q]}) >= 0.9 * sum(map(len, want.values()))
