"""Nearest neighbours by collision counting on single projections.

Largest inner products become nearest points by one more coordinate: rows get
sqrt(M^2 - |x|^2), M the largest norm, queries 0. A block of rows has, for each of PROJECTIONS
random directions, its rows sorted by their projection. Around a query's own projection a window
is opened in each sorted array and widened by the same factor in all (virtual rehashing: no table
is built again); rows in a window collide with the query there. Windows stop once ``share`` of the
block's rows, LEAST at least, have collided THRESHOLD of the times; those rows are verified: exact
inner products in double precision of the original vectors, the largest kept. ``share`` and
THRESHOLD are set by recall against brute force (figures in the README).

The queries are dealt into chunks and the rows into blocks, both bounded; each pair of them is one
task's group and gives at most ``k`` rows a query.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do null ids; vectors of another length than the query's aren't its candidates; rows of the query's own id aren't its
candidates; equal scores go by smaller id; equal rows of one id are candidates each; a query
without candidates, and an empty table, give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import matrix, spaces

PROJECTIONS, THRESHOLD, SHARE, WIDEN = 128, 0.75, 0.08, 1.1
LEAST = 400  # rows of a block that collide often enough before its windows stop, at least
BLOCK, CHUNK = 8_192, 1_024


class Windows:
    """The sorted arrays of a block, and the windows around a query in them."""

    def __init__(self, spots: np.ndarray):
        self.m, self.n = spots.shape
        order = np.argsort(spots, axis=1, kind="stable")
        self.kind = np.uint16 if self.n < 65_000 else np.uint32
        self.place = np.empty(spots.shape, self.kind)  # of each row in each sorted array
        np.put_along_axis(self.place, order, np.broadcast_to(np.arange(self.n, dtype=self.kind), spots.shape), axis=1)
        low, high = spots.min(), spots.max()
        # One sorted array for all projections: each is moved beyond the one before.
        self.step = 4 * max(high - low, 1e-9) + 1
        self.low, self.high = low - self.step / 8, high + self.step / 8
        self.lift = np.arange(self.m) * self.step
        self.flat = (np.take_along_axis(spots, order, axis=1) + self.lift[:, None]).ravel()
        self.first = np.arange(self.m) * self.n
        self.width = max(high - low, 1e-9) / 16  # the next query begins below what the last one needed

    def ends(self, at: np.ndarray, side: str) -> np.ndarray:
        return np.clip(np.searchsorted(self.flat, np.clip(at, self.low, self.high) + self.lift, side=side) - self.first, 0, self.n)

    def candidates(self, at: np.ndarray, need: int) -> np.ndarray:
        """Rows that collide often enough with a query whose projections are ``at``."""
        width = self.width / WIDEN
        while True:
            a, b = self.ends(at - width, "left"), self.ends(at + width, "right")
            # A row is in a window if its place is; places before it wrap round to large numbers.
            inside = (self.place - a.astype(self.kind)[:, None]) < (b - a).astype(self.kind)[:, None]
            count = np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)
            found = np.flatnonzero(count >= THRESHOLD * self.m)
            if len(found) >= need:
                self.width = width
                return found
            width *= WIDEN


def search_block(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, share: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, row ids and scores of the best ``k`` rows of the block for each query."""
    n = len(ids)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    need = max(LEAST, k + 1, int(np.ceil(share * n)))
    if need < n:
        norm = (x * x).sum(axis=1)
        wide = np.hstack([x, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]])
        axes = np.random.default_rng(seed).normal(size=(PROJECTIONS, wide.shape[1]))
        spots, at = axes @ wide.T, q @ axes[:, :-1].T
        # A query's length doesn't change the order of its inner products; at the rows' length its windows are centred best.
        at *= (np.sqrt(norm.max()) / np.sqrt((q * q).sum(axis=1)))[:, None]
        windows = Windows(spots)
    for i in range(len(qids)):
        rows = windows.candidates(at[i], need) if need < n else np.arange(n)
        rows = rows[ids[rows] != qids[i]]
        score = x[rows] @ q[i]
        if len(rows) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            rows = rows[score >= least - 1e-9 * (1 + abs(least))]
        score = (x[rows] * q[i]).sum(axis=1)  # row by row alike, so equal vectors tie
        top = np.lexsort((ids[rows], -score))[:k]
        out.append((np.full(len(top), qids[i]), ids[rows][top], score[top]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def search(df: DataFrame, modulus: int = 20, k: int = 20, share: float = SHARE, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` rows of largest inner product found for each row whose id ``modulus`` divides."""
    found = [found_in(rows, modulus, k, share, seed) for rows in spaces(df, id_col, vector_col)]
    if not found:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return functools.reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def found_in(rows: DataFrame, modulus: int, k: int, share: float, seed: int) -> DataFrame:
    """``query_id``, ``vec_id``, ``score`` of the best ``k`` rows of each block, among vectors of one length."""
    total = rows.count()
    # Of several vectors of one query id the smallest is asked for, so any run asks alike.
    queries = rows.where(F.col("id") % modulus == 0).groupBy("id").agg(F.min("v").alias("v"))
    asked = queries.count()
    block = min(max(BLOCK, total // 64), 65_536)
    blocks, chunks = max(1, -(-total // block)), max(1, -(-asked // CHUNK))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), spread(chunks).alias("chunk"), F.lit(False).alias("query"), "id", "v")
    asking = queries.select(spread(blocks).alias("block"), F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(True).alias("query"), "id", "v")

    def run(table: pa.Table) -> pa.Table:
        is_query = np.asarray(table.column("query"))
        ids, v = np.asarray(table.column("id")), matrix(table.column("v"))
        q, vec, score = search_block(ids[~is_query], v[~is_query], ids[is_query], v[is_query], k, share, seed) if (~is_query).any() else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": q, "vec_id": vec, "score": score})

    return data.unionByName(asking).groupBy("block", "chunk").applyInArrow(run, "query_id bigint, vec_id bigint, score double")
