"""Near-duplicate vectors by an inverted multi-index.

Both halves of the unit vectors have a codebook of their own (k-means on a bounded sample); the
product of the two is a grid of cells. A vector visits the cells nearest to it in increasing sum
of its halves' squared distances: the multi-sequence order, of which the first ``t`` cells are
found among the pairs of ranks with (a + 1) (b + 1) <= t, since every pair of smaller ranks comes
before. ``t`` is calibrated: sampled vectors are moved to exactly the least cosine in random
directions, and ``t`` is the rank that reaches the target share of their home cells; closer pairs
are found more often. What is visited is verified in double precision.

Equal vectors are one, with a weight. Cells are packed into blocks of at most about BLOCK members
(a larger cell is split over several), a block's visitors into parts of at most about VISITORS,
so a cell or group of any share is spread; within a part each visitor is compared with the members of
the cells it visits, no others, and no pair of vectors is ever a row: each part gives
link counts of its visitors and a spanning forest of its links, from which the components come.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, and neither does a null id; vectors of different lengths aren't compared; rows of one id are one node;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ragged
from .common import col, written
from .graph import components
from .vectors import matrix, spaces, usable

SAMPLE, MOVED = 8_192, 2_000  # vectors the codebooks are fitted on, and calibrated on, at most
CENTRES = 1_024  # of a codebook at most: a million cells
BLOCK, VISITORS = 1_024, 2_048


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None] if len(x) else x


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :], 0)


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = squared(x, centres).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Grid:
    def __init__(self, sample: np.ndarray, total: int, least: float, recall: float, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.half = max(1, sample.shape[1] // 2)
        k = int(np.clip(2 ** round(np.log2(max(total, 1) ** 0.5 / 4 + 1)), 1, CENTRES))
        self.books = [codebook(self.part(sample, h), min(k, len(sample)), rng) for h in (0, 1)]
        x = sample[:MOVED]
        noise = rng.normal(size=x.shape)
        noise -= (noise * x).sum(axis=1)[:, None] * x
        size = np.sqrt((noise * noise).sum(axis=1))
        moved = least * x + np.sqrt(max(0.0, 1 - least * least)) * noise / np.where(size > 0, size, 1)[:, None]
        d = [squared(self.part(x, h), self.books[h]) for h in (0, 1)]
        home = self.home(moved)
        own = d[0][np.arange(len(x)), home // len(self.books[1])] + d[1][np.arange(len(x)), home % len(self.books[1])]
        ranks = np.array([(d[0][i][:, None] + d[1][i][None, :] <= own[i]).sum() for i in range(len(x))])
        self.visits = int(np.quantile(ranks, recall, method="higher"))
        a, b = np.meshgrid(np.arange(len(self.books[0])), np.arange(len(self.books[1])), indexing="ij")
        near = (a + 1) * (b + 1) <= self.visits
        self.a, self.b = a[near], b[near]

    def part(self, x: np.ndarray, h: int) -> np.ndarray:
        return x[:, : self.half] if h == 0 else x[:, self.half :]

    def home(self, x: np.ndarray) -> np.ndarray:
        return squared(self.part(x, 0), self.books[0]).argmin(axis=1) * len(self.books[1]) + squared(self.part(x, 1), self.books[1]).argmin(axis=1)

    def visited(self, x: np.ndarray) -> np.ndarray:
        """The first cells of each row in multi-sequence order."""
        d = [squared(self.part(x, h), self.books[h]) for h in (0, 1)]
        order = [np.argsort(y, axis=1, kind="stable") for y in d]
        d = [np.take_along_axis(y, o, axis=1) for y, o in zip(d, order, strict=True)]
        sums = d[0][:, self.a] + d[1][:, self.b]
        top = np.argpartition(sums, self.visits - 1, axis=1)[:, : self.visits] if self.visits < sums.shape[1] else np.broadcast_to(np.arange(sums.shape[1]), sums.shape)
        line = np.arange(len(x))[:, None]
        return order[0][line, self.a[top]] * len(self.books[1]) + order[1][line, self.b[top]]


def pack(counts: dict[int, int], cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each cell and its number of blocks; small neighbours share one."""
    first, pieces, block, held = np.full(cells, -1, np.int64), np.zeros(cells, np.int64), 0, 0
    for c in sorted(counts):
        n = counts[c]
        if held and held + n > BLOCK:
            block, held = block + 1, 0
        first[c], pieces[c] = block, -(-n // BLOCK)
        held += n
        if n > BLOCK:
            block, held = block + int(pieces[c]), 0
    return first, pieces


def forest(adj: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what ``adj`` (left x right, ids) connects, about one an id."""
    i, j = np.nonzero(adj)
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes, at = np.unique(np.concatenate([left[i], right[j]]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    out = label != np.arange(len(nodes))
    return nodes[out], nodes[label[out]]


def visited_blocks(cell: np.ndarray, first: np.ndarray, pieces: np.ndarray) -> pa.ListArray:
    """For each row of ``cell`` (the cells that a vector visits) the blocks that hold members of these, each with its cells among them."""
    n, width = cell.shape
    row, c = np.repeat(np.arange(n), width), cell.ravel()
    row, c = row[first[c] >= 0], c[first[c] >= 0]
    block, row, c = ragged(first[c], pieces[c]), np.repeat(row, pieces[c]), np.repeat(c, pieces[c])
    order = np.lexsort((c, block, row))
    row, block, c = row[order], block[order], c[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])])) if len(row) else np.zeros(0, np.int64)
    cells = pa.ListArray.from_arrays(pa.array(np.append(new, len(c)), pa.int32()), pa.array(c))
    pairs = pa.StructArray.from_arrays([pa.array(block[new]), cells], ["block", "cells"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[new], np.arange(n + 1)), pa.int32()), pairs)


def near_duplicates(df: DataFrame, least: float = 0.9, recall: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, ``n_links`` (other vectors found with cosine >= least), ``component_id`` (smallest id reachable), ``kept``."""
    rest = df.select(col(id_col).cast("long").alias("id"), col(vector_col).cast("array<double>").alias("v"))
    out = rest.where(~(F.col("id").isNotNull() & usable(F.col("v")))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    for rows in spaces(df, id_col, vector_col):
        out = out.unionByName(linked(rows, least, recall))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def linked(rows: DataFrame, least: float, recall: float) -> DataFrame:
    """``id``, ``n_links``, ``component_id`` of the vectors (id, v) of one length."""
    spark = rows.sparkSession
    rows = written(rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v")), "vectors")
    one = written(rows.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("w"), F.first("v").alias("v")), "distinct")
    total = one.count()
    sample = unit(matrix(one.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column(0)))
    grid = Grid(sample, total, least, recall)
    shared = spark.sparkContext.broadcast(grid)  # two codebooks of at most CENTRES centres
    cells = len(grid.books[0]) * len(grid.books[1])

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.home(unit(matrix(batch.column(0)))))], ["cell"])

    counts = {r["cell"]: r["count"] for r in one.select("v").mapInArrow(homes, "cell bigint").groupBy("cell").count().collect()}  # at most CENTRES x CENTRES cells
    first, pieces = pack(counts, cells)
    packed = spark.sparkContext.broadcast((first, pieces))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (at, n) = shared.value, packed.value
        for whole in batches:
            for k in range(0, whole.num_rows, 1_000):
                batch = whole.slice(k, 1_000)
                ids, x = np.asarray(batch.column(0)), unit(matrix(batch.column(2)))
                home, cell = own.home(x), own.visited(x)
                block = at[home] + (ids * 2654435761 >> 16) % n[home]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64())), pa.array(block), pa.array(home), visited_blocks(cell, at, n)], ["id", "w", "v", "block", "home", "seen"])

    kind = "id bigint, w bigint, v array<double>, block bigint, home bigint, seen array<struct<block: bigint, cells: array<bigint>>>"
    placed = written(one.select("id", "w", "v").mapInArrow(visits, kind), "visits")
    parts = placed.select(F.explode("seen.block").alias("block")).groupBy("block").agg(F.ceil(F.count("*") / VISITORS).alias("parts"))
    parts = written(parts, "parts")
    members = placed.select("block", F.array("home").alias("cells"), "id", "w", "v").join(parts, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("member"), "cells", "id", "w", "v")
    guests = placed.select(F.explode("seen").alias("at"), "id", "w", "v").select("at.block", "at.cells", "id", "w", "v").join(parts, "block").select("block", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), F.lit(False).alias("member"), "cells", "id", "w", "v")

    def verify(table: pa.Table) -> pa.Table:
        is_member = np.asarray(table.column("member"))
        ids, w, x = np.asarray(table.column("id")), np.asarray(table.column("w")), matrix(table.column("v"))
        # Cell by cell: the members of a cell and the guests that visit it.
        lists = table.column("cells").combine_chunks()
        at = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths()))
        cell = np.asarray(lists.flatten())
        order = np.lexsort((is_member[at], cell))
        at, cell = at[order], cell[order]
        links, ea, eb = np.zeros(len(ids), np.int64), [], []
        for group in np.split(at, np.flatnonzero(np.diff(cell)) + 1) if len(at) else []:
            q, m = group[~is_member[group]], group[is_member[group]]
            if not len(m):
                continue
            for k in range(0, len(q), 512):
                own = q[k : k + 512]
                adj = x[own] @ x[m].T >= least
                adj &= ids[own][:, None] != ids[m][None, :]
                if adj.any():
                    links[own] += adj @ w[m]
                    a, b = forest(adj, ids[own], ids[m])
                    ea.append(a)
                    eb.append(b)
        q = np.flatnonzero(~is_member)
        links = links[q]
        some = links > 0
        a, b = (np.concatenate(e or [np.zeros(0, np.int64)]) for e in (ea, eb))
        return pa.table({"id": np.concatenate([ids[q][some], a]), "links": np.concatenate([links[some], np.zeros(len(a), np.int64)]), "to": pa.array(np.concatenate([np.zeros(int(some.sum()), np.int64), b]), mask=np.concatenate([np.ones(int(some.sum()), bool), np.zeros(len(b), bool)]))})

    found = written(members.unionByName(guests).groupBy("block", "part").applyInArrow(verify, "id bigint, links bigint, to bigint"), "links")
    links = found.where("to IS NULL").groupBy("id").agg(F.sum("links").alias("links"))
    known = components(found.where("to IS NOT NULL").select("id", "to"))
    of = one.select("h1", "h2", "id", "w").join(links, "id", "left").join(known.withColumnRenamed("node", "id"), "id", "left")
    of = of.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return rows.select("id", "h1", "h2").join(of, ["h1", "h2"]).select("id", "n_links", "component_id")
