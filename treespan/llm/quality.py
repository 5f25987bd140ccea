"""Quality classifier: a factorisation machine on hashed words and structure statistics.

score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all
pairwise interactions in time linear in the features, by the sum-of-squares identity.

Features: counts of lower-cased words hashed into BUCKETS, scaled to length 1; and one indicator
for the bin of each structure statistic (shares of upper-case letters, digits, symbols, line ends
and non-ASCII bytes; length; word length; distinct words; the commonest word), with bins at the
sample's quantiles. Ids, languages, sources and labels are never features.

The model is fitted on the driver on a bounded sample of labelled rows (``most``, the ids with the
smallest hashes); every text is scored whole, in one pass without a shuffle.

Defined results: null text counts as empty; an empty text gets the score of its statistics;
repeated rows are scored each; without labels of both kinds all scores are the share of label 1,
or 0.5 without labels; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import col, small_batches
from .words import coded, counted, labelled, sample, slices

BUCKETS, FACTORS, BINS = 1 << 15, 4, 16
SAMPLE = 12_000  # labelled rows the model is fitted on at most
_SYMBOL = frozenset(b"!#$%&*+/<=>@[\\]^_`{|}~")
#: Kinds of bytes: other, upper-case, digit, symbol, line end, not ASCII.
_KIND = np.array([1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in _SYMBOL else 4 if b == 10 else 5 if b > 127 else 0 for b in range(256)], np.uint8)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of the hashed words of each text (no nulls), and a matrix of its statistics."""
    n = len(texts)
    codes, sizes, distinct = coded(texts)
    bucket = np.array([zlib.crc32(w.encode()) % BUCKETS for w in distinct] or [0], np.int64)
    rows, which, count = counted(bucket[codes] if len(codes) else codes, sizes, BUCKETS)
    norm = np.sqrt(np.bincount(rows, count.astype(float) ** 2, n))
    value = count / norm[rows]
    stats = np.zeros((n, 9))
    lens = np.asarray(pc.binary_length(texts), dtype=np.int64)
    data = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
    starts = np.cumsum(lens) - lens
    full = np.flatnonzero(lens)
    kinds = _KIND[data]
    for k in range(1, 6):
        if len(full):
            stats[full, k - 1] = np.add.reduceat(kinds == k, starts[full], dtype=np.int64) / lens[full]
    words = np.maximum(sizes, 1)
    top = np.zeros(n)
    np.maximum.at(top, rows, count)
    stats[:, 5], stats[:, 6], stats[:, 7], stats[:, 8] = np.log1p(lens), lens / words, np.bincount(rows, minlength=n) / words, top / words
    return rows, which, value, stats


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    edges: np.ndarray  # of the bins, one row a statistic

    def indicators(self, stats: np.ndarray) -> np.ndarray:
        """The feature of each statistic of each row."""
        return np.stack([BUCKETS + k * BINS + np.searchsorted(self.edges[k], stats[:, k]) for k in range(stats.shape[1])], axis=1)

    def flat(self, rows, which, value, stats) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Features and values by row, with the first of each row and how many."""
        own = self.indicators(stats)
        n, k = own.shape
        rows, which = np.concatenate([rows, np.repeat(np.arange(n), k)]), np.concatenate([which, own.ravel()])
        value = np.concatenate([value, np.full(n * k, k**-0.5)])
        order = np.argsort(rows, kind="stable")
        lens = np.bincount(rows, minlength=n)
        return which[order], value[order], np.cumsum(lens) - lens, lens

    def logits(self, which, value, starts) -> tuple[np.ndarray, np.ndarray]:
        if not len(starts):
            return np.zeros(0), np.zeros((0, FACTORS))
        part = self.factors[which] * value[:, None]
        sums = np.add.reduceat(part, starts, axis=0)
        squares = np.add.reduceat((part * part).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.linear[which] * value, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, texts: pa.Array) -> np.ndarray:
        which, value, starts, _ = self.flat(*features(texts))
        return sigmoid(self.logits(which, value, starts)[0])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows, which, value, stats, label: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.15, decay: float = 1e-5, seed: int = 5) -> Machine:
    """A machine by AdaGrad on the logistic loss; the order of the rows sets the batches."""
    rng = np.random.default_rng(seed)
    share = float(label.mean()) if len(label) else 0.5
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(label) else np.zeros((9, BINS - 1))
    width = BUCKETS + edges.shape[0] * BINS
    m = Machine(float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))), np.zeros(width), np.zeros((width, FACTORS)), edges)
    if not len(label) or share in (0.0, 1.0):
        m.bias = float(np.clip(m.bias, -30, 30))
        return m
    m.factors = rng.normal(0, 0.05, (width, FACTORS))
    which, value, starts, lens = m.flat(rows, which, value, stats)
    seen_w, seen_v, seen_b = np.full(width, 1e-6), np.full((width, FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            n = lens[own]
            first = np.cumsum(n) - n
            pick = np.arange(int(n.sum())) + np.repeat(starts[own] - first, n)
            f, x, of = which[pick], value[pick], np.repeat(np.arange(len(own)), n)
            logit, sums = m.logits(f, x, first)
            g = sigmoid(logit) - label[own]
            used, at_f = np.unique(f, return_inverse=True)
            gx = g[of] * x
            gw = np.bincount(at_f, gx, len(used)) + decay * m.linear[used]
            part = gx[:, None] * (sums[of] - m.factors[f] * x[:, None])
            gv = np.stack([np.bincount(at_f, part[:, k], len(used)) for k in range(FACTORS)], axis=1) + decay * m.factors[used]
            seen_w[used] += gw**2
            seen_v[used] += gv**2
            seen_b += g.sum() ** 2
            m.linear[used] -= rate * gw / np.sqrt(seen_w[used])
            m.factors[used] -= 0.3 * rate * gv / np.sqrt(seen_v[used])
            m.bias -= 0.3 * rate * g.sum() / np.sqrt(seen_b)
    return m


FEATURES = "_id string, label double, which array<int>, value array<float>, stats array<double>"


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: tuple[int, int, bool] = (5, 0, False), most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """The machine of a bounded sample of the labelled rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    rows = labelled(docs, sample(labels, label, most, fold, id_col), id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            for a, b in slices(texts):
                row, which, value, stats = features(texts.slice(a, b - a))
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))]), pa.int32())
                cells = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * stats.shape[1], pa.int32()), pa.array(stats.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.ListArray.from_arrays(ends, pa.array(which, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(value, pa.float32())), cells], ["_id", "label", "which", "value", "stats"])

    got = rows.selectExpr("cast(_id as string) AS _id", "text", "_label").mapInArrow(run, FEATURES).toArrow().sort_by([("_id", "ascending")])
    lists = got.combine_chunks()
    which, value, stats = (lists.column(c).combine_chunks() for c in ("which", "value", "stats"))
    row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(which), dtype=np.int64))
    table = np.asarray(stats.flatten()).reshape(len(lists), -1) if len(lists) else np.zeros((0, 9))
    return fit(row, np.asarray(which.flatten()).astype(np.int64), np.asarray(value.flatten()).astype(float), table, np.asarray(lists.column("label"), dtype=float))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` of each document, 0 to 1."""
    small_batches(docs.sparkSession)
    source = docs.select(col(id_col), col(text_col).cast("string").alias("_text"))
    shared = source.sparkSession.sparkContext.broadcast(machine)  # BUCKETS * (FACTORS + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(shared.value.score(texts.slice(a, b - a)))], [id_col, "score"])

    quoted = "`" + id_col.replace("`", "``") + "`"
    return source.mapInArrow(run, f"{quoted} {source.schema[0].dataType.simpleString()}, score double")
