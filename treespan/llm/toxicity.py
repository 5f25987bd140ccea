"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Vectors: (1 + ln count) * idf * (1 + G / LEAN) over all words of the examples; idf = ln((1 + N) / (1 + df)) + 1
with df and N counted over *all* documents, and G the log-likelihood ratio of the word's presence and
the label among the examples (supervised term weighting: no word is left out, a word that tells the
labels apart counts more; plain TF-IDF tells toxic texts apart less well, see the README). The examples are a bounded sample of the labelled rows
outside the held-out fold (``most``, smallest hashes), so their words are bounded too; every worker
holds them as an inverted index. Words of a query that no example has are in no product; in its
length they would scale all its cosines alike, so neighbours and votes are the same without them.

A batch of queries is scored against every example: the HEAVY commonest words by one matrix product
in single precision, the others by their postings. Examples within ROUNDING of the k-th best are
computed again in double precision, so the neighbours are exact. Votes are weighted by cosine; a
document's evidence is its neighbours.

Calibration: the share of label 1 among examples by their own leave-one-out vote, made monotone
(pool adjacent violators) over bins. A document with no word of any example gets the share among
the examples without a word.

Defined results: null text counts as empty; empty texts get the score of texts without a word of
the examples; equal cosines are taken by smaller example number; repeated rows are scored each;
without labels the score is 0 and with labels of one kind it is their share; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, map_arrow, small_batches, written
from .words import PUNCTUATION, coded, counted, labelled, sample, slices

SAMPLE = 12_000  # labelled examples at most
HEAVY, BATCH, POSTINGS, ROUNDING = 128, 32, 200_000, 1e-5
NEAREST, CALIBRATION_BINS = 15, 20
VOTES = 1000  # of a task
LEAN = 10.0  # the G at which a word's weight doubles


def hashed(distinct: list[str]) -> np.ndarray:
    """64-bit hashes of words without the punctuation at their ends, 0 where nothing is left; words go by their hash."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(x) | 1 if (x := w.strip(PUNCTUATION)) else 0 for w in distinct] or [0], np.uint64).view(np.int64)


def words_of(texts: pa.Array, terms: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and count of each distinct word of each text, and the sorted hashes that the words are numbers of: all, or ``terms``, which leaves others out."""
    codes, sizes, distinct = coded(texts)
    h = hashed(distinct)
    if terms is None:
        terms = np.unique(h[h != 0])
    at = np.minimum(np.searchsorted(terms, h), max(0, len(terms) - 1))
    to = np.where(terms[at] == h, at, -1) if len(terms) else np.full(len(h), -1)
    return (*counted(to[codes] if len(codes) else codes, sizes, max(1, len(terms))), terms)


def vocabulary(examples: DataFrame) -> np.ndarray:
    """Hashes of all words of ``examples`` (_id, text, _label), sorted; none if their labels are of one kind."""
    if examples.select((F.col("_label") > 0.5).alias("one")).distinct().count() < 2:
        return np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(0).cast(pa.string()), "")
            for i, j in slices(texts):
                yield pa.RecordBatch.from_arrays([pa.array(words_of(texts.slice(i, j - i))[3], pa.int64())], ["word"])

    return np.sort(np.asarray(examples.select("text").mapInArrow(run, "word bigint").distinct().toArrow().column(0)))


class Sparse:
    """A matrix by rows, held as the counts of its entries: rows of length 1, an entry's weight is (1 + ln count) * idf before that. Weights,
    and the columns as postings, are made where they are first used, so the driver holds a few bytes an entry. The heaviest columns are dense
    too, in single precision."""

    rows: np.ndarray | None = None
    made: np.ndarray | None = None

    def __init__(self, ends: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray):
        """Row i, not empty, has the entries from ends[i] to ends[i + 1]."""
        self.shape, self.ends, self.term, self.count, self.idf = (len(ends) - 1, len(idf)), ends, term, count, idf

    def __getstate__(self) -> tuple:
        return self.ends, self.term, self.count, self.idf

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def __len__(self) -> int:
        return self.shape[0]

    def __matmul__(self, q: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.weight * q[self.term], len(self))

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.ends))

    @property
    def weight(self) -> np.ndarray:
        if self.made is None:
            self.made = np.empty(len(self.term))
            for a in range(0, len(self), VOTES):
                ends = self.ends[a : a + VOTES + 1]
                part, row = slice(ends[0], ends[-1]), np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                weight = (np.log(self.count[part], dtype=float) + 1) * self.idf[self.term[part]]
                self.made[part] = weight / np.sqrt(np.bincount(row, weight**2, len(ends) - 1))[row]
        return self.made

    def index(self) -> None:
        if self.rows is not None:
            return
        n, width = self.shape
        row, weight = self.row, self.weight
        size = np.bincount(self.term, minlength=width)
        heavy = np.argsort(-size, kind="stable")[:HEAVY]
        self.place = np.full(width, -1, np.int32)
        self.place[heavy] = np.arange(len(heavy))
        self.dense = np.zeros((len(heavy), n), np.float32)
        at = self.place[self.term]
        self.dense[at[at >= 0], row[at >= 0]] = weight[at >= 0]
        order = np.argsort(self.term, kind="stable")
        order = order[at[order] < 0]
        self.post_row, self.post_weight = row[order], weight[order]
        self.size = np.where(self.place < 0, size, 0)
        self.start = np.cumsum(self.size) - self.size
        self.rows = self.ends

    def products(self, which: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """n queries (query, term and weight of each entry) x rows, to about ROUNDING."""
        self.index()
        at = self.place[term]
        q = np.zeros((n, len(self.dense)), np.float32)
        q[which[at >= 0], at[at >= 0]] = weight[at >= 0]
        out = (q @ self.dense).astype(float).reshape(-1)
        # Postings of the others, a bounded number at a time: a long query has many.
        ends = np.cumsum(self.size[term])
        a = 0
        while a < len(term):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + POSTINGS, side="right")))
            size = self.size[term[a:b]]
            i = np.repeat(self.start[term[a:b]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            np.add.at(out, np.repeat(which[a:b] * len(self), size) + self.post_row[i], np.repeat(weight[a:b], size) * self.post_weight[i])
            a = b
        return out.reshape(n, len(self))

    def exactly(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The products of some rows with a dense query."""
        self.index()
        size = self.rows[rows + 1] - self.rows[rows]
        i = np.repeat(self.rows[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(np.repeat(np.arange(len(rows)), size), self.weight[i] * q[self.term[i]], len(rows))


@dataclass
class Examples:
    """The index of the labelled examples."""

    terms: np.ndarray  # sorted hashes of the words
    idf: np.ndarray  # what a term's counts are multiplied by
    ids: list
    label: np.ndarray
    matrix: Sparse  # examples x terms, rows of length 1
    bare: float  # the score without a word of the examples
    edges: np.ndarray = field(default=None)
    shares: np.ndarray = field(default=None)

    shared: object = field(default=None)  # a broadcast of the above but the calibration

    def __getstate__(self) -> dict:
        return self.__dict__ | {"shared": None}

    def broadcast(self, spark: SparkSession):
        """A function that gives these examples on a worker; they are sent once."""
        if self.shared is None:
            self.shared = spark.sparkContext.broadcast(self)
        shared, edges, shares = self.shared, self.edges, self.shares

        def own() -> Examples:
            out = shared.value
            out.edges, out.shares = edges, shares
            return out

        return own

    def calibrate(self, spark: SparkSession) -> Examples:
        """Sets ``edges`` and ``shares`` by the examples' leave-one-out votes, which workers count."""
        own, n = self.broadcast(spark), len(self.matrix)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                no = np.asarray(batch.column(0))
                m = own().matrix
                for a in range(0, len(no), BATCH):
                    part = no[a : a + BATCH]
                    ends = m.ends[part[0] : part[-1] + 2]
                    some, row = slice(ends[0], ends[-1]), np.repeat(np.arange(len(part)), np.diff(ends))
                    near = own().all_nearest(row, m.term[some], m.weight[some], len(part), skip=int(part[0]))
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([own().vote(i, s) for i, s in near], pa.float64())], ["no", "vote"])

        got = spark.range(0, n, 1, -(-n // VOTES)).mapInArrow(run, "no bigint, vote double").toArrow().sort_by("no")
        self.edges, self.shares = calibrate(np.asarray(got.column("vote")), self.label)
        return self

    def vectors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and weight of the words of the vocabulary in each text, rows of length 1."""
        rows, which, count, _ = words_of(texts, self.terms)
        weight = (1 + np.log(count)) * (self.idf[which] if len(which) else 0)
        norm = np.sqrt(np.bincount(rows, weight**2, len(texts)))
        return rows, which, weight / norm[rows]

    def all_nearest(self, rows: np.ndarray, which: np.ndarray, weight: np.ndarray, n: int, skip: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers and cosines of the NEAREST examples with positive cosine, exactly, for each of n queries; with ``skip``, the first query's number, each but its own."""
        q = np.zeros(len(self.terms))
        for a in range(0, n, BATCH):
            b = min(a + BATCH, n)
            ends = np.searchsorted(rows, np.arange(a, b + 1))
            part = slice(ends[0], ends[-1])
            near = self.matrix.products(rows[part] - a, which[part], weight[part], b - a)
            if skip is not None:
                near[np.arange(b - a), np.arange(a, b) + skip] = -1
            least = np.partition(near, len(self.matrix) - NEAREST, axis=1)[:, -NEAREST] if len(self.matrix) > NEAREST else np.zeros(b - a)
            for k in range(b - a):
                own = slice(ends[k], ends[k + 1])
                i = np.flatnonzero(near[k] >= max(least[k] - ROUNDING, 0 if least[k] > 2 * ROUNDING else -ROUNDING))
                q[which[own]] = weight[own]
                s = self.matrix.exactly(i, q)
                q[which[own]] = 0
                i, s = i[s > 0], s[s > 0]
                top = np.lexsort((i, -s))[:NEAREST]
                yield i[top], s[top]

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one dense query."""
        used = np.flatnonzero(q)
        return next(self.all_nearest(np.zeros(len(used), np.int64), used, q[used], 1))

    def vote(self, i: np.ndarray, s: np.ndarray) -> float:
        return float((s * self.label[i]).sum() / s.sum()) if len(i) else self.bare

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[list]]:
        n = len(texts)
        scores, evidence = np.full(n, self.bare), [[] for _ in range(n)]
        if not len(self.matrix):
            return scores, evidence
        rows, which, weight = self.vectors(texts)
        some, at = np.unique(rows, return_inverse=True)
        for row, (i, s) in zip(some.tolist(), self.all_nearest(at, which, weight, len(some)), strict=True):
            scores[row] = self.shares[np.searchsorted(self.edges, self.vote(i, s))]
            evidence[row] = [self.ids[x] for x in i]
        return scores, evidence


def calibrate(votes: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper edges of the votes' bins and the share of label 1 in each, not falling."""
    edges = np.unique(np.quantile(votes, np.linspace(0, 1, CALIBRATION_BINS + 1)[1:-1]))
    where = np.searchsorted(edges, votes)
    n = np.bincount(where, minlength=len(edges) + 1).astype(float)
    pools: list[list[float]] = []
    for ones, m in zip(np.bincount(where, label, len(edges) + 1), n, strict=True):
        pools.append([ones, m, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            ones_, m_, k = pools.pop()
            pools[-1] = [pools[-1][0] + ones_, pools[-1][1] + m_, pools[-1][2] + k]
    shares = np.concatenate([np.full(k, ones / m if m else 0.0) for ones, m, k in pools])
    return edges, shares


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: tuple[int, int, bool] = (3, 1, False), most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Examples:
    """The examples' index, with idf over all of ``docs``."""
    small_batches(docs.sparkSession)
    chosen = written(labelled(docs, sample(labels, label, most, fold, id_col), id_col, text_col), "examples")
    every = chosen.select("_id", "_label").toArrow().sort_by("_id")
    ids, label_ = every.column("_id").to_pylist(), np.array(every.column("_label").to_pylist(), float)
    bare_all = float(label_.mean()) if len(label_) else 0.0
    terms = vocabulary(chosen)
    if not len(terms):
        none = np.zeros(0)
        whole = np.zeros(0, np.int32)
        return Examples(terms, none, [], none, Sparse(np.zeros(1, np.int64), whole, whole, none), bare_all)
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # the words of at most ``most`` texts, 8 bytes each

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            for i, j in slices(texts):
                row, to, n, _ = words_of(texts.slice(i, j - i), shared.value)
                ends = pa.array(np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (to, n))], ["_id", "term", "n"])

    kind = chosen.schema["_id"].dataType.simpleString()
    got = chosen.select("_id", "text").mapInArrow(counts, f"_id {kind}, term array<int>, n array<int>").toArrow()  # the distinct words of at most ``most`` texts
    ends, to, n = gathered(got, ids)
    del got
    pa.default_memory_pool().release_unused()
    df, total = document_frequency(docs, shared, text_col)
    size = np.diff(ends)
    idf = (np.log((1 + total) / (1 + df)) + 1) * (1 + told_apart(to, np.repeat(np.arange(len(ids), dtype=np.int32), size), label_, len(terms)) / LEAN)
    some = size > 0
    bare = float(label_[~some].mean()) if (~some).any() else bare_all
    matrix = Sparse(np.concatenate([[0], ends[1:][some]]), to, n, idf)
    own = Examples(terms, idf, [x for x, s in zip(ids, some, strict=True) if s], label_[some], matrix, bare)
    return own.calibrate(docs.sparkSession) if len(matrix) else own


def gathered(got: pa.Table, ids: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of rows in the order of ``ids``, and their terms and counts, the counts in as few bytes as the largest needs; got: _id, term, n."""
    at, size = np.asarray(pc.index_in(got.column("_id"), pa.array(ids))), np.asarray(pc.list_value_length(got.column("term")))
    ends = np.concatenate([[0], np.cumsum(np.bincount(at, size, len(ids)).astype(np.int64))])
    most = max((pc.max(x.flatten()).as_py() or 0 for x in got.column("n").chunks), default=0)
    to, n, place = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.min_scalar_type(most)), ends[:-1].tolist()
    own = zip(at.tolist(), size.tolist(), strict=True)
    for batch in got.to_batches():
        term, count = (np.asarray(batch.column(c).flatten()) for c in ("term", "n"))
        a = 0
        for _ in range(len(batch)):
            i, k = next(own)
            to[place[i] : place[i] + k], n[place[i] : place[i] + k] = term[a : a + k], count[a : a + k]
            place[i], a = place[i] + k, a + k
    return ends, to, n


def told_apart(term: np.ndarray, row: np.ndarray, label: np.ndarray, width: int) -> np.ndarray:
    """G of each term: twice the log-likelihood ratio of its presence (in the examples ``row``) and the label."""
    x = lambda v: v * np.log(np.maximum(v, 1e-300))
    ones, size = np.zeros(width), np.zeros(width)
    for a in range(0, len(term), POSTINGS):  # each call copies what it gets, in 8 bytes a number
        part = slice(a, a + POSTINGS)
        ones += np.bincount(term[part], label[row[part]], width)
        size += np.bincount(term[part], minlength=width)
    most, n = label.sum(), float(len(label))
    table = (ones, size - ones, most - ones, n - most - (size - ones))
    margins = x(size) + x(n - size) + x(most) + x(n - most) - x(n)
    return np.maximum(2 * (sum(x(np.maximum(v, 0.0)) for v in table) - margins), 0.0)


def document_frequency(docs: DataFrame, shared, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each of the terms (a broadcast) occurs, and the number of documents; a task sends the counts that aren't zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, rows = shared.value, 0
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            texts = pc.fill_null(batch.column(0).cast(pa.string()), "")
            for a, b in slices(texts):
                df += np.bincount(words_of(texts.slice(a, b - a), terms)[1], minlength=len(terms))
            rows += len(texts)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], seen]), pa.int32()), pa.array(np.concatenate([[rows], df[seen]]), pa.int64())], ["term", "n"])

    got = docs.select(col(text_col).cast("string").alias("text")).mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = (np.asarray(got.column(c)).astype(np.int64) for c in ("term", "n"))
    df = np.zeros(len(shared.value))
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term < 0].sum())


def score(docs: DataFrame, examples: Examples, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` (0 to 1) and ``evidence`` (ids of the nearest examples, nearest first)."""
    small_batches(docs.sparkSession)
    source = docs.select(col(id_col), col(text_col).cast("string").alias("_text"))
    own = examples.broadcast(docs.sparkSession)  # the words of at most SAMPLE texts
    kind = source.schema[0].dataType.simpleString()
    example_kind = "bigint" if all(isinstance(x, int) for x in examples.ids) else "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            for a, b in slices(texts):
                scores, evidence = own().score(texts.slice(a, b - a))
                lists = pa.array(evidence, pa.list_(pa.int64())) if example_kind == "bigint" else pa.array([[str(x) for x in e] for e in evidence], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores), lists], [id_col, "score", "evidence"])

    quoted = "`" + id_col.replace("`", "``") + "`"
    return source.mapInArrow(run, f"{quoted} {kind}, score double, evidence array<{example_kind}>")


def keep_clean(docs: DataFrame, examples: Examples, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """All columns of the documents whose score is below ``threshold``."""
    small_batches(docs.sparkSession)
    own = examples.broadcast(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(at).cast(pa.string()), "")
            for a, b in slices(texts):
                keep = own().score(texts.slice(a, b - a))[0] < threshold
                yield batch.slice(a, b - a).filter(pa.array(keep))

    return map_arrow(docs, run)
