"""Trees in bulk: whole documents as arrays, worked on where they are.

A document's tree lies in one place, so what it takes only one document to tell needs no join. ``Trees``
gives a worker the nodes of some documents at a time as a ``Forest``, either made from their texts
(``of_lines``; nothing is shuffled) or from rows (``of_rows``; one shuffle on doc_id, or none if the rows
of a document stand together already). A kernel makes rows of a forest; its memory follows the
largest document, not the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHARS = 1 << 19  # of the texts that are made into one forest, or a document's if it has more
NODES = 1 << 16  # of the rows in flight, about
_DOC = np.int64(1) << 32
INTS = ("pre", "last", "parent", "depth", "ord", "start", "stop")


def offsets(row: np.ndarray) -> np.ndarray:
    """The place of each element in its run of equal ones."""
    at = np.arange(len(row))
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    return at - np.maximum.accumulate(np.where(first, at, 0)) if len(row) else at


def spread(lo: np.ndarray, hi: np.ndarray, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of each range [lo, hi), and the place of the range each belongs to."""
    n = np.maximum(hi - lo, 0)
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, (np.repeat(hi, n) - 1 - step if backward else np.repeat(lo, n) + step)


class Forest:
    """Nodes of whole documents, ordered by document and ``pre``. ``doc`` is a node's place among ``ids``; other pointers are places of nodes, -1 for none."""

    def __init__(self, ids: pa.Array, doc: np.ndarray, begin: np.ndarray, held: dict[str, np.ndarray], labels: tuple[np.ndarray, list], text: str = "", text_at: np.ndarray | None = None, texts: np.ndarray | None = None, table: pa.Table | None = None, sep: int = 0):
        self.ids, self.doc, self.begin, self.held, self.table = ids, doc, begin, held, table
        self.codes, self.names = labels
        # The documents' texts in a row, ``sep`` characters after each, where each begins, and 0: no such document, 1: a null text, 2: a text.
        self.text, self.text_at, self.texts, self.sep = text, text_at, texts, sep

    def __len__(self) -> int:
        return len(self.doc)

    def __getattr__(self, name: str) -> np.ndarray:
        try:
            return self.__dict__["held"][name]
        except KeyError:
            raise AttributeError(name) from None

    def column(self, name: str, at: np.ndarray) -> pa.Array:
        """A column's values for some nodes."""
        if self.table is not None:
            return self.table.column(name).take(pa.array(at)).combine_chunks()
        if name == "doc_id":
            return self.ids.take(pa.array(self.doc[at]))
        if name == "label":
            codes = self.codes[at]
            return pa.DictionaryArray.from_arrays(pa.array(codes, pa.int32(), mask=codes < 0), pa.array(self.names or [""], pa.string())).dictionary_decode()
        values = self.held[name][at]
        return pa.array(values, pa.int32(), mask=values < 0 if name == "parent" else None)

    def rows(self, columns: Sequence[str], at: np.ndarray, more: dict[str, np.ndarray | pa.Array] | None = None) -> Iterator[pa.RecordBatch]:
        """Batches of columns of some nodes, and of other values of theirs, which may stand for a column."""
        more = more or {}
        names = [*columns, *(c for c in more if c not in columns)]
        for a in range(0, len(at), NODES):
            part = at[a : a + NODES]
            own = {c: x[a : a + NODES] for c, x in more.items()}
            data = [(x if isinstance(x := own[c], pa.Array) else pa.array(x, pa.int32())) if c in own else self.column(c, part) for c in names]
            yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in data], names)

    def is_label(self, *labels: str) -> np.ndarray:
        return np.isin(self.codes, [i for i, x in enumerate(self.names) if x in labels])

    def text_of(self, doc: int) -> str | None:
        """A document's text, by its place."""
        a = int(self.text_at[doc])
        b = int(self.text_at[doc + 1]) - self.sep if doc + 1 < len(self.text_at) else len(self.text) - self.sep
        return self.text[a:b] if self.texts[doc] == 2 else None

    def substrings(self, at: np.ndarray) -> list[str]:
        base = self.text_at[self.doc[at]]
        text = self.text
        return [text[a:b] for a, b in zip((base + self.start[at]).tolist(), (base + np.maximum(self.stop, self.start)[at]).tolist(), strict=True)]

    @cached_property
    def key(self) -> np.ndarray:
        return self.doc * _DOC + self.pre

    @cached_property
    def dense(self) -> bool:
        return bool(len(self) == 0 or (self.pre == np.arange(len(self)) - self.begin[self.doc]).all())

    @cached_property
    def until(self) -> np.ndarray:
        """Place of the last node at or below each."""
        return self.begin[self.doc] + self.last if self.dense else np.searchsorted(self.key, self.doc * _DOC + self.last, "right") - 1

    @cached_property
    def up(self) -> np.ndarray:
        """The parent's place."""
        some = self.parent >= 0
        if self.dense:
            return np.where(some & (self.parent < np.diff(self.begin)[self.doc]), self.begin[self.doc] + self.parent, -1)
        want = self.doc * _DOC + self.parent
        at = np.minimum(np.searchsorted(self.key, want), max(len(self) - 1, 0))
        return np.where(some & (self.key[at] == want), at, -1)

    @cached_property
    def above(self) -> np.ndarray:
        """The nearest node around each; the parent, unless parents are missing."""
        if not ((self.parent >= 0) & (self.up < 0)).any():
            return self.up
        out, stack = np.full(len(self), -1), []
        until, doc = self.until.tolist(), self.doc.tolist()
        for i in range(len(self)):
            while stack and (doc[stack[-1]] != doc[i] or until[stack[-1]] < i):
                stack.pop()
            out[i] = stack[-1] if stack else -1
            stack.append(i)
        return out

    @cached_property
    def siblings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes that have a parent, by parent and ``ord``; their parents' keys; the place of each node in that order, -1 for none."""
        some = np.flatnonzero(self.parent >= 0)
        key = self.doc[some] * _DOC + self.parent[some]
        order = np.argsort(key, kind="stable")
        ord_ = self.ord[some][order]
        if ((key[order][1:] == key[order][:-1]) & (ord_[1:] < ord_[:-1])).any():
            order = np.lexsort((self.ord[some], key))
        place = np.full(len(self), -1)
        place[some[order]] = np.arange(len(some))
        return some[order], key[order], place


def line_word_forest(ids: pa.Array, texts: Sequence[str], labels: Sequence[str | None] = ("doc", "line", "word"), line_labels: list | None = None) -> Forest:
    """The forest document > lines > words (runs between blanks) of some texts. line_labels: one for each line, instead of the second label."""
    text = "\n".join([*texts, ""])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(codes == 10)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text_at = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1].astype(np.int64)
    inside = np.zeros(len(codes) + 1, np.int8)
    inside[:-1] = (codes != 10) & (codes != 32)
    turns = np.flatnonzero(np.diff(inside, prepend=0))
    w_start, w_stop = turns[::2], turns[1::2]
    l_start = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    D, L, W = len(texts), len(ends), len(w_start)
    l_doc = np.searchsorted(text_at, l_start, "right") - 1
    w_line = np.searchsorted(ends, w_start)
    n_words = np.bincount(w_line, minlength=L)
    first_line = np.searchsorted(l_doc, np.arange(D))
    first_word = np.cumsum(n_words) - n_words
    w_doc = l_doc[w_line]
    at_line = np.arange(L) + first_word + l_doc + 1
    at_word = np.arange(W) + w_line + w_doc + 2
    at_doc = at_line[first_line] - 1
    total = D + L + W
    begin = np.concatenate([at_doc, [total]]).astype(np.int64)

    def merged(of_doc, of_line, of_word, kind=np.int64) -> np.ndarray:
        out = np.empty(total, kind)
        out[at_doc], out[at_line], out[at_word] = of_doc, of_line, of_word
        return out

    pre_line, pre_word = at_line - begin[l_doc], at_word - begin[w_doc]
    names: list[str] = []

    def code(x: str | None) -> int:
        if x is None:
            return -1
        if x not in names:
            names.append(x)
        return names.index(x)

    held = {
        "pre": merged(0, pre_line, pre_word), "last": merged(np.diff(begin) - 1, pre_line + n_words, pre_word), "parent": merged(-1, 0, pre_line[w_line]), "depth": merged(0, 1, 2),
        "ord": merged(0, np.arange(L) - first_line[l_doc], np.arange(W) - first_word[w_line]), "start": merged(0, l_start - text_at[l_doc], w_start - text_at[w_doc]), "stop": merged(sizes, ends - text_at[l_doc], w_stop - text_at[w_doc]),
    }
    own = code(labels[1]) if line_labels is None else np.fromiter(map(code, line_labels), np.int64, L)
    labels_ = merged(code(labels[0]), own, code(labels[2]), np.int32)
    return Forest(ids, merged(np.arange(D), l_doc, w_doc), begin, held, (labels_, names), text, text_at, np.full(D, 2), sep=1)


def _forests_of_lines(batches: Iterable[pa.RecordBatch], labels: Sequence[str | None]) -> Iterator[Forest]:
    for batch in batches:
        texts, a, size = batch.column(1).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            if i > a and size + len(t) > CHARS:
                yield line_word_forest(batch.column(0).slice(a, i - a), texts[a:i], labels)
                a, size = i, 0
            size += len(t) + 1
        if a < len(texts):
            yield line_word_forest(batch.column(0).slice(a), texts[a:], labels)


def _whole(batches: Iterable[pa.RecordBatch], whole: Callable[[pa.Table], int] | None = None) -> Iterator[pa.Table]:
    """Tables of whole documents of batches in which a document's rows follow one another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("doc_id")
        new = np.flatnonzero(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)) + 1
        if held and held[-1].column("doc_id")[-1].as_py() != ids[0].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if len(new):
            yield pa.Table.from_batches([*held, batch.slice(0, int(new[-1]))])
            held = []
        held.append(batch.slice(int(new[-1]) if len(new) else 0))
    if held:
        yield pa.Table.from_batches(held)


def _ints(table: pa.Table, name: str) -> np.ndarray:
    return pc.fill_null(table.column(name), -1).to_numpy().astype(np.int64)


def _forest_of_rows(table: pa.Table, with_texts: bool) -> Forest | None:
    """The forest of rows; those of a pre of -1 hold the texts."""
    texts = None
    if with_texts:
        head = pc.equal(table.column("pre"), -1)
        texts = table.filter(head)
        texts = dict(zip(texts.column("doc_id").to_pylist(), texts.column("_text").to_pylist(), strict=True))
        table = table.filter(pc.invert(head))
    if not table.num_rows:
        return None
    table = table.combine_chunks()
    ids = table.column("doc_id").chunk(0)
    new = np.ones(len(ids), bool)
    new[1:] = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
    begin = np.append(np.flatnonzero(new), len(ids))
    if not with_texts:
        return _forest(table, begin)
    found = [(texts.get(d), d in texts) for d in ids.take(pa.array(begin[:-1])).to_pylist()]
    return _forest(table, begin, [t or "" for t, _ in found], [0 if not there else 1 if t is None else 2 for t, there in found])


def _forest(table: pa.Table, begin: np.ndarray, texts: Sequence[str] | None = None, known: Sequence[int] | None = None) -> Forest:
    """The forest of a table of documents that begin at these rows."""
    held = {c: _ints(table, c) for c in INTS if c in table.column_names}
    coded = table.column("label").chunk(0).dictionary_encode()
    labels = (pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False), coded.dictionary.to_pylist())
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    out = Forest(table.column("doc_id").chunk(0).take(pa.array(begin[:-1])), doc, begin, held, labels, table=table)
    if texts is not None:
        out.text, out.text_at = "".join(texts), np.cumsum([0, *map(len, texts)])[:-1].astype(np.int64)
        out.texts = np.full(len(texts), 2) if known is None else np.array(known)
    return out


Kernel = Callable[[Forest], Iterator[pa.RecordBatch]]


class Trees:
    """Trees of many documents, a forest at a time. ``rows``: them as a DataFrame, made when asked for."""

    def __init__(self, source: DataFrame, forests: Callable[[Iterable[pa.RecordBatch]], Iterator[Forest]], schema: T.StructType, has_texts: bool):
        self.source, self.forests, self.schema, self.has_texts = source, forests, schema, has_texts

    @classmethod
    def of_lines(cls, docs: DataFrame, root: str | None = "doc", line: str | None = "line", word: str | None = "word", line_label: Column | None = None) -> Trees:
        """Trees document > lines > words of texts (doc_id, text), in one pass without a shuffle. line_label: an expression on ``line_text`` that overrides ``line``."""
        from ..model import SEGMENTS

        id_ = docs.schema["doc_id"]
        schema = T.StructType([T.StructField("doc_id", id_.dataType, id_.nullable), *SEGMENTS.fields[1:]])
        labels = (root, line, word)
        own = dealt(docs.select("doc_id", "text")).where("text IS NOT NULL")
        if line_label is None:
            return cls(own.select("doc_id", "text"), lambda batches: _forests_of_lines(batches, labels), schema, True)

        def by_line(batches: Iterable[pa.RecordBatch]) -> Iterator[Forest]:
            # A document's lines follow one another and begin with number 0.
            for t in _whole(batches):
                first = np.flatnonzero(t.column("lpos").to_numpy() == 0)
                lines = t.column("line_text").to_pylist()
                texts = ["\n".join(lines[a:b]) for a, b in zip(first, [*first[1:], len(lines)], strict=True)]
                ids = t.column("doc_id").combine_chunks()
                ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
                yield line_word_forest(ids.take(pa.array(first)), texts, labels, t.column("line_label").to_pylist())

        exploded = own.select("doc_id", F.posexplode(F.split("text", "\n")).alias("lpos", "line_text"))
        return cls(exploded.select("doc_id", "lpos", "line_text", line_label.cast("string").alias("line_label")), by_line, schema, True)

    @classmethod
    def of_rows(cls, segments: DataFrame, docs: DataFrame | None = None, together: bool = False) -> Trees:
        """Trees of rows, with their texts if ``docs`` are given. together: a document's rows follow one another in order of ``pre`` already."""
        texts = docs is not None
        if texts:
            blank = segments.withColumn("_text", F.lit(None).cast("string"))
            head = docs.select(F.col("doc_id").cast(segments.schema["doc_id"].dataType).alias("doc_id"), F.lit(-1).alias("pre"), F.col("text").alias("_text"))
            rows = blank.unionByName(head, allowMissingColumns=True)
        else:
            rows = segments
        if texts or not together:
            rows = rows.where("doc_id IS NOT NULL").repartition("doc_id").sortWithinPartitions("doc_id", "pre")
        return cls(rows, lambda batches: (f for t in _whole(batches) if (f := _forest_of_rows(t, texts)) is not None), segments.schema, texts)

    def each(self, kernel: Kernel, schema: T.StructType | str, where: str | None = None) -> DataFrame:
        """The rows that a kernel makes of each forest. where: which source rows count."""
        forests = self.forests

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for forest in forests(batches):
                yield from kernel(forest)

        own = small_batches(self.source)
        return (own if where is None else own.where(where)).mapInArrow(run, schema)

    @property
    def rows(self) -> DataFrame:
        columns = self.schema.names
        return self.each(lambda f: f.rows(columns, np.arange(len(f))), self.schema)


def dealt(docs: DataFrame) -> DataFrame:
    """``docs``, dealt out anew if they lie in fewer files than there are cores: a file can be one task, as long as nothing is shuffled."""
    if docs.isStreaming:
        return docs
    spark = docs.sparkSession
    files, cores = len(docs.inputFiles()), spark.sparkContext.defaultParallelism
    return docs.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))) if 0 < files < cores else docs


def small_batches(df: DataFrame, most: int = 4 << 20) -> DataFrame:
    """``df``, in a session whose Arrow batches hold about ``most`` bytes, a row at least, so that workers' memory doesn't follow the rows' width. A smaller limit stays."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > most:
        spark.conf.set(key, str(most))
    return df


def forest_of_batch(batch: pa.RecordBatch, sizes: Sequence[int], texts: Sequence[str]) -> Forest:
    """The forest of segments of documents with so many rows each, and their texts."""
    return _forest(pa.Table.from_batches([batch]), np.cumsum([0, *sizes]), texts)


def trees_of(x: DataFrame | Trees) -> Trees:
    return x if isinstance(x, Trees) else Trees.of_rows(x)


# Kernels.


def complements(group: np.ndarray, starts: np.ndarray, stops: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, start, stop) of what spans leave of [lows, highs) of their group, numbered from 0; spans ordered by group. Nested and overlapping spans count by the furthest stop so far."""
    n = len(lows)
    if ((group[1:] == group[:-1]) & (starts[1:] < starts[:-1])).any():
        order = np.lexsort((stops, starts, group))
        group, starts, stops = group[order], starts[order], stops[order]
    # A group's low end comes before its spans' stops, its high end after their starts.
    at, k = np.arange(len(group)) + group, np.arange(n)
    counts = np.bincount(group, minlength=n)
    low_at = np.cumsum(counts) - counts + k
    since, begins, of = (np.empty(len(group) + n, np.int64) for _ in range(3))
    since[low_at], since[at + 1] = lows, stops
    begins[low_at + counts], begins[at] = highs, starts
    of[low_at], of[at + 1] = k, group
    before = np.maximum.accumulate(since + of * _DOC) - of * _DOC
    gap = begins > before
    return of[gap], before[gap], begins[gap]
