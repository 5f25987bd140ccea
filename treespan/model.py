"""The data model: documents and, as rows, the segments of their trees.

``docs``: doc_id, text. ``segments``: a row a node, keyed by (doc_id, pre). ``pre`` is the rank in
depth-first order (0: the root), ``last`` the largest ``pre`` below the node (its own: a leaf),
``parent`` the parent's ``pre``, ``ord`` the place among its siblings, [``start``, ``stop``) code
points of the document's text, which is stored once, in ``docs``. Every axis of the path language
is then an equi-join on doc_id with a range on these numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_FIELDS = ("pre", "last", "parent", "depth", "ord", "start", "stop")
SEGMENTS = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in NODE_FIELDS], T.StructField("label", T.StringType())])


class SegmentError(ValueError):
    """A tree or span that the model doesn't allow."""


@dataclass(frozen=True, order=True)
class Span:
    """A half-open range of code points."""

    start: int
    stop: int

    @classmethod
    def clamped(cls, length: int, start: int | None = None, stop: int | None = None) -> Span:
        """The span that slicing a text of ``length`` would give; never with stop before start."""
        a, b, _ = slice(start, stop).indices(length)
        return cls(a, max(a, b))

    def moved(self, by: int) -> Span:
        if self.start + by < 0:
            raise SegmentError(f"{self} moved by {by} begins before the text")
        return Span(self.start + by, self.stop + by)

    def __len__(self) -> int:
        return self.stop - self.start


def normalize_span(length: Column, start: Column | None = None, stop: Column | None = None) -> tuple[Column, Column]:
    """The same as columns: negative ends count from the end, both are clamped, null is the default end."""
    zero = F.lit(0)

    def end(x: Column | None, default: Column) -> Column:
        if x is None:
            return default
        return F.coalesce(F.least(F.greatest(F.when(x < 0, x + length).otherwise(x), zero), length), default)

    a = end(start, zero)
    return a, F.greatest(a, end(stop, length))


BLOCK = 512  # characters


def roots(docs: DataFrame, label: str | None = "doc") -> DataFrame:
    """One root segment a document."""
    zero = F.lit(0)
    return docs.select("doc_id", zero.alias("pre"), zero.alias("last"), F.lit(None).cast("int").alias("parent"), zero.alias("depth"), zero.alias("ord"), zero.alias("start"), F.length("text").alias("stop"), F.lit(label).cast("string").alias("label"))


def with_text(segments: DataFrame, docs: DataFrame, name: str = "substring") -> DataFrame:
    """``segments`` with their substrings; the text is joined as late as this, and isn't returned."""
    out = segments.join(docs.select("doc_id", blocks(F.col("text")).alias("_text")), "doc_id")
    return out.withColumn(name, cut(F.col("_text"), F.col("start"), F.col("stop"))).drop("_text")


def blocks(text: Column) -> Column:
    """A text as blocks of BLOCK characters, so that a span is cut out without a walk from the text's start."""
    return F.when(text.isNotNull(), F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / BLOCK).cast("int")), lambda i: F.substring(text, i * BLOCK + 1, F.lit(BLOCK))))


def cut(held: Column, start: Column, stop: Column) -> Column:
    """The characters from ``start`` to ``stop`` of a text held as ``blocks``."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(F.greatest(stop - 1, start) / BLOCK).cast("int")
    near = F.when(first == last, F.get(held, first)).otherwise(F.array_join(F.slice(held, first + 1, last - first + 1), ""))
    return F.substring(near, start - first * BLOCK + 1, stop - start)


def line_word_tree(docs: DataFrame, root: str | None = "doc", line: str | None = "line", word: str | None = "word", line_label: Column | None = None) -> DataFrame:
    """Trees document > lines > words (runs between blanks), in one pass over the texts, without a shuffle.

    A document's rows follow one another in order of ``pre``. line_label: an expression on ``line_text`` that overrides ``line``.
    """
    from .plans.forest import Trees

    return Trees.of_lines(docs, root, line, word, line_label).rows


def nested(spans: Iterable[Sequence], on_overlap: str = "raise") -> Iterator[tuple]:
    """Rows pre, last, parent, depth, ord, start, stop, rest... of (start, stop, rest...) nested by containment.

    Spans are taken by (start, -stop), ties in the order given, so of equal spans the later goes
    inside. Of a partial overlap the later span is refused: ``raise``, or ``drop``.
    """
    rows = sorted(spans, key=lambda s: (s[0], -s[1]))
    out: list[list] = []
    stack: list[int] = []
    kids: list[int] = []
    tops = 0
    for start, stop, *rest in rows:
        while stack and not (start >= out[stack[-1]][5] and stop <= out[stack[-1]][6] and not (start == out[stack[-1]][6] and start > out[stack[-1]][5])):
            top = out[stack[-1]]
            if start < top[6] < stop:
                break
            stack.pop()
        if stack and start < out[stack[-1]][6] < stop:
            if on_overlap == "raise":
                raise SegmentError(f"span ({start}, {stop}) overlaps ({out[stack[-1]][5]}, {out[stack[-1]][6]})")
            continue
        parent = stack[-1] if stack else None
        place = tops if parent is None else kids[parent]
        if parent is None:
            tops += 1
        else:
            kids[parent] += 1
        stack.append(len(out))
        kids.append(0)
        out.append([len(out), len(out), parent, len(stack) - 1, place, start, stop, *rest])
    for row in reversed(out):
        if row[2] is not None:
            out[row[2]][1] = max(out[row[2]][1], row[1])
    return (tuple(r) for r in out)


def nest(spans: DataFrame, on_overlap: str = "raise") -> DataFrame:
    """Segments of (doc_id, start, stop, label[, emit_no]) rows, nested by containment within their document."""
    import pyarrow as pa

    numbered = spans if "emit_no" in spans.columns else spans.withColumn("emit_no", F.lit(0))

    def run(table: pa.Table) -> pa.Table:
        got = sorted(zip(*(table.column(c).to_pylist() for c in ("emit_no", "start", "stop", "label")), strict=True), key=lambda r: r[0])
        rows = list(nested([(a, b, label) for _, a, b, label in got], on_overlap))
        doc = table.column("doc_id")[0].as_py()
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
        return pa.table({"doc_id": pa.array([doc] * len(rows), pa.int64()), **{c: pa.array(cols[i], pa.int32()) for i, c in enumerate(NODE_FIELDS)}, "label": pa.array(cols[7], pa.string())})

    return numbered.select("doc_id", "start", "stop", "label", "emit_no").groupBy("doc_id").applyInArrow(run, SEGMENTS)


def violations(segments: DataFrame) -> DataFrame:
    """Rows (doc_id, pre, problem) that break the model: spans outside the parent's, siblings that overlap or are out of order, wrong ranks."""
    p = segments.select("doc_id", F.col("pre").alias("parent"), F.col("start").alias("ps"), F.col("stop").alias("pe"), F.col("last").alias("pl"))
    by = Window.partitionBy("doc_id", "parent").orderBy("ord")
    rows = segments.withColumn("before", F.lag("stop").over(by)).withColumn("at", F.row_number().over(by) - 1).join(p, ["doc_id", "parent"], "left")
    problem = (
        F.when(F.col("stop") < F.col("start"), "stop before start")
        .when(F.col("parent").isNotNull() & F.col("ps").isNull(), "no such parent")
        .when((F.col("start") < F.col("ps")) | (F.col("stop") > F.col("pe")), "outside its parent")
        .when((F.col("pre") <= F.col("parent")) | (F.col("last") > F.col("pl")), "ranks outside its parent's")
        .when(F.col("before") > F.col("start"), "overlaps its sibling")
        .when(F.col("ord") != F.col("at"), "wrong place among its siblings")
    )
    return rows.select("doc_id", "pre", problem.alias("problem")).where("problem IS NOT NULL")
