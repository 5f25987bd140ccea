"""Operations on tables of segments (see ``model``): natively, by windows and aggregates over doc_id, or on ``Trees``, inside documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.forest import Forest, Trees, complements, offsets, trees_of


def sub_segment(df: DataFrame, start: int | None = None, stop: int | None = None, label: str | None = None) -> DataFrame:
    """Each segment cut like a slice of its substring: negative ends count from its end; childless."""
    from ..model import normalize_span

    lit = lambda x: None if x is None else F.lit(x)
    a, b = normalize_span(F.col("stop") - F.col("start"), lit(start), lit(stop))
    out = df.withColumns({"_a": a, "_b": b}).withColumns({"stop": F.col("start") + F.col("_b"), "start": F.col("start") + F.col("_a")})
    return (out if label is None else out.withColumn("label", F.lit(label))).drop("_a", "_b")


def characters(df: DataFrame) -> DataFrame:
    """doc_id, start, stop, label: a row for each character of each segment."""
    places = F.when(F.col("stop") > F.col("start"), F.sequence("start", F.col("stop") - 1)).otherwise(F.array().cast("array<int>"))
    return df.select("doc_id", F.explode(places).alias("start"), "label").select("doc_id", "start", (F.col("start") + 1).alias("stop"), "label")


def gaps(spans: DataFrame, bounds: DataFrame, label: str | None = None, keys: tuple[str, ...] = ("doc_id",), zero_width: bool = False) -> DataFrame:
    """What ``spans`` (keys, start, stop) leave of ``bounds`` (the same columns, one row a key).

    The complement is true: nested and overlapping spans count by the furthest stop so far.
    Zero-width gaps are given between two spans that touch, if asked for.
    """
    key = list(keys)
    # The bounds are a last row of each key, so one window over both tells every gap.
    none = F.lit(None).cast("int")
    own = spans.select(*key, F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), none.alias("_from"), F.lit(0).alias("_end"))
    ends = bounds.select(*key, F.col("stop").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), F.col("start").cast("int").alias("_from"), F.lit(1).alias("_end"))
    w = Window.partitionBy(*key).orderBy("_end", "start", "stop")
    rows = own.unionByName(ends).withColumn("_from", F.max("_from").over(Window.partitionBy(*key))).where("_from IS NOT NULL")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_at", F.coalesce(before, F.col("_from"))).withColumn("_first", F.row_number().over(w) == 1)
    touching = F.lit(zero_width) & (F.col("_end") == 0) & ~F.col("_first") & (F.col("start") == F.col("_at"))
    return rows.where((F.col("start") > F.col("_at")) | touching).select(*key, F.col("_at").alias("start"), F.col("start").alias("stop"), F.lit(label).cast("string").alias("label"))


def split_pieces(marks: DataFrame, bounds: DataFrame, keep: str = "none", label: str | None = None, mark_label: str | None = None, whole: bool = True, limit: int | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The pieces of ``bounds`` between ordered boundaries ``marks``, which may be dropped (``none``), lead or trail a piece, or be pieces (``all``)."""
    if keep not in ("none", "leading", "trailing", "all"):
        raise ValueError(f"no such way to keep boundaries: {keep!r}")
    key = list(keys)
    by = Window.partitionBy(*key).orderBy("start", "stop")
    m = marks.select(*key, "start", "stop")
    if limit is not None:
        m = m.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= limit).drop("_n")
    m = m.join(bounds.select(*key, F.col("start").alias("_from"), F.col("stop").alias("_to")), key)
    m = m.withColumn("_prev", F.lag("stop").over(by)).withColumn("_next", F.lead("start").over(by))
    if keep == "leading":
        pieces = m.select(*key, "start", F.coalesce("_next", "_to").alias("stop"))
    elif keep == "trailing":
        pieces = m.select(*key, F.coalesce("_prev", "_from").alias("start"), "stop")
    else:
        last = m.where("_next IS NULL").select(*key, F.col("stop").alias("start"), F.col("_to").alias("stop"))
        pieces = m.select(*key, F.coalesce("_prev", "_from").alias("start"), F.col("start").alias("stop")).unionByName(last)
    out = pieces.where("start <> stop").withColumn("label", F.lit(label).cast("string"))
    if keep == "all":
        out = out.unionByName(m.where("start < stop").select(*key, "start", "stop", F.lit(mark_label).cast("string").alias("label")))
    if whole:
        out = out.unionByName(bounds.join(m.select(*key).distinct(), key, "left_anti").select(*key, "start", "stop", F.lit(label).cast("string").alias("label")))
    return out


def covering(df: DataFrame, keys: tuple[str, ...] = ("doc_id",), label: str | None = None) -> DataFrame:
    """One childless segment over all those of a key."""
    return df.groupBy(*keys).agg(F.min("start").alias("start"), F.max("stop").alias("stop")).withColumn("label", F.lit(label).cast("string"))


def adopt(spans: DataFrame, label: str | None = None, on_overlap: str = "raise") -> DataFrame:
    """Trees: a root over the spans (doc_id, start, stop, label) of each document, which are nested below it; equal rows count once."""
    from ..model import nest

    some = spans.select("doc_id", "start", "stop", "label").distinct()
    top = covering(some, label=label).select("doc_id", "start", "stop", "label", F.lit(-1).alias("emit_no"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", F.desc("stop"), "label")) - 1
    return nest(top.unionByName(some.withColumn("emit_no", rank)), on_overlap)


def strip_to_children(segments: DataFrame | Trees) -> DataFrame:
    """Each segment shrunk to what its children cover; leaves stay."""
    trees = trees_of(segments)
    columns = trees.schema.names

    def run(f: Forest) -> Iterator[pa.RecordBatch]:
        kids, up = _by_parent(f)
        start, stop = f.start.copy(), f.stop.copy()
        if len(kids):
            first = np.flatnonzero(np.diff(up, prepend=-1))
            start[up[first]], stop[up[first]] = np.minimum.reduceat(f.start[kids], first), np.maximum.reduceat(f.stop[kids], first)
        return f.rows(columns, np.arange(len(f)), {"start": start, "stop": stop})

    return trees.each(run, trees.schema)


def _by_parent(f: Forest) -> tuple[np.ndarray, np.ndarray]:
    """The nodes whose parents are there, by parent and ``ord``, and their parents."""
    kids = f.siblings[0]
    up = f.up[kids]
    return kids[up >= 0], up[up >= 0]


def _spans(trees: Trees, *more: str) -> T.StructType:
    """doc_id, other columns, start, stop, label."""
    return T.StructType([*(trees.schema[c] for c in ("doc_id", *more)), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("label", T.StringType())])


def _labels(label: str | None, n: int) -> pa.Array:
    return pa.array([label] * n, pa.string())


def invert_children(segments: DataFrame | Trees, label: str | None = None) -> DataFrame:
    """doc_id, pre, start, stop, label: what the children of each segment leave of it; a leaf, all of it."""
    trees = trees_of(segments)

    def run(f: Forest) -> Iterator[pa.RecordBatch]:
        kids, up = _by_parent(f)
        of, start, stop = complements(up, f.start[kids], f.stop[kids], f.start, f.stop)
        return f.rows(["doc_id", "pre"], of, {"start": start, "stop": stop, "label": _labels(label, len(of))})

    return trees.each(run, _spans(trees, "pre"))


def gaps_in_documents(trees: DataFrame | Trees, of: str, label: str | None = None) -> DataFrame:
    """doc_id, start, stop, label: ``gaps`` that the nodes labelled ``of`` leave of their document's root."""
    trees = trees_of(trees)

    def run(f: Forest) -> Iterator[pa.RecordBatch]:
        some, tops = np.flatnonzero(f.is_label(of)), f.begin[:-1]
        at, start, stop = complements(f.doc[some], f.start[some], f.stop[some], f.start[tops], f.stop[tops])
        keep = f.pre[tops[at]] == 0
        return f.rows(["doc_id"], tops[at[keep]], {"start": start[keep], "stop": stop[keep], "label": _labels(label, int(keep.sum()))})

    return trees.each(run, _spans(trees))


def joined_windows_in_documents(trees: DataFrame | Trees, of: str, size: int, label: str | None = None) -> DataFrame:
    """doc_id, start, stop, label: ``joined_windows`` of the nodes labelled ``of`` of each document."""
    if size < 2:
        raise ValueError("a window has two rows at least")
    trees = trees_of(trees)

    def run(f: Forest) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(f.is_label(of))
        if not len(at):
            return iter(())
        at = at[np.lexsort((f.start[at], f.doc[at]))]
        k, n = offsets(f.doc[at]), np.bincount(f.doc[at], minlength=len(f.ids))[f.doc[at]]
        full = (k // size + 1) * size <= n
        first = np.flatnonzero(~full | (k % size == 0))
        stop = np.maximum.reduceat(f.stop[at], first)
        labels = pa.array(np.where(full[first], 0, 1)).cast(pa.int8())
        return f.rows(["doc_id"], at[first], {"start": f.start[at[first]], "stop": stop, "label": pa.DictionaryArray.from_arrays(labels, pa.array([label, of], pa.string())).dictionary_decode()})

    return trees.each(run, _spans(trees))


def first_of(keys: tuple[str, ...], *options: DataFrame) -> DataFrame:
    """For each key, the rows of the first option that has any."""
    rows = None
    for i, df in enumerate(options):
        own = df.withColumn("_option", F.lit(i))
        rows = own if rows is None else rows.unionByName(own)
    least = F.min("_option").over(Window.partitionBy(*keys))
    return rows.withColumn("_least", least).where("_option = _least").drop("_option", "_least")


def joined_windows(rows: DataFrame, size: int, keys: tuple[str, ...] = ("doc_id",), label: str | None = None) -> DataFrame:
    """Runs of ``size`` rows become one covering row; the rows left at the end stay. The native case of windows that are all accepted."""
    if size < 2:
        raise ValueError("a window has two rows at least")
    by = Window.partitionBy(*keys).orderBy("start")
    n = F.count("*").over(Window.partitionBy(*keys))
    at = F.row_number().over(by) - 1
    numbered = rows.withColumn("_at", at).withColumn("_full", (F.floor(F.col("_at") / size) + 1) * size <= n)
    numbered = numbered.withColumn("_run", F.when(F.col("_full"), F.floor(F.col("_at") / size)).otherwise(F.col("_at") + n))
    out = numbered.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("label").alias("_label"), F.first("_full").alias("_full"))
    return out.select(*keys, "start", "stop", F.when(F.col("_full"), F.lit(label).cast("string")).otherwise(F.col("_label")).alias("label"))


def reduced_runs(rows: DataFrame, begins: Column, ends: Column | None = None, keys: tuple[str, ...] = ("doc_id",), label: str | None = None) -> DataFrame:
    """Runs of rows become one covering row, by conditions on single rows.

    A run begins at a row that ``begins`` accepts outside of a run and lasts until a row that
    ``ends`` accepts, which may begin the next; without ``ends`` it lasts to the end. Rows outside
    of runs stay. Gaps and islands: a run's start is the first ``begins`` since the last ``ends``.
    """
    by = Window.partitionBy(*keys).orderBy("start")
    yes = lambda c: F.coalesce(c, F.lit(False))
    # An ending row that doesn't begin a run closes the stretch; the row that begins first in a stretch starts a run, and so does an ending row that begins one.
    out = rows.withColumn("_begins", yes(begins)).withColumn("_ends", yes(ends) if ends is not None else F.lit(False))
    out = out.withColumn("_stretch", F.sum(F.col("_ends").cast("int")).over(by))
    within = Window.partitionBy(*keys, "_stretch").orderBy("start")
    started = F.max(F.col("_begins").cast("int")).over(within.rowsBetween(Window.unboundedPreceding, 0)) == 1
    out = out.withColumn("_in", started).withColumn("_at", F.row_number().over(by))
    out = out.withColumn("_run", F.when(F.col("_in"), F.col("_stretch")).otherwise(-F.col("_at")))
    done = out.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("label").alias("_label"), F.first("_in").alias("_in"))
    return done.select(*keys, "start", "stop", F.when(F.col("_in"), F.lit(label).cast("string")).otherwise(F.col("_label")).alias("label"))


def canonical_paths(segments: DataFrame | Trees) -> DataFrame:
    """doc_id, pre, path: from the root, "." for it and ``/*[i:k]`` for each step down, k the place among siblings."""
    trees = trees_of(segments)

    def run(f: Forest) -> Iterator[pa.RecordBatch]:
        paths: list[str] = []
        for up, depth, place in zip(f.above.tolist(), f.depth.tolist(), f.ord.tolist(), strict=True):
            own = f"*[i:{place}]" if depth else "."
            paths.append(own if up < 0 else f"{paths[up]}/{own}")
        return f.rows(["doc_id", "pre"], np.arange(len(f)), {"path": pa.array(paths, pa.string())})

    return trees.each(run, T.StructType([trees.schema["doc_id"], trees.schema["pre"], T.StructField("path", T.StringType())]))


def descends_from(pre: Column, ancestor_pre: Column, ancestor_last: Column) -> Column:
    return (ancestor_pre < pre) & (pre <= ancestor_last)


def value_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Segments of two tables with equal substrings (columns ``substring``), an equi-join; right columns get the suffix _r."""
    other = right.select(*[F.col(c).alias(c if c in keys or c == "substring" else f"{c}_r") for c in right.columns])
    return left.join(other, [*keys, "substring"])


def without(segments: DataFrame, gone: DataFrame) -> DataFrame:
    """Trees without the segments ``gone`` (doc_id, pre) and all below them; ranks are made anew."""
    g = gone.select("doc_id", "pre").distinct().join(segments.select("doc_id", "pre", "last"), ["doc_id", "pre"]).select(F.col("doc_id").alias("_d"), F.col("pre").alias("_a"), F.col("last").alias("_b"))
    rest = segments.join(g, (F.col("doc_id") == F.col("_d")) & (F.col("pre") >= F.col("_a")) & (F.col("pre") <= F.col("_b")), "left_anti")
    return ranked(rest)


def ranked(segments: DataFrame) -> DataFrame:
    """Ranks without holes, of rows whose order and parents are right."""
    new = rest = segments.withColumn("_new", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")) - 1)
    up = rest.select("doc_id", F.col("pre").alias("parent"), F.col("_new").alias("_parent"))
    new = rest.join(up, ["doc_id", "parent"], "left").withColumn("_ord", F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("pre")) - 1)
    low = new.alias("a").join(new.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("b.pre") >= F.col("a.pre")) & (F.col("b.pre") <= F.col("a.last")))
    last = low.groupBy(F.col("a.doc_id").alias("doc_id"), F.col("a.pre").alias("pre")).agg(F.max("b._new").alias("_last"))
    out = new.join(last, ["doc_id", "pre"])
    own = {"pre": "_new", "last": "_last", "parent": "_parent", "ord": "_ord"}
    return out.select(*[F.col(own[c]).cast("int").alias(c) if c in own else F.col(c) for c in segments.columns])


def label_statistics(segments: DataFrame) -> DataFrame:
    """Counts and lengths by document and label, by document, and over all: a rollup."""
    return segments.rollup("doc_id", "label").agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("chars"), F.grouping_id().alias("level"))
