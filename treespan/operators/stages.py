"""Stages that grow trees from text, fused into one pass a document.

A stage turns one node into nodes. Its edges then route each of them, in the order in which they
were added:

    to(stage)        the node is replaced by the stage's output, which is final
    then(stage)      the node is replaced by the stage's output, which goes on to the next edges
    children(stage)  the output goes below the node (``how``: add, nest, replace or delete)
    aside(stage)     the stage runs and its output is dropped

An edge takes the nodes that its ``where`` accepts: a label, None (no label) or a function; all
others go on to the next edge. ``after`` sets a function of the whole sequence that a stage made
of one node. A stage may be its own target.

``segment`` runs a graph over a table of documents: text goes to a Python worker once, in Arrow
batches, and rows of segments come back with their ranks; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Union

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import NODE_FIELDS, SEGMENTS, SegmentError, nested
from ..plans.forest import Forest, Trees, dealt, forest_of_batch, small_batches

ANY = ...  # an edge that takes every node; a singleton that pickling keeps
Label = Union[str, None, Callable]


class Node:
    """A span of a text with a label, a value and children in order."""

    __slots__ = ("start", "stop", "label", "value", "kids")

    def __init__(self, start: int, stop: int, label: str | None = None, value=None, kids: Iterable[Node] = ()):
        self.start, self.stop, self.label, self.value, self.kids = start, stop, label, value, list(kids)

    def copy(self, start: int | None = None, stop: int | None = None, label=ANY, kids: bool = True) -> Node:
        return Node(
            self.start if start is None else start, self.stop if stop is None else stop, self.label if label is ANY else label,
            self.value, [k.copy() for k in self.kids] if kids else (),
        )

    def span(self) -> tuple[int, int]:
        return self.start, self.stop

    def add(self, nodes: Iterable[Node]) -> None:
        """Children that overlap no other."""
        for n in nodes:
            at = len(self.kids)
            while at and self.kids[at - 1].start > n.start:
                at -= 1
            before, after = self.kids[at - 1] if at else None, self.kids[at] if at < len(self.kids) else None
            if n.start < self.start or n.stop > self.stop:
                raise SegmentError(f"{n.span()} isn't inside {self.span()}")
            if before and (before.stop > n.start or before.start == n.start) or after and after.start < n.stop:
                raise SegmentError(f"{n.span()} overlaps a child of {self.span()}")
            self.kids.insert(at, n)

    def nest(self, nodes: Iterable[Node], key: Callable[[Node], object] | None = None) -> None:
        """Descendants by containment; of equal spans the later, or the one of the larger key, goes inside."""
        all_ = list(walk(self.kids)) + [x for n in nodes for x in walk([n])]
        rows = [(n.start, n.stop, n) for n in (sorted(all_, key=key) if key else all_)]
        placed = list(nested(rows))
        for r in placed:
            r[7].kids = []
        self.kids = []
        for r in placed:
            (self if r[2] is None else placed[r[2]][7]).kids.append(r[7])

    def remove(self, nodes: Iterable[Node]) -> None:
        for n in nodes:
            at = next((i for i, k in enumerate(self.kids) if (k.span(), k.label) == (n.span(), n.label)), None)
            if at is None:
                raise SegmentError(f"{n.span()} isn't a child of {self.span()}")
            del self.kids[at]


def walk(nodes: Iterable[Node]) -> Iterator[Node]:
    """All nodes below, depth first, however deep."""
    stack = [iter(list(nodes))]
    while stack:
        for n in stack[-1]:
            yield n
            stack.append(iter(list(n.kids)))
            break
        else:
            stack.pop()


def covering(nodes: Iterable[Node], label: str | None = None, value=None) -> Node:
    """A childless node over all the spans."""
    some = list(nodes)
    return Node(min(n.start for n in some), max(n.stop for n in some), label, value)


def gaps(start: int, stop: int, spans: Iterable[tuple[int, int]], zero_width: bool = False) -> Iterator[tuple[int, int]]:
    """What ordered spans leave of [start, stop); zero-width gaps only between two spans, if asked for."""
    at, last, first = start, None, True
    for a, b in spans:
        if last is not None and a < last:
            raise SegmentError("the spans aren't in order")
        last = a
        if a > at or (zero_width and not first and a == at):
            yield at, a
        at, first = max(at, b), False
    if at < stop:
        yield at, stop


class Stage:
    """A step of a graph; subclasses give ``made``."""

    def __init__(self):
        self.edges: list[tuple[str, Stage, object]] = []
        self.post: Callable[[str, list[Node]], Iterable[Node]] | None = None

    def made(self, text: str, node: Node) -> Iterable[Node]:
        raise NotImplementedError

    def to(self, stage: Stage, where: object = ANY) -> Stage:
        self.edges.append(("to", stage, where))
        return self

    def then(self, stage: Stage, where: object = ANY) -> Stage:
        self.edges.append(("then", stage, where))
        return self

    def children(self, stage: Stage, where: object = ANY, how: str = "add") -> Stage:
        if how not in ("add", "nest", "replace", "delete"):
            raise ValueError(f"no such way to add children: {how!r}")
        self.edges.append((how, stage, where))
        return self

    def aside(self, stage: Stage, where: object = ANY) -> Stage:
        self.edges.append(("aside", stage, where))
        return self

    def after(self, post: Callable[[str, list[Node]], Iterable[Node]]) -> Stage:
        self.post = post
        return self

    def run(self, text: str, node: Node) -> list[Node]:
        front = [(n, False) for n in self.made(text, node)]
        for how, stage, where in self.edges:
            moved: list[tuple[Node, bool]] = []
            for n, done in front:
                if done or not accepts(where, text, n):
                    moved.append((n, done))
                    continue
                found = stage.run(text, n)
                if how in ("to", "then"):
                    moved += [(x, how == "to") for x in found]
                    continue
                if how == "replace":
                    n.kids = []
                if how in ("add", "replace"):
                    n.add(found)
                elif how == "nest":
                    n.nest(found)
                elif how == "delete":
                    n.remove(found)
                moved.append((n, False))
            front = moved
        out = [n for n, _ in front]
        return list(self.post(text, out)) if self.post else out

    def __call__(self, text: str, start: int | None = None, stop: int | None = None) -> list[Node]:
        """The nodes that the graph makes of a text, or of a part of it."""
        a, b, _ = slice(start, stop).indices(len(text))
        return self.run(text, Node(a, max(a, b)))


def accepts(where: object, text: str, node: Node) -> bool:
    if where is ANY:
        return True
    return bool(where(text, node)) if callable(where) else node.label == where


class Same(Stage):
    """The node itself."""

    def made(self, text, node):
        return [node]


class Relabel(Stage):
    """The node with another label: a text, None or a function of text and node."""

    def __init__(self, label: Label):
        super().__init__()
        self.label = label

    def made(self, text, node):
        node.label = self.label(text, node) if callable(self.label) else self.label
        return [node]


class SetValue(Stage):
    """The node with a value: a function of text and node."""

    def __init__(self, value: Callable[[str, Node], object]):
        super().__init__()
        self.value = value

    def made(self, text, node):
        node.value = self.value(text, node)
        return [node]


class Where(Stage):
    """The node if ``test`` (a label, None or a function) accepts it."""

    def __init__(self, test: object):
        super().__init__()
        self.test = test

    def made(self, text, node):
        return [node] if accepts(self.test, text, node) else []


class Wrap(Stage):
    """What a function of text and node gives; a single node stands for its characters."""

    def __init__(self, function: Callable[[str, Node], Iterable[Node] | Node]):
        super().__init__()
        self.function = function

    def made(self, text, node):
        got = self.function(text, node)
        return characters(got) if isinstance(got, Node) else got


def characters(node: Node) -> list[Node]:
    """A node for each character; a single one stands for itself."""
    return [node] if node.stop - node.start == 1 else [node.copy(i, i + 1, kids=False) for i in range(node.start, node.stop)]


def group_keys(pattern: regex.Pattern) -> list[str | int]:
    """A key for each group, by number: its name if it has one."""
    names = {i: n for n, i in pattern.groupindex.items()}
    return [names.get(i, i) for i in range(pattern.groups + 1)]


def chosen_groups(pattern: regex.Pattern, groups: object) -> list[tuple[int, str]]:
    """Number and label of the groups to keep: all but 0, a list of keys, or what a function of the key accepts (it is tried on the name, then on the number)."""
    keys = group_keys(pattern)
    if groups is None:
        return [(i, str(k)) for i, k in enumerate(keys) if i]
    if callable(groups):
        return [(i, str(k if groups(k) else i)) for i, k in enumerate(keys) if groups(k) or groups(i)]
    out = []
    for k in groups:
        if k not in keys and not (isinstance(k, int) and 0 <= k < len(keys)):
            raise ValueError(f"no group {k!r} in {pattern.pattern!r}")
        out.append((k if isinstance(k, int) else keys.index(k), str(k)))
    if len({i for i, _ in out}) < len(out):
        raise ValueError(f"a group is given twice: {groups!r}")
    return sorted(out)


def forest(spans: Iterable[tuple[int, int, str | None]]) -> list[Node]:
    """Nodes nested by containment, tops first to last."""
    tops: list[Node] = []
    rows = [Node(a, b, label) for a, b, label in spans]
    placed = list(nested([(n.start, n.stop, n) for n in rows]))
    for r in placed:
        (tops if r[2] is None else placed[r[2]][7].kids).append(r[7])
    return tops


class Extract(Stage):
    """Nodes of a pattern's groups, every capture of a repeated group, nested by containment.

    groups: None (all but the whole match), keys, or a function of a key. label: None (the
    group's name, or else its number), a text, or a function of match and key. limit: nodes at
    the top at most.
    """

    def __init__(self, pattern: str | regex.Pattern, limit: int | None = None, label: Label = None, groups: object = None, **named_lists):
        super().__init__()
        self.pattern = regex.compile(pattern, regex.DOTALL, **named_lists) if isinstance(pattern, str) else pattern
        self.groups, self.label, self.limit = chosen_groups(self.pattern, groups), label, limit

    def made(self, text, node):
        left = float("inf") if self.limit is None else self.limit
        for m in self.pattern.finditer(text, node.start, node.stop):
            if left <= 0:
                return
            spans = [(*s, self.labelled(m, k)) for i, k in self.groups for s in m.spans(i)]
            for top in (Node(*spans[0]),) if len(spans) == 1 else forest(spans):
                if left > 0:
                    left -= 1
                    yield top

    def labelled(self, m, key: str) -> str | None:
        if self.label is None:
            return key
        return self.label(m, key) if callable(self.label) else self.label

    def __getstate__(self):
        return self.__dict__ | {"pattern": None, "_source": (self.pattern.pattern, self.pattern.flags, self.pattern.named_lists)}

    def __setstate__(self, state):
        source, flags, lists = state.pop("_source")
        self.__dict__ = state | {"pattern": regex.compile(source, flags, **{k: sorted(v) for k, v in lists.items()})}


class Split(Stage):
    """The pieces between boundaries: matches of a pattern, or the nodes of a stage.

    keep: ``none`` drops the boundaries, ``leading`` makes each the head of the piece after it
    (what is before the first goes), ``trailing`` the tail of the piece before it (what is after
    the last goes), ``all`` keeps them as nodes of their own. Empty pieces go. Without a boundary
    the node itself is given if ``whole``.
    """

    def __init__(self, by: str | regex.Pattern | Stage, limit: int | None = None, keep: str = "none", whole: bool = True, label: str | None = None, **named_lists):
        super().__init__()
        if keep not in ("none", "leading", "trailing", "all"):
            raise ValueError(f"no such way to keep boundaries: {keep!r}")
        self.by = by if isinstance(by, Stage) else Extract(by, label=lambda m, k: None, groups=[0], **named_lists)
        self.limit, self.keep, self.whole, self.label = limit, keep, whole, label

    def made(self, text, node):
        marks = self.by.run(text, node)[: self.limit if self.limit is None else max(0, self.limit)]
        if not marks:
            return [node.copy(label=self.label, kids=False)] if self.whole else []
        piece = lambda a, b: [node.copy(a, b, self.label, kids=False)] if a != b else []
        if self.keep == "leading":
            ends = [m.start for m in marks] + [node.stop]
            return [x for a, b in zip(ends, ends[1:], strict=False) for x in piece(a, b)]
        if self.keep == "trailing":
            ends = [node.start] + [m.stop for m in marks]
            return [x for a, b in zip(ends, ends[1:], strict=False) for x in piece(a, b)]
        out, at = [], node.start
        for m in marks:
            out += piece(at, m.start) + ([m] if self.keep == "all" and m.stop > m.start else [])
            at = m.stop
        return out + piece(at, node.stop)


class Invert(Stage):
    """What a stage leaves of the node; all of it if the stage finds nothing."""

    def __init__(self, stage: Stage | str, label: str | None = None):
        super().__init__()
        self.stage, self.label = stage if isinstance(stage, Stage) else Extract(stage, groups=[0]), label

    def made(self, text, node):
        found = sorted(n.span() for n in self.stage.run(text, node))
        if not found:
            return [node.copy(label=self.label)]
        return [Node(a, b, self.label) for a, b in gaps(node.start, node.stop, found)]


class FirstOf(Stage):
    """The output of the first stage that gives any."""

    def __init__(self, *stages: Stage):
        super().__init__()
        self.stages = stages

    def made(self, text, node):
        return next((found for s in self.stages if (found := s.run(text, node.copy()))), [])


# Sequence operators, for ``after``.


def joined_windows(size: int, accepts_window: Callable[[str, list[Node]], bool], label: str | None = None) -> Callable:
    """Runs of ``size`` nodes that a test accepts become one covering node; a node leads one window only."""
    if size < 2:
        raise ValueError("a window has two nodes at least")

    def run(text: str, nodes: list[Node]) -> Iterator[Node]:
        i = 0
        while i < len(nodes):
            window = nodes[i : i + size]
            if len(window) == size and accepts_window(text, window):
                yield covering(window, label)
                i += size
            else:
                yield nodes[i]
                i += 1

    return run


def reduced_runs(reduce: Callable[[str, list[Node]], Node], begins: Callable[[str, Node], bool], ends: Callable[[str, list[Node], Node], bool] | None = None) -> Callable:
    """Runs of nodes become one: a run begins at a node that ``begins`` accepts and lasts until ``ends``, whose node may begin the next."""

    def run(text: str, nodes: list[Node]) -> Iterator[Node]:
        held: list[Node] = []
        for n in nodes:
            if held and (ends is None or not ends(text, held, n)):
                held.append(n)
                continue
            if held:
                yield reduce(text, held)
                held = []
            if begins(text, n):
                held = [n]
            else:
                yield n
        if held:
            yield reduce(text, held)

    return run


# Running graphs over tables.


def flattened(tops: list[Node], depth: int = 0) -> Iterator[tuple]:
    """Rows pre, last, parent, depth, ord, start, stop, label, value of nodes in depth-first order."""
    rows: list[list] = []
    stack = [(n, None, i, depth) for i, n in enumerate(tops)][::-1]
    while stack:
        n, parent, place, deep = stack.pop()
        pre = len(rows)
        rows.append([pre, pre, parent, deep, place, n.start, n.stop, n.label, n.value])
        if n.kids:
            stack += [(k, pre, i, deep + 1) for i, k in enumerate(n.kids)][::-1]
    for row in reversed(rows):
        up = row[2]
        if up is not None and rows[up][1] < row[1]:
            rows[up][1] = row[1]
    return (tuple(r) for r in rows)


VALUED = T.StructType([*SEGMENTS.fields, T.StructField("value", T.StringType())])
_ARROW = [("doc_id", pa.int64()), *[(c, pa.int32()) for c in NODE_FIELDS], ("label", pa.string()), ("value", pa.string())]
ROWS = 20_000  # of segments in an Arrow batch, at least


def _batch(ids: list, rows: list[tuple], values: bool) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
    data = [pa.array(ids, pa.int64()), *[pa.array(c, k) for c, (_, k) in zip(cols[:8], _ARROW[1:9], strict=True)]]
    if values:
        data.append(pa.array([None if v is None else str(v) for v in cols[8]], pa.string()))
    return pa.RecordBatch.from_arrays(data, [n for n, _ in _ARROW[: len(data)]])


def segment(docs: DataFrame, stage: Stage | Callable[[str], list[Node]], root: str | None = "doc", values: bool = False) -> DataFrame:
    """Segments of every document: a root labelled ``root`` and what the graph makes of it below.

    docs: doc_id, text; a null text is empty. values: a column ``value``, as text. A stream of
    documents gives a stream of segments.
    """
    graph = _graph(stage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (_batch(ids, rows, values) for ids, _, _, rows in _segmented(batches, graph, root))

    return _texts(docs).mapInArrow(run, VALUED if values else SEGMENTS)


def trees(docs: DataFrame, stage: Stage | Callable[[str], list[Node]], root: str | None = "doc") -> Trees:
    """The same trees, to be worked on in the pass that makes them."""
    graph = _graph(stage)

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[Forest]:
        return (forest_of_batch(_batch(ids, rows, False), sizes, texts) for ids, texts, sizes, rows in _segmented(batches, graph, root))

    return Trees(_texts(docs), forests, SEGMENTS, True)


def _graph(stage: Stage | Callable[[str], list[Node]]) -> Callable[[str, Node], list[Node]]:
    return stage.run if isinstance(stage, Stage) else lambda text, _: stage(text)


def _texts(docs: DataFrame) -> DataFrame:
    return small_batches(dealt(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))))


def _segmented(batches: Iterable[pa.RecordBatch], graph: Callable[[str, Node], list[Node]], root: str | None) -> Iterator[tuple[list, list[str], list[int], list[tuple]]]:
    """For some documents at a time: the ids by row, the texts and the numbers of rows by document, and the rows."""
    ids: list = []
    texts: list[str] = []
    sizes: list[int] = []
    rows: list[tuple] = []
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            top = Node(0, len(text), root)
            top.add(graph(text, Node(0, len(text))))
            own = list(flattened([top]))
            rows += own
            ids += [doc] * len(own)
            texts.append(text)
            sizes.append(len(own))
            if len(rows) >= ROWS:
                yield ids, texts, sizes, rows
                ids, texts, sizes, rows = [], [], [], []
    if rows:
        yield ids, texts, sizes, rows


def extracted(docs: DataFrame, stage: Stage) -> DataFrame:
    """The same without roots: the nodes that a graph makes of each document, as a forest."""
    out = segment(docs, stage).where("pre > 0")
    down = [(F.col(c) - 1).alias(c) for c in ("pre", "last")]
    parent = F.when(F.col("parent") > 0, F.col("parent") - 1).alias("parent")
    return out.select("doc_id", *down, parent, (F.col("depth") - 1).alias("depth"), "ord", "start", "stop", "label")


def grow(segments: DataFrame, docs: DataFrame, stage: Stage, where: object = ANY, how: str = "add") -> DataFrame:
    """Trees with what a graph makes of each node that ``where`` accepts below it; one shuffle on doc_id."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        text = (right.column("text")[0].as_py() if right.num_rows else None) or ""
        rows = sorted(left.to_pylist(), key=lambda r: r["pre"])
        nodes = {r["pre"]: Node(r["start"], r["stop"], r["label"]) for r in rows}
        for r in rows:
            if r["parent"] is not None:
                nodes[r["parent"]].kids.append(nodes[r["pre"]])
        for n in list(nodes.values()):
            if accepts(where, text, n):
                found = stage.run(text, n.copy(kids=False))
                {"add": n.add, "nest": n.nest}[how](found)
        flat = list(flattened([nodes[r["pre"]] for r in rows if r["parent"] is None]))
        return pa.Table.from_batches([_batch([key[0].as_py()] * len(flat), flat, False)])

    own = segments.select(*SEGMENTS.names)
    return own.groupBy("doc_id").cogroup(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").groupBy("doc_id")).applyInArrow(run, SEGMENTS)
