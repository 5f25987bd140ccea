"""The path language: steps of axes, filters and subqueries, compiled to DataFrame plans.

    path   = step ("/" step)*
    step   = ["+" | "-"] axis ["!" | "!!"] [filters] [subqueries]
    axis   = "...." root, "..." ancestors, ".." parent, "." self, "><" distinct, "*" children,
             "**" descendants, "***" leaves, "<<<" preceding, "<<" prior siblings, "<" prior
             sibling, ">" next sibling, ">>" next siblings, ">>>" following
    filter = "[" ["~"] key ":" values "]"; combined by ~ & ^ | (in this precedence) and parentheses
    subquery = "{" path "}", true where the path finds something; combined likewise

"-" reverses the axis (nearest first otherwise), "!" gives the node itself where the axis is empty,
"!!" gives it always. A step keeps what passes its filters and its subqueries. "\\" escapes.

A path is walked inside documents (``walk``), with one shuffle of the segments at most. Joins are left for
predicates that look at what only a step knows, as ``idx``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import with_text
from .forest import Trees

AXES = ("....", "...", "..", ".", "><", "***", "**", "*", "<<<", "<<", "<", ">>>", ">>", ">")
_AXIS = re.compile(r"\s*([+-]?)(><|\.{1,4}|\*{1,3}|<{1,3}|>{1,3})(!{0,2})")
KEYS = {
    "desc": "label", "d": "label", "label": "label",
    "string": "text", "str": "text", "s": "text",
    "str-casefold": "fold", "scf": "fold", "lcs": "fold",
    "str-casefold-ew": "fold-end", "scfew": "fold-end", "lcsew": "fold-end",
    "str-casefold-sw": "fold-start", "scfsw": "fold-start", "lcssw": "fold-start",
    "str-ew": "end", "sew": "end", "str-sw": "start", "ssw": "start",
    "index": "index", "i": "index", "predicate": "predicate", "p": "predicate", "value": "value", "v": "value",
}
SPECIAL = "\\[]/,{}"


class PathError(ValueError):
    """A path that can't be compiled, with the place of the trouble."""


@dataclass(frozen=True)
class Test:
    kind: str
    values: tuple
    negated: bool = False


@dataclass(frozen=True)
class Exists:
    path: Path


@dataclass(frozen=True)
class Not:
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Step:
    axis: str
    reverse: bool
    own: str  # "", "!" or "!!"
    where: object = None
    having: object = None


@dataclass(frozen=True)
class Path:
    steps: tuple[Step, ...]


def escape(text: str) -> str:
    return "".join("\\" + c if c in SPECIAL else c for c in text)


def unescape(text: str) -> str:
    out, i = [], 0
    while i < len(text):
        if text[i] == "\\":
            i += 1
            if i == len(text):
                raise PathError(f"dangling escape at the end of {text!r}")
        out.append(text[i])
        i += 1
    return "".join(out)


def split_unescaped(text: str, at: str) -> list[str]:
    """The parts of ``text`` between unescaped ``at``; their escapes stay."""
    parts, i, begin = [], 0, 0
    while i < len(text):
        if text[i] == "\\":
            i += 2
            continue
        if text[i] == at:
            parts.append(text[begin:i])
            begin = i + 1
        i += 1
    return [*parts, text[begin:]]


def _closing(text: str, i: int, left: str, right: str) -> int:
    depth = 0
    while i < len(text):
        if text[i] == "\\":
            i += 1
        elif text[i] == left:
            depth += 1
        elif text[i] == right:
            depth -= 1
            if not depth:
                return i
        i += 1
    raise PathError(f"unbalanced {left!r} in {text!r}")


def _steps(text: str) -> list[str]:
    parts, depth, i, begin = [], 0, 0, 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth < 0:
                raise PathError(f"unbalanced '}}' in {text!r}")
        elif c == "/" and not depth:
            parts.append(text[begin:i])
            begin = i + 1
        i += 1
    if depth:
        raise PathError(f"unbalanced '{{' in {text!r}")
    return [*parts, text[begin:]]


class _Algebra:
    """A parser of operands, each one bracket, under ~ & ^ | and parentheses."""

    def __init__(self, text: str, left: str, right: str, operand: Callable[[str], object]):
        self.text, self.left, self.right, self.operand, self.i = text, left, right, operand, 0

    def peek(self) -> str:
        while self.i < len(self.text) and self.text[self.i].isspace():
            self.i += 1
        return self.text[self.i] if self.i < len(self.text) else ""

    def all(self) -> object:
        out = self.level(0)
        if c := self.peek():
            raise PathError(f"unbalanced parentheses in {self.text!r}" if c == ")" else f"missing operator before {self.text[self.i:]!r}" if c in (self.left, "(", "~") else f"invalid character {c!r} in {self.text!r}")
        return out

    def level(self, k: int) -> object:
        if k == 3:
            return self.unary()
        out = self.level(k + 1)
        while self.peek() == "|^&"[k]:
            self.i += 1
            out = Binary("|^&"[k], out, self.level(k + 1))
        return out

    def unary(self) -> object:
        c = self.peek()
        if c == "~":
            self.i += 1
            return Not(self.unary())
        if c == "(":
            self.i += 1
            if self.peek() == ")":
                raise PathError(f"empty parentheses in {self.text!r}")
            out = self.level(0)
            if self.peek() != ")":
                raise PathError(f"unbalanced parentheses in {self.text!r}" if not self.peek() else f"missing operator before {self.text[self.i:]!r}")
            self.i += 1
            return out
        if c != self.left:
            raise PathError(f"expected {self.left!r} at {self.text[self.i:]!r} in {self.text!r}")
        end = _closing(self.text, self.i, self.left, self.right)
        inner, self.i = self.text[self.i + 1 : end], end + 1
        return self.operand(inner)


def _ranges(values: list[str]) -> tuple:
    out = []
    for v in values:
        m = re.fullmatch(r"\s*(\d+)\s*(?:(-)\s*(\d*))?\s*", v)
        if not m:
            raise PathError(f"invalid index {v!r}")
        a = int(m[1])
        out.append((a, a + 1) if not m[2] else (a, int(m[3]) if m[3] else None))
    return tuple(out)


def _test(inner: str) -> Test:
    m = re.fullmatch(r"(?s)(\s*~)?\s*([\w-]+)\s*:\s*(.*)", inner)
    if not m:
        raise PathError(f"invalid filter '[{inner}]'")
    if m[2] not in KEYS:
        raise PathError(f"unknown filter key {m[2]!r}")
    kind, values = KEYS[m[2]], [unescape(v) for v in split_unescaped(m[3], ",")]
    return Test(kind, _ranges(values) if kind == "index" else tuple(values), bool(m[1]))


def _step(text: str) -> Step:
    m = _AXIS.match(text)
    if not m:
        raise PathError(f"no axis at the start of {text!r}")
    rest = text[m.end() :]
    i, cut = 0, len(rest)
    while i < len(rest):
        if rest[i] == "\\":
            i += 1
        elif rest[i] == "[":
            i = _closing(rest, i, "[", "]")
        elif rest[i] == "{":
            cut = i
            break
        i += 1
    if cut < len(rest):
        while cut and rest[cut - 1] in "~&^|() \t\n":
            cut -= 1
        # What closes the filters' parentheses belongs to them.
        while cut < len(rest) and rest[:cut].count("(") > rest[:cut].count(")") and rest[cut] in ") ":
            cut += 1
    where, having = rest[:cut].strip(), rest[cut:].strip()
    if where and having[:1] == "&":
        having = having[1:].strip()
    if where and having[:1] in ("|", "^"):
        raise PathError(f"filters and subqueries combine by '&' only: {text!r}")
    return Step(
        m[2], m[1] == "-", m[3],
        _Algebra(where, "[", "]", _test).all() if where else None,
        _Algebra(having, "{", "}", lambda p: Exists(parse(p))).all() if having else None,
    )


@functools.lru_cache(maxsize=1024)
def parse(path: str) -> Path:
    """The steps of a path; raises PathError."""
    if not path.strip() or not path.isprintable():
        raise PathError(f"empty or unprintable path {path!r}")
    return Path(tuple(_step(s) for s in _steps(path)))


def _tests(node: object):
    if isinstance(node, Test):
        yield node
    elif isinstance(node, Not):
        yield from _tests(node.arg)
    elif isinstance(node, Binary):
        yield from _tests(node.left)
        yield from _tests(node.right)


@dataclass
class Query:
    """A compiled path. ``values``: literals by name; ``predicates``: by name, a Column or a function of the row's columns to a Column."""

    path: Path
    values: Mapping[str, object] = field(default_factory=dict)
    predicates: Mapping[str, Column | Callable[[Mapping[str, Column]], Column]] = field(default_factory=dict)

    def find_all(self, segments: DataFrame | Trees, contexts: DataFrame | None = None, docs: DataFrame | None = None, ordered: bool = True, together: bool = False, columns: list[str] | None = None) -> DataFrame:
        """The nodes that the path finds from each context (default: every root).

        segments: the trees. contexts: rows doc_id, pre. docs: doc_id, text, for filters on
        substrings. Returns the segments' columns (or those named) with ``origin`` (the context's pre) and,
        if ordered, ``pos``, the place of the node in its context's result, which is a bag: a node that is
        found twice is there twice. together: a document's rows follow one another in order of ``pre``,
        as ``line_word_tree`` and ``segment`` give them, so nothing is shuffled.
        """
        return self._found(segments, contexts, docs, ordered, together, columns, False)

    def find(self, segments: DataFrame | Trees, contexts: DataFrame | None = None, docs: DataFrame | None = None, together: bool = False, columns: list[str] | None = None) -> DataFrame:
        """The first node of each context's result."""
        return self._found(segments, contexts, docs, True, together, columns, True).drop("pos")

    def _found(self, segments: DataFrame | Trees, contexts: DataFrame | None, docs: DataFrame | None, ordered: bool, together: bool, columns: list[str] | None, first: bool) -> DataFrame:
        from . import walk

        every = list(self.tests(self.path))
        textual = any(t.kind in walk.TEXTUAL for t in every)
        if isinstance(segments, Trees) and (contexts is not None or any(t.kind in ("value", "predicate") for t in every)):
            segments, together = segments.rows, True
        mark = None
        marks: dict[Test, str] = {}
        if isinstance(segments, Trees):
            trees, names = segments, segments.schema.names
        else:
            if textual and docs is None:
                raise PathError("the path tests substrings, but no documents are given")
            rows, names = segments, segments.columns
            try:
                rows, marks = self.marked(segments, every)
            except _InStep:
                out = Compiler(segments, docs, self.values, self.predicates).run(self.path, contexts, ordered)
                return (out.where("pos = 0") if first else out).select(*(columns or names), "origin", *["pos"] * ordered)
            if contexts is not None:
                mark, together = "_context", False
                rows = rows.join(contexts.select("doc_id", "pre").distinct().withColumn(mark, F.lit(True)), ["doc_id", "pre"], "left")
            trees = Trees.of_rows(rows, docs if textual else None, together)
        wanted = list(columns or names)
        types = trees.schema
        schema = T.StructType([*(types[c] for c in wanted), T.StructField("origin", T.IntegerType()), *[T.StructField("pos", T.IntegerType())] * ordered])
        path = self.path
        return trees.each(lambda forest: walk.found(forest, path, marks, wanted, ordered, first, mark), schema, "doc_id IS NOT NULL")

    @classmethod
    def tests(cls, path: Path):
        for s in path.steps:
            yield from _tests(s.where)
            for e in _exists(s.having):
                yield from cls.tests(e.path)

    def marked(self, segments: DataFrame, tests: list[Test]) -> tuple[DataFrame, dict[Test, str]]:
        """The segments with columns of the outcome of tests on values and predicates, which are columns of Spark's."""
        marks: dict[Test, str] = {}
        rows, compiler = segments, Compiler(segments, None, self.values, self.predicates)
        for t in tests:
            if t.kind not in ("value", "predicate") or t in marks:
                continue
            if t.kind == "predicate" and "idx" in segments.columns:
                raise _InStep
            marks[t] = f"_mark{len(marks)}"
            try:
                rows = rows.withColumn(marks[t], compiler.condition(t))
                rows.schema  # noqa: B018  analysed here
            except AnalysisException as e:
                raise _InStep from e
        return rows, marks


class _InStep(Exception):
    """A predicate that can only be told within a step."""


def compile_path(path: str, values: Mapping[str, object] | None = None, predicates: Mapping[str, object] | None = None) -> Query:
    parsed = parse(path)

    def need(p: Path) -> None:
        for s in p.steps:
            for t in _tests(s.where):
                if t.kind == "value" and values is None:
                    raise PathError("the path tests values, but none are given")
                if t.kind == "predicate" and predicates is None:
                    raise PathError("the path tests predicates, but none are given")
            for e in _exists(s.having):
                need(e.path)

    need(parsed)
    return Query(parsed, values or {}, predicates or {})


def find_all(path: str, segments: DataFrame | Trees, contexts: DataFrame | None = None, docs: DataFrame | None = None, values=None, predicates=None, ordered: bool = True, together: bool = False, columns: list[str] | None = None) -> DataFrame:
    return compile_path(path, values, predicates).find_all(segments, contexts, docs, ordered, together, columns)


def _indexed(step: Step) -> bool:
    """Whether the step's filters can look at a node's place."""
    return any(t.kind in ("index", "predicate") for t in _tests(step.where))


def _exists(node: object):
    if isinstance(node, Exists):
        yield node
    elif isinstance(node, Not):
        yield from _exists(node.arg)
    elif isinstance(node, Binary):
        yield from _exists(node.left)
        yield from _exists(node.right)


class Compiler:
    """Lowers steps to joins on doc_id.

    Rows in flight have the node's columns, ``origin``, and ``key``, an array of the axis ranks so
    far, whose order is the result's; ranks are only computed if something observes them.
    """

    def __init__(self, segments: DataFrame, docs: DataFrame | None, values: Mapping, predicates: Mapping):
        self.docs, self.values, self.predicates = docs, values, predicates
        self.columns = list(segments.columns)
        self.segments = segments

    def run(self, path: Path, contexts: DataFrame | None, ordered: bool) -> DataFrame:
        if contexts is None:
            now = self.segments.where("pre = 0").withColumn("origin", F.col("pre"))
        else:
            now = contexts.select("doc_id", "pre").distinct().join(self.segments, ["doc_id", "pre"]).withColumn("origin", F.col("pre"))
        now = now.withColumn("key", F.array().cast("array<int>"))
        out = self.steps(path, now, ordered)
        if not ordered:
            return out.select(*self.columns, "origin")
        w = Window.partitionBy("doc_id", "origin").orderBy("key")
        return out.withColumn("pos", F.row_number().over(w) - 1).select(*self.columns, "origin", "pos")

    def steps(self, path: Path, now: DataFrame, ordered: bool) -> DataFrame:
        for i, step in enumerate(path.steps):
            # An index counts within a context, so contexts are told apart from here on.
            later = ordered or any(s.axis in (".", "><") or _indexed(s) for s in path.steps[i + 1 :])
            now = self.step(step, now, later)
        return now

    def step(self, step: Step, now: DataFrame, later: bool) -> DataFrame:
        wants_index = _indexed(step)
        whole_stream = step.axis in (".", "><")
        ranked = later or wants_index or whole_stream
        if step.axis == ".":
            out = now.withColumn("rank", F.lit(0))
        elif step.axis == "><":
            same = [c for c in ("start", "stop", "label", "value") if c in self.columns]
            first = F.row_number().over(Window.partitionBy("doc_id", "origin", *same).orderBy("key"))
            out = now.withColumn("nth", first).where("nth = 1").drop("nth").withColumn("rank", F.lit(0))
        else:
            out = self.axis(step, now, ranked)
        if whole_stream and ranked:
            out = out.drop("rank")
            order = F.desc("key") if step.axis == "><" and step.reverse else F.col("key")
            out = out.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id", "origin").orderBy(order)) - 1)
            out = out.withColumn("key", F.array(F.col("idx")))
        elif ranked:
            w = Window.partitionBy("doc_id", "origin", "key").orderBy("rank")
            out = out.withColumn("idx", F.row_number().over(w) - 1).drop("rank")
            if later:
                out = out.withColumn("key", F.concat("key", F.array("idx")))
        else:
            out = out.drop("rank").withColumn("idx", F.lit(0))
        if step.where is not None:
            kinds = {t.kind for t in _tests(step.where)}
            if kinds & {"text", "fold", "fold-end", "fold-start", "end", "start"}:
                if self.docs is None:
                    raise PathError("the path tests substrings, but no documents are given")
                out = with_text(out, self.docs, "_sub")
                if any(k.startswith("fold") for k in kinds):
                    from ..functions.text import casefold

                    out = out.withColumn("_cf", casefold(F.col("_sub")))
            out = out.where(self.condition(step.where))
        if step.having is not None:
            out = self.having(step.having, out)
        return out.select(*self.columns, "origin", "key")

    def axis(self, step: Step, now: DataFrame, ranked: bool) -> DataFrame:
        """Each context row joined with the nodes of the axis, ``rank`` ascending in the axis's order."""
        c, n = now.alias("c"), self.segments.alias("n")
        C, N = (lambda x: F.col(f"c.{x}")), (lambda x: F.col(f"n.{x}"))
        doc = C("doc_id") == N("doc_id")
        near, far = (lambda x: x), (lambda x: -x)
        on, order = {
            "....": ((N("pre") == 0) & (C("pre") != 0), near(N("pre"))),
            "...": ((N("pre") < C("pre")) & (N("last") >= C("pre")), far(N("pre"))),
            "..": (N("pre") == C("parent"), near(N("pre"))),
            "*": (N("parent") == C("pre"), near(N("ord"))),
            "**": ((N("pre") > C("pre")) & (N("pre") <= C("last")), near(N("pre"))),
            "***": ((N("pre") > C("pre")) & (N("pre") <= C("last")) & (N("pre") == N("last")), near(N("pre"))),
            "<<<": (N("last") < C("pre"), far(N("pre"))),
            "<<": ((N("parent") == C("parent")) & (N("ord") < C("ord")), far(N("ord"))),
            "<": ((N("parent") == C("parent")) & (N("ord") == C("ord") - 1), near(N("ord"))),
            ">": ((N("parent") == C("parent")) & (N("ord") == C("ord") + 1), near(N("ord"))),
            ">>": ((N("parent") == C("parent")) & (N("ord") > C("ord")), near(N("ord"))),
            ">>>": (N("pre") > C("last"), near(N("pre"))),
        }[step.axis]
        rank = -order if step.reverse else order
        origin, key = C("origin").alias("origin"), C("key").alias("key")
        found = c.join(n, doc & on).select(*[N(x).alias(x) for x in self.columns], origin, key, rank.cast("int").alias("rank"))
        if step.own == "!!":
            place = F.lit(2**31 - 1 if step.reverse else -(2**31))
            return found.unionByName(now.select(*self.columns, "origin", "key").withColumn("rank", place.cast("int")))
        if step.own == "!":
            none = c.join(n, doc & on, "left_anti").select(*self.columns, "origin", "key").withColumn("rank", F.lit(0))
            return found.unionByName(none)
        return found

    def condition(self, node: object) -> Column:
        if isinstance(node, Not):
            return ~self.condition(node.arg)
        if isinstance(node, Binary):
            a, b = self.condition(node.left), self.condition(node.right)
            return a & b if node.op == "&" else a | b if node.op == "|" else a != b
        sure = lambda x: F.coalesce(x, F.lit(False))  # noqa: E731  null is no match, so that NOT and XOR hold
        any_ = lambda xs: functools.reduce(lambda x, y: x | y, xs, F.lit(False))
        if node.kind == "predicate":
            found = [self.predicates[k] for k in node.values if k in self.predicates]
            row = {x: F.col(x) for x in [*self.columns, "idx"]}
            found = [sure(p(row) if callable(p) and not isinstance(p, Column) else p) for p in found]
            return ~any_(found) if node.negated else functools.reduce(lambda x, y: x & y, found, F.lit(True))
        if node.kind == "label":
            hit = sure(F.col("label").isin(*node.values))
        elif node.kind == "value":
            chosen = [self.values[k] for k in node.values if k in self.values]
            hit = sure(F.col("value").isin(*chosen)) if chosen else F.lit(False)
        elif node.kind == "index":
            hit = any_([(F.col("idx") >= a) & (F.lit(True) if b is None else F.col("idx") < b) for a, b in node.values])
        elif node.kind == "text":
            hit = F.col("_sub").isin(*node.values)
        elif node.kind == "fold":
            hit = F.col("_cf").isin(*[v.casefold() for v in node.values])
        else:
            what, vs = ("_cf", [v.casefold() for v in node.values]) if node.kind.startswith("fold") else ("_sub", node.values)
            test = F.col(what).endswith if node.kind.endswith("end") else F.col(what).startswith
            hit = any_([test(v) for v in vs])
        return ~hit if node.negated else hit

    def having(self, node: object, rows: DataFrame) -> DataFrame:
        """Semi- and anti-joins where they do, marks otherwise."""
        if isinstance(node, Exists):
            return rows.join(self.matches(node, rows), ["doc_id", "pre"], "left_semi")
        if isinstance(node, Not) and isinstance(node.arg, Exists):
            return rows.join(self.matches(node.arg, rows), ["doc_id", "pre"], "left_anti")
        if isinstance(node, Binary) and node.op == "&":
            return self.having(node.right, self.having(node.left, rows))
        marks: dict[Exists, str] = {}
        for e in _exists(node):
            if e not in marks:
                marks[e] = f"_mark{len(marks)}"
                rows = rows.join(self.matches(e, rows).withColumn(marks[e], F.lit(True)), ["doc_id", "pre"], "left")

        def value(x: object) -> Column:
            if isinstance(x, Exists):
                return F.coalesce(F.col(marks[x]), F.lit(False))
            if isinstance(x, Not):
                return ~value(x.arg)
            a, b = value(x.left), value(x.right)
            return a & b if x.op == "&" else a | b if x.op == "|" else a != b

        return rows.where(value(node)).drop(*marks.values())

    def matches(self, node: Exists, rows: DataFrame) -> DataFrame:
        """(doc_id, pre) of the nodes among ``rows`` from which the path finds something."""
        start = rows.dropDuplicates(["doc_id", "pre"]).withColumn("origin", F.col("pre")).withColumn("key", F.array().cast("array<int>"))
        return self.steps(node.path, start.select(*self.columns, "origin", "key"), False).select("doc_id", F.col("origin").alias("pre")).distinct()
