"""Paths walked inside documents: the steps of ``path`` on the arrays of a ``Forest``, with the same results as its joins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .forest import NODES, Forest, offsets, spread
from .path import Binary, Exists, Not, Path, Step, Test, _indexed, _tests

TEXTUAL = {"text", "fold", "fold-end", "fold-start", "end", "start"}
WHOLE = (".", "><")


@dataclass
class Found:
    """Nodes in the order of the result, with the context (a number) each was found from."""

    origin: np.ndarray
    node: np.ndarray


class Walker:
    """marks: columns that hold the outcome of tests of values and predicates."""

    def __init__(self, forest: Forest, marks: dict[Test, str]):
        self.f, self.marks = forest, marks

    def find(self, path: Path, starts: np.ndarray, ordered: bool) -> Iterator[Found]:
        """What a path finds from each node of ``starts``, whose places are the origins; unless ``ordered``, in several parts."""
        return self.steps(path.steps, Found(np.arange(len(starts)), starts), ordered)

    def steps(self, steps: tuple[Step, ...], now: Found, ordered: bool) -> Iterator[Found]:
        if not steps:
            yield now
            return
        step, rest = steps[0], steps[1:]
        if step.axis in WHOLE or ordered or any(s.axis in WHOLE for s in rest):
            yield from self.steps(rest, self.step(step, now), ordered)
            return
        # Rows that few contexts have many of are made a part at a time.
        upto = np.cumsum(self.most(step.axis, now.node) + 1)
        a = 0
        while a < len(now.node):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + NODES, "right")))
            yield from self.steps(rest, self.step(step, Found(now.origin[a:b], now.node[a:b])), ordered)
            a = b

    def most(self, axis: str, c: np.ndarray) -> np.ndarray:
        """As many nodes as the axis can have."""
        if axis == "...":
            return self.f.depth[c]
        lo, hi, _, _ = self.ranges(axis, c)
        return np.maximum(hi - lo, 0)

    def ranges(self, axis: str, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, bool]:
        """The axis of each node as a range of places, in a list if one is given; whether nearest comes last."""
        f = self.f
        if axis == "....":
            top = f.begin[f.doc[c]]
            return top, np.where((f.pre[top] == 0) & (f.pre[c] != 0), top + 1, top), None, False
        if axis == "..":
            return f.up[c], np.where(f.up[c] < 0, f.up[c], f.up[c] + 1), None, False
        if axis in ("**", "***"):
            return c + 1, f.until[c] + 1, None, False
        if axis == "<<<":
            return f.begin[f.doc[c]], c, None, True
        if axis == ">>>":
            return f.until[c] + 1, f.begin[f.doc[c] + 1], None, False
        order, keys, place = f.siblings
        if axis == "*":
            return np.searchsorted(keys, f.key[c]), np.searchsorted(keys, f.key[c], "right"), order, False
        at = place[c]
        some = at >= 0
        own = f.doc[c] * (np.int64(1) << 32) + f.parent[c]
        lo, hi = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
        if axis in ("<", "<<"):
            return np.where(some, lo if axis == "<<" else np.maximum(lo, at - 1), 0), np.where(some, at, 0), order, axis == "<<"
        return np.where(some, at + 1, 0), np.where(some, hi if axis == ">>" else np.minimum(hi, at + 2), 0), order, False

    def axis(self, step: Step, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in c, node) of the nodes of the axis, in its order."""
        f, axis = self.f, step.axis
        if axis == "...":
            rows, nodes, level = [], [], []
            row, node = np.arange(len(c)), f.above[c]
            while len(row := row[some := node >= 0]):
                node = node[some]
                rows.append(row)
                nodes.append(node)
                level.append(np.full(len(row), -len(rows) if step.reverse else len(rows)))
                node = f.above[node]
            if not rows:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            row, node = np.concatenate(rows), np.concatenate(nodes)
            order = np.lexsort((np.concatenate(level), row))
            return row[order], node[order]
        lo, hi, listed, backward = self.ranges(axis, c)
        if axis in ("**", "***", "<<<", ">>>"):
            # What the filters refuse needn't be met once for each context.
            total = int(np.maximum(hi - lo, 0).sum())
            pool = np.flatnonzero(f.pre == f.last) if axis == "***" else None
            if step.where is not None and not step.own and not _indexed(step) and total > len(f):
                pool = np.arange(len(f)) if pool is None else pool
                pool = pool[self.accepted(step.where, pool, None)]
            if pool is not None:
                lo, hi, listed = np.searchsorted(pool, lo), np.searchsorted(pool, hi), pool
        row, node = spread(lo, hi, backward != step.reverse)
        node = node if listed is None else listed[node]
        keep = None
        if axis == "<<<":
            keep = f.until[node] < c[row]
        elif axis in ("<", ">"):
            keep = f.ord[node] == f.ord[c[row]] + (-1 if axis == "<" else 1)
        return (row, node) if keep is None else (row[keep], node[keep])

    def step(self, step: Step, now: Found) -> Found:
        if step.axis == ".":
            out, idx = now, offsets(now.origin)
        elif step.axis == "><":
            out = self.distinct(now, step.reverse)
            idx = offsets(out.origin)
        else:
            row, node = self.axis(step, now.node)
            if step.own:
                own = np.arange(len(now.node))
                if step.own == "!":
                    own = np.setdiff1d(own, row, assume_unique=False)
                parts = [(row, node), (own, now.node[own])]
                parts = parts if step.reverse else parts[::-1]
                row, node = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(row, kind="stable")
                row, node = row[order], node[order]
            out, idx = Found(now.origin[row], node), offsets(row)
        if step.where is not None:
            out = self.only(out, self.accepted(step.where, out.node, idx))
        if step.having is not None:
            some, back = np.unique(out.node, return_inverse=True)
            out = self.only(out, self.having(step.having, some)[back])
        return out

    @staticmethod
    def only(found: Found, keep: np.ndarray) -> Found:
        return Found(found.origin[keep], found.node[keep])

    def distinct(self, now: Found, reverse: bool) -> Found:
        """The first of the nodes of an origin that are alike."""
        f, n = self.f, np.arange(len(now.node))
        keys = [n, f.start[now.node], f.stop[now.node], f.codes[now.node]]
        if f.table is not None and "value" in f.table.column_names:
            coded = f.table.column("value").combine_chunks().dictionary_encode(null_encoding="encode")
            coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
            keys.append(coded.indices.to_numpy(zero_copy_only=False)[now.node])
        keys.append(now.origin)
        order = np.lexsort(keys)
        new = np.zeros(len(n), bool)
        new[:1] = True
        for k in keys[1:]:
            new[1:] |= k[order][1:] != k[order][:-1]
        first = np.sort(order[new])
        if reverse:
            first = first[np.lexsort((-first, now.origin[first]))]
        return self.only(now, first)

    def accepted(self, where: object, at: np.ndarray, idx: np.ndarray | None) -> np.ndarray:
        f = self.f
        textual = any(t.kind in TEXTUAL for t in _tests(where))
        yes, _ = self.condition(where, at, idx)
        return yes & (f.texts[f.doc[at]] > 0) if textual else yes

    def condition(self, node: object, at: np.ndarray, idx: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | bool]:
        """For each node whether it is true, and whether it is unknown (of a null text)."""
        if isinstance(node, Not):
            yes, odd = self.condition(node.arg, at, idx)
            return ~yes & ~np.asarray(odd), odd
        if isinstance(node, Binary):
            a, odd_a = self.condition(node.left, at, idx)
            odd_a = np.broadcast_to(odd_a, a.shape)
            if node.op == "^":
                b, odd_b = self.condition(node.right, at, idx)
                odd = odd_a | odd_b
                return (a != b) & ~odd, odd
            # The right side counts where the left doesn't settle it.
            need = np.flatnonzero(a | odd_a if node.op == "&" else ~a)
            b, odd_b = np.zeros(len(at), bool), np.zeros(len(at), bool)
            b[need], odd_b[need] = self.condition(node.right, at[need], None if idx is None else idx[need])
            if node.op == "&":
                return a & b, (odd_a | odd_b) & (a | odd_a) & (b | odd_b)
            return a | b, (odd_a | odd_b) & ~(a | b)
        return self.test(node, at, idx)

    def test(self, t: Test, at: np.ndarray, idx: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | bool]:
        f, odd = self.f, False
        if t in self.marks:
            return f.table.column(self.marks[t]).take(pa.array(at)).to_numpy().astype(bool), False
        if t.kind == "label":
            hit = f.is_label(*t.values)[at]
        elif t.kind == "index":
            hit = np.zeros(len(at), bool)
            for a, b in t.values:
                hit |= (idx >= a) & (True if b is None else idx < b)
        else:
            texts = f.substrings(at)
            fold = t.kind.startswith("fold")
            if fold:
                texts = [x.casefold() for x in texts]
            values = tuple(v.casefold() for v in t.values) if fold else t.values
            if t.kind in ("text", "fold"):
                chosen = frozenset(values)
                hits = (x in chosen for x in texts)
            elif t.kind.endswith("end"):
                hits = (x.endswith(values) for x in texts)
            else:
                hits = (x.startswith(values) for x in texts)
            hit = np.fromiter(hits, bool, len(at))
            known = f.texts[f.doc[at]] == 2
            if not known.all():
                odd, hit = ~known, hit & known
        if t.negated:
            hit = ~hit & ~np.asarray(odd)
        return hit, odd

    def having(self, node: object, at: np.ndarray) -> np.ndarray:
        if isinstance(node, Exists):
            hit = np.zeros(len(at), bool)
            for part in self.find(node.path, at, False):
                hit[part.origin] = True
            return hit
        if isinstance(node, Not):
            return ~self.having(node.arg, at)
        a, b = self.having(node.left, at), self.having(node.right, at)
        return a & b if node.op == "&" else a | b if node.op == "|" else a != b


def found(forest: Forest, path: Path, marks: dict[Test, str], columns: list[str], ordered: bool, first: bool = False, contexts: str | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of the nodes that a path finds: columns, ``origin`` and, if ordered, ``pos``. first: only the first of each context. contexts: a column that marks them instead of the roots."""
    if contexts is None:
        starts = np.flatnonzero(forest.pre == 0)
    else:
        starts = np.flatnonzero(forest.table.column(contexts).fill_null(False).to_numpy().astype(bool))
    for part in Walker(forest, marks).find(path, starts, ordered or first):
        origin, node = part.origin, part.node
        pos = offsets(origin) if ordered or first else None
        if first:
            origin, node, pos = origin[pos == 0], node[pos == 0], pos[pos == 0]
        more = {"origin": forest.pre[starts[origin]]} | ({"pos": pos} if ordered else {})
        yield from forest.rows(columns, node, more)
