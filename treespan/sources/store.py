"""Reading and writing trees: Parquet, JSON, text dumps, and spans from other tokenizers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import format_node, shortened
from ..model import NODE_FIELDS, SEGMENTS
from ..plans.forest import Forest, Trees, small_batches

FORMAT_VERSION = 1


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text, source of whole text files; ids are hashes of the paths."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source"))
    return rows.select(F.xxhash64("source").alias("doc_id"), "text", "source")


def write_segments(segments: DataFrame, path: str, buckets: int | None = None, table: str | None = None) -> None:
    """A Parquet store of segments; with ``table`` a bucketed one, whose path queries join without a shuffle."""
    if table:
        segments.write.bucketBy(buckets or 200, "doc_id").sortBy("doc_id", "pre").option("path", path).saveAsTable(table)
    else:
        segments.sortWithinPartitions("doc_id", "pre").write.parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def from_spans(docs: DataFrame, spans: Callable[[str], list[tuple[int, int]]], label: str | None = None) -> DataFrame:
    """doc_id, start, stop, label of the spans that a tokenizer's function gives of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, a, b) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for a, b in spans(t or "")]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            kinds = (pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array([label] * len(rows), pa.string())], ["doc_id", "start", "stop", "label"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, start int, stop int, label string")


def successive(text: Column, subs: list[str], label: str | None = None) -> Column:
    """Spans of substrings found one after another, as an array of structs; fails where one is missing."""
    out, at = [], F.lit(0)
    for s in subs:
        found = F.locate(s, text, 1) if not out else F.call_function("locate", F.lit(s), text, at + 1)
        start = F.when(found > 0, found - 1).otherwise(F.raise_error(F.lit(f"substring {s!r} not found")).cast("int"))
        out.append(F.struct(start.alias("start"), (start + len(s)).alias("stop"), F.lit(label).cast("string").alias("label")))
        at = start + len(s)
    return F.array(*out)


def _with_texts(segments: DataFrame | Trees, docs: DataFrame | None) -> Trees:
    return segments if isinstance(segments, Trees) else Trees.of_rows(segments, docs)


def to_json(segments: DataFrame | Trees, docs: DataFrame | None = None, texts: bool | None = None) -> DataFrame:
    """doc_id, json: a document's tree as a list of nodes in depth-first order, each with its depth; with ``docs`` (or the texts of ``Trees``, if asked for) the text too, else it must be given back on reading."""
    trees = _with_texts(segments, docs)
    texts = docs is not None if texts is None else texts

    def run(f: Forest) -> Iterator[pa.RecordBatch]:
        names = [json.dumps(x, ensure_ascii=False) for x in f.names] + ["null"]  # the last is that of code -1
        out, which = [], []
        columns = [x.tolist() for x in (f.depth, f.start, f.stop, f.codes)]
        for i, (a, b) in enumerate(zip(f.begin[:-1].tolist(), f.begin[1:].tolist(), strict=True)):
            if texts and f.texts[i] == 0:
                continue
            nodes = ",".join([f'{{"depth":{d},"start":{x},"stop":{y},"label":{names[c]}}}' for d, x, y, c in zip(*(x[a:b] for x in columns), strict=True)])
            text = f'"text":{json.dumps(f.text_of(i), ensure_ascii=False)},' if texts else ""
            out.append(f'{{"version":{FORMAT_VERSION},{text}"nodes":[{nodes}]}}')
            which.append(i)
        yield pa.RecordBatch.from_arrays([f.ids.take(pa.array(which, pa.int64())), pa.array(out, pa.string())], ["doc_id", "json"])

    return trees.each(run, T.StructType([trees.schema["doc_id"], T.StructField("json", T.StringType())]))


def from_json(rows: DataFrame) -> DataFrame:
    """Segments of ``to_json``'s rows: ranks come from the order and depth of the nodes, one pass a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(cols: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[1:8]), pa.array(cols[8], pa.string())], ["doc_id", *NODE_FIELDS, "label"])

        out: list[list] = [[] for _ in range(9)]
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = json.loads(text)
                if got.get("version", 0) > FORMAT_VERSION:
                    raise ValueError(f"a later format: {got['version']}")
                depths = [n["depth"] for n in got["nodes"]]
                last, parents, places = list(range(len(depths))), [], []
                chain: list[int] = []
                kids: list[int] = []
                tops = 0
                for pre, depth in enumerate(depths):
                    if depth < len(chain):
                        for up in chain[depth:]:  # they end here
                            last[up] = pre - 1
                        del chain[depth:]
                    if chain:
                        parent = chain[-1]
                        parents.append(parent)
                        places.append(kids[parent])
                        kids[parent] += 1
                    else:
                        parents.append(None)
                        places.append(tops)
                        tops += 1
                    chain.append(pre)
                    kids.append(0)
                for up in chain:
                    last[up] = len(depths) - 1
                for column, values in zip(out, ([doc] * len(depths), range(len(depths)), last, parents, depths, places, [n["start"] for n in got["nodes"]], [n["stop"] for n in got["nodes"]], [n["label"] for n in got["nodes"]]), strict=True):
                    column += values
                if len(out[0]) >= ROWS:
                    yield batch_of(out)
                    out = [[] for _ in range(9)]
        if out[0]:
            yield batch_of(out)

    return small_batches(rows.select(F.col("doc_id").cast("long"), "json")).mapInArrow(run, SEGMENTS)


ROWS = 20_000  # of segments in an Arrow batch, at least


#: Line formats of the dumps.
COMPACT_LINE, TREE_LINE = "%span %desc!r : '%substr!1r1:40…% '", "%span %desc!r : '%substr!1r1:^40…% '"


def _lined(pre: list, parent: list, start: list, stop: list, label: list, text: str) -> str:
    """Nodes with the lines of their tree before them, each by TREE_LINE, which is spelt out here as it is met for every node."""
    last = dict(zip(parent, pre, strict=True))  # the last child of each
    out, rail = [], {None: ""}
    shown = {x: repr(x or "") for x in set(label)}
    for p, up, a, b, d in zip(pre, parent, start, stop, label, strict=True):
        sub = repr(text[a:b])[1:-1]
        if len(sub) > 40:
            sub = shortened(sub, 40, "…", "^")
        before = rail[up]
        if up is None:
            rail[p] = ""
        else:
            ends = last[up] == p
            rail[p] = f"{before}   " if ends else f"{before}│  "
            before = f"{before}└──" if ends else f"{before}├──"
        out.append(f"{before}({a}, {b}) {shown[d]} : '{sub}'\n")
    return "".join(out)


def dump(rows: list[dict], text: str, style: str = "compact", indent: str = "    ") -> str:
    """A tree as text. rows: segments of one document. Styles: compact (numbered, indented), tree (lines drawn), xml, json."""
    rows = sorted(rows, key=lambda r: r["pre"])
    line = lambda spec, r: format_node(spec, text, r["start"], r["stop"], r["label"])
    if style == "compact":
        return "".join(f"{indent * r['depth']}{r['ord'] + 1:,}: {line(COMPACT_LINE, r)}\n" for r in rows)
    if style == "tree":
        return _lined(*(list(c) for c in zip(*((r["pre"], r["parent"], r["start"], r["stop"], r["label"]) for r in rows), strict=True)), text) if rows else ""
    by: dict = {}
    for r in rows:
        by.setdefault(r["parent"], []).append(r)
    if style == "json":

        def node(r: dict) -> dict:
            return {"start": r["start"], "stop": r["stop"], "desc": r["label"], "substr": text[r["start"] : r["stop"]], "children": [node(k) for k in by.get(r["pre"], [])]}

        return json.dumps({"itos": [node(r) for r in by.get(None, [])]}, ensure_ascii=False, indent=indent) + "\n"
    if style != "xml":
        raise ValueError(f"no style {style!r}")
    out = ['<?xml version="1.0" encoding="UTF-8" ?>', "<itos>"]

    def put(r: dict) -> None:
        pad = indent * (r["depth"] + 1)
        out.append(f'{pad}<ito start="{r["start"]}" stop="{r["stop"]}" desc={quoteattr(r["label"] or "")}>')
        out.append(f"{pad}<substring>{escape(text[r['start'] : r['stop']])}</substring>")
        if kids := by.get(r["pre"]):
            out.append(f"{pad}<children>")
            for k in kids:
                put(k)
            out.append(f"{pad}</children>")
        out.append(f"{pad}</ito>")

    for r in by.get(None, []):
        put(r)
    return "\n".join([*out, "</itos>", ""])


def dumped(segments: DataFrame | Trees, docs: DataFrame | None = None, style: str = "compact") -> DataFrame:
    """doc_id, dump of every tree."""
    trees = _with_texts(segments, docs)

    def run(f: Forest) -> Iterator[pa.RecordBatch]:
        names = ("pre", "parent", "start", "stop", "label") if style == "tree" else (*NODE_FIELDS, "label")
        columns = [f.column(c, np.arange(len(f))).to_pylist() for c in names]
        for i, (a, b) in enumerate(zip(f.begin[:-1].tolist(), f.begin[1:].tolist(), strict=True)):
            own, text = [c[a:b] for c in columns], f.text_of(i) or ""
            out = _lined(*own, text) if style == "tree" else dump([dict(zip(names, r, strict=True)) for r in zip(*own, strict=True)], text, style)
            yield pa.RecordBatch.from_arrays([f.ids.slice(i, 1), pa.array([out], pa.string())], ["doc_id", "dump"])

    return trees.each(run, T.StructType([trees.schema["doc_id"], T.StructField("dump", T.StringType())]))


COLOURS = (31, 32, 33, 34, 35, 36)  # terminal foregrounds, in turn


def highlighted(text: str, spans: list[tuple[int, int]]) -> str:
    """A text with spans, in order and apart, in colours for a terminal."""
    out, at = [], 0
    for i, (a, b) in enumerate(spans):
        out += [text[at:a], f"\x1b[{COLOURS[i % len(COLOURS)]}m", text[a:b], "\x1b[0m"]
        at = b
    return "".join([*out, text[at:]])
